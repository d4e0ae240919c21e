"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores the measurements and one
failure bit per rule. Policies are versioned masks over those bits; a new policy, or an
ablation of one, reads the ledger and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import let, text_of, words

WINDOW = 8

# rule name -> failure condition over the measurements; the bit is the position in this list
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("exclamation", "100 * n_exclaim > 30 * n_words"),
    ("word_length_low", "word_chars < 2 * n_words"),
    ("word_length_high", "word_chars > 20 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_short"] | BIT["repeated_words"]

# policy version -> the rules that reject a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_words"),
    "v1": ("too_short", "repeated_words", "symbols", "duplicate_lines"),
    # measured on labels.quality, duplicate lines told good documents from bad ones no better than chance
    "v2": ("too_short", "repeated_words", "symbols", "exclamation", "word_length_low", "word_length_high"),
}
CURRENT = "v2"


def policy_mask(version: str) -> int:
    return sum(BIT[r] for r in POLICIES[version])


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the array (the first
    occurrence included). Windows are compared by a 64-bit hash of their words.

    Works inside the row: no shuffle, memory linear in the text. Only rows with a repeated
    window pay for the sort."""

    def count(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + width).alias("end"),
                                  (a["n"] + width - F.greatest(F.lit(0), a["end"] - i)).alias("n")),
            lambda a: a["n"])

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(pairs, count))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    return F.when(F.size(ws) <= width, F.lit(0)).otherwise(let(ws, lambda w: let(hashes(w), covered))).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, measurements and ``fail_bits`` (bit i: rule i of ``RULES`` fails).

    A null or empty text has no words and one line; it fails ``too_short`` and nothing
    else. Repeated rows each get their own row; other columns of the input are not read.
    """
    base = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    parts = base.select(id_col, "text", words(F.col("text")).alias("ws"),
                        F.split(F.col("text"), "\n").alias("ls"))
    with_word = F.filter(F.col("ls"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = parts.select(
        id_col,
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long")
        .alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("!"), F.lit("")))).cast("long")
        .alias("n_exclaim"),
    )
    bits = F.lit(0).cast("long")
    for i, (_, cond) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``base_failed``, ``policy`` and ``kept`` (no rule of the policy fails)."""
    mask = F.lit(policy_mask(version)).cast("long")
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0
    return (led.withColumn("base_failed", base).withColumn("policy", F.lit(version))
            .withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(mask) == 0)))


def with_sole_rule(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``only_rule``, the rule of the policy that alone rejects the document (null if none or
    several do), and ``n_only_rule``, how many documents of the ledger it alone rejects."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long"))
    sole = F.coalesce(*[F.when(hit == BIT[n], F.lit(n)) for n in POLICIES[version]])
    per_rule = ablation(led, version).select(F.col("rule").alias("_rule"), F.col("n_only").alias("n_only_rule"))
    # one row per rule
    return led.withColumn("only_rule", sole).join(F.broadcast(per_rule), F.col("only_rule") == F.col("_rule"), "left").drop("_rule")


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only this rule rejects
    (what the policy would regain without it). One pass of bitwise sums, one row per rule."""
    mask = policy_mask(version)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    names = POLICIES[version]
    sums = [F.sum((hit.bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).cast("long")).alias(f"f{i}") for i, n in enumerate(names)]
    sums += [F.sum((hit == BIT[n]).cast("long")).alias(f"o{i}") for i, n in enumerate(names)]
    rows = F.array(*[F.struct(F.lit(version).alias("policy"), F.lit(n).alias("rule"),
                              F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("n_failed"),
                              F.coalesce(F.col(f"o{i}"), F.lit(0)).alias("n_only")) for i, n in enumerate(names)])
    return led.agg(*sums).select(F.inline(rows))
