"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

The query side are item-sized windows: ``WINDOW`` consecutive words of a benchmark item
(a shorter item is one window). A document holds a window only if it holds all its words,
so any one of them is a sufficient prefix: each window is indexed under its rarest word,
counted over all documents. Document words meet that index, and a candidate is kept after
the length and position bounds and an exact comparison of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import ascii_lower, broadcast_checked, frame_bytes, stored, text_key, text_of, words

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
FILE_BYTES = 4 << 20        # a stored index table has a file per so many bytes of items, 16 at least
BLOCK_BYTES = 16 << 20      # index bytes broadcast at a time; more take further passes


def match_words(col: str | Column) -> Column:
    return words(ascii_lower(text_of(col)), NON_WORD)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (win array of words, item string). A null id is the string "null"; items without
    words have no window."""
    ws = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                      match_words(text_col).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (width - 1)))
    return ws.select("item", "ws", F.explode(starts).alias("s")).select(
        F.slice("ws", F.col("s"), F.lit(width)).alias("win"), "item").distinct()


def _groups(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(win, items_key) per window and (items_key, item): windows that the same items hold share one
    list. The key of a set of items is their number and two 64-bit hash sums, so no list is ever
    gathered: a template of a third of all items stands once, however many windows it has."""
    key = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"),
                   F.bit_xor(F.xxhash64(F.lit("items"), "item")).alias("b"))
    wins = pairs.groupBy("win").agg(key.alias("items_key"))
    one = wins.groupBy("items_key").agg(F.min("win").alias("win"))
    return wins, pairs.join(one, "win").select("items_key", "item")


def _index(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """Each window under its rarest word: (word, off, len, win, items_key). The counts are over the
    words of all documents; equally rare words go by the first in code point order."""
    vocab = stored(windows.select(F.explode("win").alias("word")).distinct())
    tokens = docs.select(F.explode(match_words(text_col)).alias("word"))
    seen = tokens.join(broadcast_checked(vocab), "word", "left_semi")
    freq = stored(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    placed = windows.select("win", "items_key", F.posexplode("win").alias("off", "word"))
    first = placed.join(broadcast_checked(freq), "word", "left").groupBy("win", "items_key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("off"))).alias("m"))
    # a word that no document holds makes its window impossible
    return first.filter("m.n > 0").select(F.col("m.word").alias("word"), F.col("m.off").alias("off"),
                                          F.size("win").alias("len"), "win", "items_key")


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per input row: id, text key, ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``items`` (ids of the items with occurring windows, sorted as strings).

    Null texts have no words. Rows that repeat each get their row. The index is broadcast in
    blocks of about ``BLOCK_BYTES``, one pass over the documents each. A pass needs no shuffle of
    texts or words: only the matches are grouped by document, and what they say of items is a
    distinct set of keys per document, which meets the items afterwards.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text).cast("long")), F.lit(0))).first()[0]
    files = max(16, -(-size // FILE_BYTES))
    pairs = stored(item_windows(items, item_id, item_text, width), files)
    wins, lists = (stored(x, files) for x in _groups(pairs))
    index = stored(_index(docs, wins, text_col), files) if size else None
    held = frame_bytes(index.select(F.array_join("win", " ").alias("win"), "word")) if size else 0
    blocks = max(1, -(-held // BLOCK_BYTES))
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), match_words(text_col).alias("ws"))
    found = None
    for b in range(blocks):
        # the empty word ends every document's words once: its match reports the document itself
        own = docs.sparkSession.range(1 if b == 0 else 0).select(
            F.lit("").alias("word"), F.lit(0).alias("off"), F.lit(0).alias("len"),
            F.array().cast("array<string>").alias("win"), F.lit(None).cast(wins.schema["items_key"].dataType).alias("items_key"))
        part = own
        if held:
            mine = index if blocks == 1 else index.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
            part = own.unionByName(mine)
        tokens = base.select("id", "tk", "ws", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "token"))
        start = F.col("pos") - F.col("off")
        ok = (F.col("token") == F.col("word")) & (start >= 0) & (start + F.col("len") <= F.size("ws")) & (
            (F.col("len") == 0) | (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")))
        hits = tokens.join(F.broadcast(part), ok).select(
            "id", "tk", F.when(F.col("len") == 0, F.size("ws")).alias("n_words"),
            F.when(F.col("len") > 0, F.struct(start.alias("s"), F.col("len").alias("l"))).alias("span"), "items_key")
        found = hits if found is None else found.unionByName(hits)
    per = stored(found.groupBy("id", "tk").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("copies"),
        F.collect_set("span").alias("spans"), F.collect_set("items_key").alias("keys")))
    of = (per.select("id", "tk", F.explode("keys").alias("items_key")).join(broadcast_checked(lists), "items_key")
          .groupBy(F.col("id").alias("i_id"), F.col("tk").alias("i_tk")).agg(F.sort_array(F.collect_set("item")).alias("items")))
    per = per.join(of, F.col("id").eqNullSafe(F.col("i_id")) & (F.col("tk") == F.col("i_tk")), "left")
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["s"] + x["l"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"])
    return per.select("id", "tk", "n_words", covered.cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), "copies").select(
        F.col("id").alias(id_col), F.col("tk").alias("text_key"), "n_words", "n_hit", "items",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
