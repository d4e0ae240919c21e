"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token's tokens are its cheapest segmentation into vocabulary pieces, where a piece
of rank r costs ln(r + 2) (Zipf's law over the vocabulary's rank order; the vocabulary is
given, nothing is trained). The forward cost of a prefix depends on that prefix alone, so
the distinct pre-tokens of a batch are put into a trie and each node's cost is computed
once, however many pre-tokens share it. The trie is visited in sorted order, which needs
only the current path in memory.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the byte-level pre-token pattern that goes with the vocabulary
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCALE = 1_000_000
MEMO = 200_000          # terminal counts kept per task between batches; only a cache


def load_costs(path: str = VOCABULARY) -> dict[bytes, int]:
    """piece -> integer cost, from a file of ``base64 rank`` lines (read on the driver)."""
    costs: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                costs[base64.b64decode(piece)] = round(SCALE * math.log(int(rank) + 2))
    return costs


def terminal_counts(pre_tokens: list[bytes], costs: dict[bytes, int], longest: int) -> dict[bytes, int]:
    """Tokens of each distinct pre-token: cheapest segmentation, the fewest tokens among equals.
    A byte outside the vocabulary is one token at a cost above any piece's."""
    unknown = SCALE * 100
    out: dict[bytes, int] = {}
    path = b""
    best: list[tuple[int, int]] = [(0, 0)]       # (cost, tokens) of every prefix on the path
    for word in sorted(pre_tokens):
        shared, most = 0, min(len(path), len(word))
        if path[:most] == word[:most]:
            shared = most
        else:
            while path[shared] == word[shared]:
                shared += 1
        del best[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            low = (best[end - 1][0] + unknown, best[end - 1][1] + 1)
            for start in range(max(0, end - longest), end):
                cost = costs.get(word[start:end])
                if cost is not None:
                    before = best[start]
                    here = (before[0] + cost, before[1] + 1)
                    if here < low:
                        low = here
            best.append(low)
        path = word
        out[word] = best[-1][1]
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id, n_pretokens, n_tokens (both long), over the whole text.

    Null and empty texts have none. Narrow: no shuffle, and a lost task is simply run again.
    Only ``id_col`` and ``text_col`` are read, so other columns cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    costs = spark.sparkContext.broadcast(load_costs(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(PRE_TOKEN).findall
        pieces = costs.value
        longest = max(map(len, pieces))
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):          # 256 texts' pre-tokens in memory at a time
                part = batch.iloc[at:at + 256]
                found = [split(t) if t else [] for t in part["text"]]
                if len(memo) > MEMO:
                    memo = {}
                new = {p for f in found for p in f if p not in memo}
                if new:
                    done = terminal_counts([p.encode("utf-8", "surrogatepass") for p in new], pieces, longest)
                    memo.update((k.decode("utf-8", "surrogatepass"), v) for k, v in done.items())
                yield pd.DataFrame({"id": part["id"], "n_pretokens": [len(f) for f in found],
                                    "n_tokens": [sum(map(memo.__getitem__, f)) for f in found]})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
