"""Near-duplicates by SimHash: BK-tree shards find the links, label propagation the groups.

Equal fingerprints are one node. Two fingerprints within ``RADIUS`` bits agree on at least
one of ``RADIUS + 1`` bands, so every (band, value) is a shard and each shard answers its
members' queries with a BK-tree of its own: children are keyed by their distance to the
parent, and a query follows only the edges within the radius. A shard above ``SHARD``
members is divided again by bands over the bits that its members need not share, until it
fits; that is exact at every size. A shard's tree goes to its members by shuffle, since a
broadcast of all trees would grow with the corpus. A shard returns a spanning forest of
its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusflow.llm.common import stored, text_key

SHINGLE = 3
RADIUS = 2
SHARD = 2048
LAST_BITS = 9
EDGES_PER_FILE = 200_000
FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of the whole text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []   # A-Z and ASCII white space only
    if not ws:
        return 0
    grams = [b" ".join(ws)] if len(ws) < shingle else map(b" ".join, zip(*(ws[i:] for i in range(shingle))))
    hs = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hs), 65536):
        part = hs[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hs), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series, shingle: pd.Series) -> pd.Series:
    n = int(shingle.iloc[0]) if len(shingle) else SHINGLE
    return pd.Series([fingerprint(t, n) for t in texts], dtype="int64")


class BKTree:
    """Distinct 64-bit codes; ``near`` visits only children within ``radius`` of the distance."""

    def __init__(self):
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, code: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.codes else []
        codes, children = self.codes, self.children
        while todo:
            i = todo.pop()
            d = (codes[i] ^ code).bit_count()
            if d <= radius:
                found.append(i)
            kids = children[i]
            if kids:
                for edge in range(max(1, d - radius), d + radius + 1):
                    j = kids.get(edge)
                    if j is not None:
                        todo.append(j)
        return found

    def add(self, code: int) -> None:
        self.codes.append(code)
        self.children.append({})
        new, i = len(self.codes) - 1, 0
        while new:
            d = (self.codes[i] ^ code).bit_count()
            j = self.children[i].get(d)
            if j is None:
                self.children[i][d] = new
                return
            i = j


def shard_links(codes: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct ``codes`` (unsigned) of one shard."""
    tree, root, out = BKTree(), list(range(len(codes))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for n, code in enumerate(codes):
        for i in tree.near(code, radius):
            a, b = find(i), find(n)
            if a != b:
                root[b] = a
                out.append((codes[i], code))
        tree.add(code)
    return out


def _bands(mask: int, n: int) -> list[int]:
    bits = [i for i in range(64) if mask >> i & 1]
    size = -(-len(bits) // n)
    return [sum(1 << b for b in bits[k * size:(k + 1) * size]) for k in range(n)]


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, long), a spanning forest per shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, codes = None, []

        def done() -> pd.DataFrame:
            found = shard_links([c & FULL for c in codes], radius) if len(codes) > 1 else []
            return pd.DataFrame([(_signed(a), _signed(b)) for a, b in found], columns=["a", "b"], dtype="int64")

        for batch in batches:
            for k, c in zip(batch["key"].tolist(), batch["fp"].tolist()):
                if k != key:
                    if len(codes) > 1 and len(out := done()):
                        yield out
                    key, codes = k, []
                codes.append(c)
        if len(codes) > 1 and len(out := done()):
            yield out

    # shards are little data and much work: a fixed number of tasks, which Spark does not coalesce
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # free: per division path the bits that members of its shards need not share
    free, found = {0: FULL}, []
    level = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("path"))
    while free:
        paths, cases = {}, []
        for path, mask in free.items():
            for band in _bands(mask, radius + 1):
                child = len(paths) + 1
                paths[child] = mask & ~band
                cases.append((path, child, band))
        same = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(_signed(b)).alias("b"))
                                  for p, c, b in cases]), lambda x: x["p"] == F.col("path"))
        dealt = level.select("fp", "key", F.explode(same).alias("x")).select(
            "fp", F.xxhash64("key", "x.c", F.col("fp").bitwiseAND(F.col("x.b"))).alias("key"), F.col("x.c").alias("path"))
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = stored(dealt.join(sizes, "key"))
        # with few free bits left a shard has at most 2 ** LAST_BITS distinct codes
        last = [p for p, m in paths.items() if m.bit_count() <= LAST_BITS]
        fits = (F.col("n") <= shard) | F.col("path").isin(last)
        small = sized.filter(fits).select("key", "fp")
        found.append(small.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInPandas(run, "a long, b long"))
        level = sized.filter(~fits).select("fp", "key", "path")
        hot = [r["path"] for r in level.select("path").distinct().collect()]     # at most 3^depth paths
        free = {p: paths[p] for p in hot}
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node of its component.

    Alternating large and small stars; a star's minimum is found by a map-side combined
    aggregate and joined back, so a hub is not gathered in one task. Every round is stored."""
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    last = state(cur)
    while last[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("h"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("h")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "h")
        small = large.join(low, F.col("u") == F.col("h")).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        # the number of edges never grows: a file for every EDGES_PER_FILE of them
        cur = stored(small.select("e.u", "e.v").filter("u <> v").distinct(), 1 + last[0] // EDGES_PER_FILE)
        now = state(cur)
        if now == last:
            break
        last = now
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, fp (long), component_id (smallest id reachable over links of
    at most ``radius`` differing bits, itself included) and root (the group's key).

    Null, empty and white-space texts have fingerprint zero and link like any other. Rows
    that repeat share a node. Null ids never become a component_id unless a group has no
    other. Columns other than ``keep`` are not read. Copies collapse before any comparison: a group of a
    third of all rows is one node.
    """
    prints = stored(docs.select(F.col(id_col).alias("id"), *keep, _fingerprints(F.col(text_col), F.lit(shingle)).alias("fp")))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")))
    comp = stored(components(links(nodes.select("fp"), radius)))
    grouped = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(grouped.join(lows, "root").select(F.col("fp").alias("nfp"), "root", "component_id"))
    return prints.join(named, F.col("fp") == F.col("nfp")).select(F.col("id").alias(id_col), *keep, "fp", "component_id", "root")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-duplicates: the
    smallest id, and of rows with that id the smallest text key (of rows alike, any one).

    Groups are decided on narrow rows (id, fingerprint, text key); the texts meet the chosen
    keys once."""
    keyed = docs.select(F.col(id_col), F.col(text_col), text_key(text_col).alias("k"))
    named = near_duplicates(keyed, id_col, text_col, shingle, radius, keep=("k",))
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("k").alias("k")))
    chosen = stored(named.groupBy("root").agg(first.alias("c")).select(F.col("c.id").alias("__id"), F.col("c.k").alias("__k")))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("k"))
    kept = row.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k"))).select("row", "id", "k")
    # rows alike in id and text: number them where they already lie
    alike = Window.partitionBy("id", "k").orderBy(F.lit(0))
    return kept.withColumn("i", F.row_number().over(alike)).filter("i = 1").select("row.*")
