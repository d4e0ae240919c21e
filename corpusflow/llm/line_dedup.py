"""Line de-duplication over levelled sorted runs of line hashes (DataFrame functions only).

A run has two sorted tables (h1, h2, n_docs): line keys that no earlier run held, and the counts a
batch adds to keys that one did. Each new batch of documents merge-anti-joins the runs, which
splits its keys into the two, and adds its own run to level 0. When a level holds ``FANOUT`` runs
they are merged into one sorted run of the next level, so a lookup meets a number of runs that is
logarithmic in the number of batches. New keys of different runs never meet, so merging them adds
nothing up, and a key's count is its one new row plus the few rows that know it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import ascii_lower, broadcast_bounded, shared_dir, stored, text_key, text_of

FANOUT = 4
MIN_DOCS = 10
MIN_CHARS = 1
RUN = "h1 long, h2 long, n_docs long"
NEW, AGAIN = "new", "again"        # the two tables of a run
STRIP = " \t\n\u000b\f\r"


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One element per ``\\n``-separated line: 128 bits of its key (white space stripped at both
    ends, A-Z lower-cased) as struct (h1, h2); null where the key is under ``min_chars``."""

    def one(line):
        key = F.btrim(line, F.lit(STRIP))
        return F.get(F.transform(F.array(key), lambda k: F.when(
            F.char_length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2")))), F.lit(0))

    return F.transform(F.split(ascii_lower(text), "\n"), one)


class LineRuns:
    """The levelled runs of one corpus in a shared folder.

    ``levels[i]`` lists the folders of level i. A run folder is written once and never
    overwritten. Pass ``levels`` of an earlier store to go on with it in another job."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT,
                 levels: list[list[str]] | None = None):
        self.spark, self.path, self.fanout = spark, path or shared_dir(spark), fanout
        self.levels = [list(x) for x in levels] if levels else [[]]

    def add(self, docs: DataFrame, text_col: str = "text", batch: Column | None = None, n_batches: int = 1,
            min_chars: int = MIN_CHARS) -> None:
        """Add documents as one run, or in turn as ``n_batches`` runs split by the int column ``batch``
        (0..n-1), whose keys one scan of the documents writes. A key counts once per document row and is combined
        map-side: a line of a third of all documents is a few rows in the shuffle."""
        keys = docs.select((F.lit(0) if batch is None else batch).alias("batch"), F.explode(
            F.array_distinct(F.array_compact(line_hashes(text_of(text_col), min_chars)))).alias("k"))
        runs = keys.groupBy("batch", "k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n_docs"))
        out = shared_dir(self.spark)
        runs.write.partitionBy("batch").parquet(out)
        for b in range(n_batches):
            # a batch without any line key has no folder
            if self._exists(f"{out}/batch={b}"):
                self._add_run(self.spark.read.schema(RUN).parquet(f"{out}/batch={b}"))

    def _add_run(self, keys: DataFrame) -> None:
        seen = self._read(NEW).select("h1", "h2").hint("merge")
        run = shared_dir(self.spark)
        for kind, how in ((NEW, "left_anti"), (AGAIN, "left_semi")):
            keys.join(seen, ["h1", "h2"], how).sortWithinPartitions("h1", "h2").write.parquet(f"{run}/{kind}")
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            run, merged = shared_dir(self.spark), self.levels[level]
            new, again = self._read(NEW, merged), self._read(AGAIN, merged).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            new.repartition("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(f"{run}/{NEW}")
            again.sortWithinPartitions("h1", "h2").write.parquet(f"{run}/{AGAIN}")
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(run)
            self.levels[level] = []
            level += 1

    def _read(self, kind: str, runs: list[str] | None = None) -> DataFrame:
        """The new keys, or the added counts, of these runs (default: all)."""
        paths = [f"{r}/{kind}" for r in (runs if runs is not None else [r for level in self.levels for r in level])]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs."""
        added = self._read(AGAIN).groupBy("h1", "h2").agg(F.sum("n_docs").alias("added"))
        return self._read(NEW).join(added, ["h1", "h2"], "left").select(
            "h1", "h2", (F.col("n_docs") + F.coalesce("added", F.lit(0))).alias("n_docs"))

    def unseen(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS) -> DataFrame:
        """Lines of a new batch whose key no run holds yet: (id, pos, line), by merge anti join.
        Lines without a key (shorter than ``min_chars``) are always returned."""
        text = text_of(text_col)
        rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(
            F.split(text, "\n").alias("line"), line_hashes(text, min_chars).alias("k"))).alias("pos", "x"))
        rows = rows.select("id", "pos", "x.line", "x.k.h1", "x.k.h2")
        return rows.join(self._read(NEW).hint("merge"), ["h1", "h2"], "left_anti").select(
            F.col("id").alias(id_col), "pos", "line")


def drop_repeated_lines(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text",
                        min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per input row: ``row`` (struct of all its columns), ``kept`` (the text without the lines
    whose key the runs count in at least ``min_docs`` documents), ``n_lines`` before and
    ``n_dropped``.

    A null or empty text is one empty line, which stays (``kept`` is then empty). Rows that
    repeat are separate documents and are cut alike; columns of any names stay in ``row``. The frequent
    keys are broadcast up to a number of rows (16 bytes each), so a line of a third of all documents
    is not shuffled; beyond it the lines meet them in a merge join. The texts are shuffled once, to
    meet the positions to drop.
    """
    frequent = broadcast_bounded(stored(runs.counts().filter(F.col("n_docs") >= min_docs).select("h1", "h2")))
    text = text_of(text_col)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("tk"))
    lines = (docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"),
                         F.posexplode(line_hashes(text, min_chars)).alias("pos", "k"))
             .filter("k is not null").select("id", "tk", "pos", "k.h1", "k.h2"))
    gone = (lines.join(frequent, ["h1", "h2"], "left_semi")
            .groupBy(F.col("id").alias("gid"), F.col("tk").alias("gtk")).agg(F.collect_set("pos").alias("gone")))
    both = whole.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("tk") == F.col("gtk")), "left")
    cut = both.select("row", "gone", text_of(F.col("row")[text_col]).alias("t")).select(
        "row", "gone", "t", F.split("t", "\n").alias("ls"))

    def without(ls):
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(
        F.get(F.transform(F.array("ls"), without), F.lit(0)))
    return cut.select("row", kept.alias("kept"), F.size("ls").cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def batch_of(key: Column, n_batches: int) -> Column:
    """A batch number 0..n-1 by hash of ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(n_batches)).cast("int")
