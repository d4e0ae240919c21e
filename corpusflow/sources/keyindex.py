"""Where stored articles can be found by guid or url, without reading every stored key.

A narrow table of (bucket, h, id): h is a 64-bit hash of a guid or url that the article has or had,
and bucket the leading bits of h. It is partitioned by bucket, so a batch reads the buckets of its
own keys only, 16 bytes a key; the ids found there name the stored parts to open. Rows are only ever
appended, before the articles are committed: rows of a url that the article no longer has, of a
batch that was lost or written twice, or of another key with the same hash name an id too many, and
the stored row itself decides. The table can be rebuilt from the articles at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import materialize

SCHEMA = "h long, id long, bucket int"


def key_hash(kind: str, key: Column) -> Column:
    return F.xxhash64(F.lit(kind), key)


class KeyIndex:
    """``bits``: 2 ** bits buckets. A batch appends a file to every bucket it has keys for, and reads
    those buckets. On a large table there should be more buckets than a usual batch has keys, so that
    most stay closed (2 ** 16 buckets of 40 billion keys are 10 MB each); on a small one few, so that
    batches don't write many small files."""

    def __init__(self, spark: SparkSession, root: str, bits: int = 8):
        self.spark, self.root, self.bits = spark, root.rstrip("/"), bits

    def bucket_of(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bits).cast("int")

    def _rows(self, articles: DataFrame) -> DataFrame:
        """One row per key of (id, rss_guid, url)."""
        keys = F.array(key_hash("g", F.col("rss_guid")), key_hash("u", F.col("url")))
        h = articles.select("id", F.explode(keys).alias("h"))
        return h.select("h", "id", self.bucket_of(F.col("h")).alias("bucket"))

    def add(self, articles: DataFrame) -> None:
        """Append the keys of new and changed articles: one file per bucket that has any, sorted by h."""
        rows = self._rows(articles)
        rows.repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("append").partitionBy("bucket").parquet(self.root)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Index rows; only the folders of ``buckets`` that exist are listed and opened."""
        wanted = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket={wanted}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        folders = [f.getPath().toString() for f in found or []]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.root).parquet(*folders)

    def candidates(self, keys: DataFrame) -> DataFrame:
        """Ids of the articles that may have one of the (guid, link) keys (a materialised frame)."""
        h = keys.select(F.explode(F.array(key_hash("g", F.col("guid")), key_hash("u", F.col("link")))).alias("_h"))
        h = h.filter("_h is not null").distinct()
        # at most 2 ** bits small numbers; from half of them on, the whole index is read
        touched = [r[0] for r in h.select(self.bucket_of(F.col("_h"))).distinct().collect()]
        rows = self.read(None if len(touched) > 1 << (self.bits - 1) else sorted(touched))
        return materialize(rows.join(h, F.col("h") == F.col("_h"), "left_semi").select("id").distinct())

    def lookup(self, rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """From (guid, link) keys to the stored rows that have one of them; ``rows`` maps ids to rows
        (``SnapshotStore.rows``). Only rows whose real guid or url is asked for are returned."""

        def found(keys: DataFrame) -> DataFrame:
            stored = rows(self.candidates(keys))
            guids, links = keys.select(F.col("guid").alias("_g")).distinct(), keys.select(F.col("link").alias("_l")).distinct()
            hit = stored.join(guids, F.col("rss_guid") == F.col("_g"), "left").join(links, F.col("url") == F.col("_l"), "left")
            return hit.filter("_g is not null or _l is not null").drop("_g", "_l")

        return found
