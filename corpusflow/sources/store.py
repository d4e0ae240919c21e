"""Versioned Parquet snapshots of a table keyed by a long ``id`` (articles, comments).

Layout under ``root``::

    data/v<N>-<random>/part=<K>/*.parquet   rows with id in [K * part_rows, (K + 1) * part_rows)
    _manifests/v<N>.json                    {"version": N, "batches": {...}, "parts": {"K": "v<N>-<random>"}}

A commit rewrites only the id-range parts that hold changed rows, into a new data folder,
and then creates the next manifest, which points untouched parts at their older folders.
Manifests and data folders are created once and never overwritten or removed. The current
version is the highest manifest that can be read, so a reader always finds a complete one;
a manifest that a lost writer left half-written is passed over. Creating a manifest that
exists fails: of two writers one gets a conflict error and the other's rows stay.
New ids are appended at the top of the range, and updates in a feed mostly hit recent
articles, so a batch touches few parts even when the table is very large.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.joins import broadcast_if_small

ARTICLE_SCHEMA = (
    "id long, source string, rss_guid string, title string, url string, content string, content_preview string, "
    "published_at timestamp, embedding array<float>, created_at timestamp, updated_at timestamp"
)


class CommitConflict(RuntimeError):
    """Another writer committed first; plan the changes again on the new version."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, part_rows: int = 1_000_000, files_per_part: int = 16,
                 schema: str = ARTICLE_SCHEMA):
        self.spark = spark
        self.schema = schema
        self.columns = T.StructType.fromDDL(schema).names
        self.root = root.rstrip("/")
        self.part_rows = part_rows
        # a part of a million articles is several GB: it is written by this many tasks
        self.files_per_part = files_per_part
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- small metadata files
    def _create_text(self, path: str, text: str) -> None:
        """Create a file that must not exist yet."""
        try:
            out = self._fs.create(self._Path(path), False)
        except Exception as e:
            raise CommitConflict(f"{path} exists: another writer committed this version") from e
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def _read_text(self, path: str) -> str | None:
        p = self._Path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        reader = self.spark.sparkContext._jvm.java.io.BufferedReader(
            self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        reader.close()
        return "\n".join(lines)

    def _numbers(self) -> list[int]:
        """Numbers of all manifests, the highest first."""
        folder = self._Path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n))), reverse=True)

    def current_version(self) -> int:
        return self.manifest()["version"]

    def manifest(self, version: int | None = None) -> dict:
        for v in self._numbers() if version is None else [version] * (version > 0):
            try:
                return json.loads(self._read_text(f"{self.root}/_manifests/v{v}.json") or "")
            except ValueError:
                if version is not None:
                    raise
        return {"version": 0, "batches": {}, "parts": {}, "max_id": 0}

    # ------------------------------------------------------------- reads and commits
    def max_id(self) -> int:
        """Highest id ever committed (kept in the manifest, no scan)."""
        return int(self.manifest().get("max_id") or 0)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        paths = [f"{self.root}/data/{d}/part={k}" for k, d in sorted(m["parts"].items(), key=lambda kv: int(kv[0]))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(*self.columns)

    def rows(self, ids: DataFrame) -> DataFrame:
        """The stored rows with these ids (a materialised frame), from the parts that hold them."""
        m = self.manifest()
        touched = [str(r[0]) for r in ids.select(self.part_of().alias("part")).distinct().collect()]
        paths = [f"{self.root}/data/{m['parts'][k]}/part={k}" for k in sorted(touched) if k in m["parts"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(self.schema).parquet(*paths).select(*self.columns)
        return stored.join(broadcast_if_small(ids.select("id"), ready=True), "id", "left_semi")

    def part_of(self, id_col="id"):
        return F.floor(F.col(id_col) / F.lit(self.part_rows)).cast("long")

    def committed(self, batch: tuple[str, int], m: dict | None = None) -> bool:
        """Whether this batch of a streaming query, or a later one, has been committed."""
        return batch[1] <= (m or self.manifest())["batches"].get(batch[0], -1)

    def run_log(self, batch: tuple[str, int], name: str) -> str:
        """The folder of one batch's counters or issues."""
        return f"{self.root}/_runs/{name}/query={batch[0]}/batch={batch[1]}"

    def runs(self, name: str) -> DataFrame:
        """Counters or issues of all batches so far, with ``query`` and ``batch``."""
        return self.spark.read.parquet(f"{self.root}/_runs/{name}")

    def commit(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Apply changed rows (inserted and updated, full rows keyed by id).

        ``batch`` is (id of the streaming query, number of its batch); the manifest keeps the
        highest number committed by each query. Returns the new version, or the current one
        when there is nothing to write or the query's batch was committed before (a replay).
        Raises ``CommitConflict`` if another writer commits the same version first.
        """
        m = self.manifest()
        if batch is not None and self.committed(batch, m):
            return m["version"]
        changes = changes.select(*self.columns).withColumn("part", self.part_of())
        # the touched part numbers: at most (table size / part_rows) small integers
        touched = sorted(r[0] for r in changes.select("part").distinct().collect())
        if not touched:
            return m["version"]
        # past every manifest that was begun, also one that a lost writer left unreadable
        new_v = max([0, *self._numbers()]) + 1
        folder = f"v{new_v}-{uuid.uuid4().hex[:12]}"
        old_paths = [f"{self.root}/data/{m['parts'][str(k)]}/part={k}" for k in touched if str(k) in m["parts"]]
        rewrite = changes
        if old_paths:
            old = self.spark.read.schema(self.schema).parquet(*old_paths).withColumn("part", self.part_of())
            kept = old.join(broadcast_if_small(changes.select("id"), ready=True), "id", "left_anti").select(*self.columns, "part")
            rewrite = kept.unionByName(changes)
        salt = F.pmod(F.xxhash64("id"), F.lit(self.files_per_part))
        rewrite.repartition(F.col("part"), salt).write.partitionBy("part").parquet(
            f"{self.root}/data/{folder}")
        parts = dict(m["parts"])
        for k in touched:
            parts[str(k)] = folder
        new_max = changes.agg(F.max("id")).first()[0]
        max_id = max(int(m.get("max_id") or 0), int(new_max or 0))
        batches = dict(m["batches"])
        if batch is not None:
            batches[batch[0]] = batch[1]
        if self.manifest()["version"] != m["version"]:
            raise CommitConflict(f"version {m['version']} is no longer the current one")
        self._create_text(f"{self.root}/_manifests/v{new_v}.json", json.dumps(
            {"version": new_v, "batches": batches, "parts": parts, "max_id": max_id}, sort_keys=True))
        return new_v
