"""Judge scores kept from run to run.

A cache is a folder of appends and snapshots: ``kind=append/id=<n>`` holds new scores, ``kind=snapshot/id=<n>``
the newest score per request of all appends up to ``n``. A reader takes the last snapshot and the appends behind
it, so a reader and a writer need not know of each other, and a job that is lost halfway leaves nothing to read.

Each write goes to a folder of its own, ``bucket=<buckets>-<time>``, bucketed by the request key: rows that ``deal``
has dealt out into as many parts join the scores without moving them. Folders of another number of buckets, and
those of an older layout (``bucket=<n>``, a folder per bucket), are read by their path.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SCORES = "request_key string, score double, scored_at double"
_TABLE = f"{_SCORES}, kind string, id bigint, bucket string"


class ScoreCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        home = spark._jvm.org.apache.hadoop.fs.Path(path)  # a table would place a relative path elsewhere
        self.path = home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString()
        self.spark, self.buckets = spark, buckets

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(_TABLE).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _TABLE)

    def _bucketed(self, folder: str) -> DataFrame:
        name, place = f"scores_{uuid.uuid4().hex}", folder.replace("\\", "\\\\").replace("'", "\\'")
        layout = f"CLUSTERED BY (request_key) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {name} ({_SCORES}) USING parquet {layout} LOCATION '{place}'")
        df = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog forgets the name, the files stay
        return df

    def rows(self) -> DataFrame:
        """(request_key, score, scored_at) of the last snapshot and all later appends."""
        table = self._table()
        folders = table.select("kind", "id", "bucket").distinct().collect()
        parts, other = [], []
        for kind, number, bucket in _chosen([tuple(f) for f in folders]):
            if bucket.startswith(f"{self.buckets}-"):
                parts.append(self._bucketed(f"{self.path}/kind={kind}/id={number}/bucket={bucket}"))
            else:
                other.append((F.col("kind") == kind) & (F.col("id") == number) & (F.col("bucket") == bucket))
        if other or not parts:
            parts.append(table.where(reduce(Column.__or__, other, F.lit(False))))
        # a union knows its parts' layout only under new names: a filter on a key changes whether it may be NULL
        named = [part.select(F.col("request_key").alias("key"), "score", "scored_at") for part in parts]
        return reduce(DataFrame.union, named).withColumnRenamed("key", "request_key")

    def fresh(self, now: float | None = None, ttl: float = 3600.0) -> DataFrame:
        """(request_key, cached_score): the newest score of each request that is at most ``ttl`` seconds old."""
        now = time.time() if now is None else now
        recent = self.rows().where(F.col("scored_at") >= F.lit(now - ttl))
        return recent.groupBy("request_key").agg(F.max_by("score", "scored_at").alias("cached_score"))

    def append(self, scores: DataFrame, dealt: bool = False) -> None:
        """Add rows of (request_key, score, scored_at); those that still lie as ``deal`` left them are not moved."""
        rows = scores.select("request_key", "score", "scored_at")
        if not dealt:
            rows = rows.repartition(self.buckets, "request_key")
        self._write(rows, "append", time.time_ns() // 1000)

    def compact(self, now: float | None = None, ttl: float = 3600.0) -> None:
        """Write a snapshot of the newest score of each request, without those older than ``ttl`` seconds."""
        now = time.time() if now is None else now
        last = self._table().agg(F.max("id")).first()[0]
        if last is None:
            return
        recent = self.rows().where(F.col("scored_at") >= F.lit(now - ttl))
        newest = recent.groupBy("request_key").agg(F.max_by("score", "scored_at").alias("score"), F.max("scored_at").alias("scored_at"))
        self._write(newest.repartition(self.buckets, "request_key"), "snapshot", last)  # bucketed scores stay in place

    def deal(self, df: DataFrame, key: Column) -> DataFrame:
        """Deal rows out as the scores lie; ``request_key`` is worked out from the other columns where they arrive."""
        return df.repartition(self.buckets, key).withColumn("request_key", key)

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        folder = f"{self.path}/kind={kind}/id={number}/bucket={self.buckets}-{time.time_ns() // 1000}"
        name = f"scores_{uuid.uuid4().hex}"
        where = rows.write.format("parquet").option("path", folder).option("compression", "zstd")
        where.bucketBy(self.buckets, "request_key").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")


def _chosen(folders: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
    """Of all (kind, id, bucket): the last snapshot, as written last, and all later appends."""

    def written(bucket: str) -> int:
        return int(bucket.partition("-")[2] or 0)

    last = max((number for kind, number, _ in folders if kind == "snapshot"), default=None)
    snapshots = [f for f in folders if f[:2] == ("snapshot", last)]
    newest = max((written(f[2]) for f in snapshots), default=0)
    later = [f for f in folders if f[0] == "append" and (last is None or f[1] > last)]
    return later + [f for f in snapshots if written(f[2]) == newest]
