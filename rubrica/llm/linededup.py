"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line stripped of blanks at both ends with A-Z lowered; keys of at least ``LEAST``
code points are kept as 128-bit hashes. Known keys lie in *runs*: tables of (hash, owner) bucketed and
sorted by hash. Documents come in batches. A batch shuffles its own distinct hashes once, to the
runs' buckets, and is merge-joined with run after run, none of which is shuffled or sorted again by a
shuffle; a hash found in no run (the anti join) goes into the batch's own run, with the smallest
document of the batch as its owner. When ``FAN_IN`` runs of a level are there, they are merged into one
of the next level, so that N batches leave about log N runs and a hash is rewritten log N times.

A key found in two documents or more stays in its owner and loses all its lines elsewhere. The owner is
the document of the earliest batch, there the smallest doc_id; ``drop_repeated_lines`` cuts its input
into batches of ascending doc_id, so the owner is the smallest of all.

State lives in the folder of the runs: each change of the levels is a new version of a manifest, and
``LineRuns`` opened on a folder goes on from its last version. A batch lost halfway has changed nothing.

NULL or empty texts are one empty line; rows with one doc_id are one document, rows with a NULL doc_id
are one document too, which comes after all others; a repeated row gets the same answer as the first; a
document's own repeats of a line stay where it owns the key; all lines may go, which leaves an empty text;
an empty table gives an empty result. Extra columns pass through ``drop_repeated_lines``, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.llm.common import BLANKS, ascii_lower, read, text_of, written
from rubrica.session import fresh_path

#: Least code points of a key.
LEAST = 10
#: Batches that ``drop_repeated_lines`` cuts its input into, by doc_id.
BATCHES = 4
#: Runs of one level that are merged into one of the next.
FAN_IN = 2
#: Stands for a NULL doc_id.
LAST = (1 << 63) - 1
HASH = ["h1", "h2"]
ROW = ["doc", "t1", "t2"]


def _hashes(column: Column, first: str, second: str) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(column).alias(first), F.xxhash64(F.lit(1), column).alias(second)]


def row_key(doc: str, text: str) -> list[Column]:
    """Columns that tell rows apart: the document and the hash of its text."""
    return [F.coalesce(F.col(doc).cast("bigint"), F.lit(LAST)).alias("doc"), *_hashes(text_of(text), "t1", "t2")]


def line_hashes(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, t1, t2, pos, h1, h2): every line whose key is long enough."""
    keys = F.transform(F.split(ascii_lower(text_of(text)), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    lines = docs.select(*row_key(doc, text), F.posexplode(keys).alias("pos", "key"))
    return lines.where(F.length("key") >= least).select(*ROW, "pos", *_hashes(F.col("key"), *HASH))


class LineRuns:
    """Levels of sorted runs of line hashes under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.version, self.runs, self.buckets = 0, [], buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._resume()

    def _resume(self) -> None:
        """Take up the last version of the manifest, if there is one."""
        home = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not home.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(home):
            return
        rows = self.spark.read.parquet(f"{self.path}/manifest").collect()  # a row per run and version
        self.version = max(r["version"] for r in rows)
        last = [r for r in rows if r["version"] == self.version]
        self.buckets = last[0]["buckets"]
        self.runs = [(r["level"], r["run"]) for r in sorted(last, key=lambda r: r["place"])]

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """A new version of the manifest; the old run files stay for readers of older versions."""
        self.version, self.runs = self.version + 1, runs
        rows = [(k, level, run, self.buckets) for k, (level, run) in enumerate(runs)]
        table = self.spark.createDataFrame(rows, "place int, level int, run string, buckets int")
        table.coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")

    def _write(self, df: DataFrame) -> str:
        """Write a run, bucketed and sorted by hash; it joins by hash without a shuffle."""
        name = f"run_{uuid.uuid4().hex}"
        where = df.write.format("parquet").option("path", f"{self.path}/{name}")
        where.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog forgets the name, the files stay
        return name

    def _read(self, run: str) -> DataFrame:
        name = f"read_{uuid.uuid4().hex}"
        columns = "h1 BIGINT, h2 BIGINT, owner BIGINT, fresh BOOLEAN, contested BOOLEAN"
        layout = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {layout} LOCATION '{self.path}/{run}'")
        df = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return df.where("fresh").select(*HASH, "owner")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of (doc, h1, h2) and return its contested keys: (h1, h2, owner).

        A key is contested if an earlier batch holds it or several documents of this one do.
        """
        own = lines.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        for k, (_, run) in enumerate(self.runs):
            known = self._read(run).withColumnRenamed("owner", f"owner_{k}")
            own = own.join(known.hint("merge"), HASH, "left")
        earlier = F.coalesce(*[F.col(f"owner_{k}") for k in range(len(self.runs))], F.lit(None).cast("bigint"))
        marked = own.select(
            *HASH,
            F.coalesce(earlier, "first").alias("owner"),
            earlier.isNull().alias("fresh"),
            (earlier.isNotNull() | (F.col("last") > F.col("first"))).alias("contested"),
        )
        name = self._write(marked)
        self._commit(self._compacted([*self.runs, (0, name)]))
        # read by path: the layout by bucket would keep a hot key of the other side in one task
        contested = self.spark.read.schema(marked.schema).parquet(f"{self.path}/{name}").where("contested")
        return contested.select(*HASH, "owner")

    def _compacted(self, runs: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Merge ``fan_in`` runs of a level into one of the next, as long as a level has that many."""
        while True:
            level = runs[-1][0]
            same = [name for at, name in runs if at == level]
            if len(same) < self.fan_in:
                return runs
            runs = [r for r in runs if r[0] != level] + [(level + 1, self._merged(same))]

    def _merged(self, names: list[str]) -> str:
        """One run of several that share no hash, by merge joins of their buckets."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("owner", "other").hint("merge"), HASH, "full")
            return both.select(*HASH, F.coalesce("owner", "other").alias("owner"))

        whole = reduce(merge, [self._read(name) for name in names])
        return self._write(whole.select(*HASH, "owner", F.lit(True).alias("fresh"), F.lit(False).alias("contested")))


def _cuts(docs: DataFrame, doc: str, batches: int) -> list[int]:
    """Ids at which batches of about equal size end."""
    shares = [k / batches for k in range(1, batches)]
    if not shares:
        return []
    found = docs.agg(F.percentile_approx(F.col(doc).cast("bigint"), shares, 10_000)).first()[0]
    return sorted(set(found or []))


def repeated_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, batches: int = BATCHES, runs: LineRuns | None = None
) -> DataFrame:
    """(doc, t1, t2, dropped): places of the lines to drop, ascending, for each row that loses any."""
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, fresh_path(spark, "line-runs"))
    cuts = _cuts(docs, doc, batches)
    number = sum((F.when(F.col("doc") > F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
    lines = line_hashes(docs, doc, text, least).withColumn("batch", number)
    path = fresh_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    found = []
    for batch in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == batch).drop("batch")
        hit = own.join(runs.add(own), HASH).where("doc <> owner").select(*ROW, "pos")
        found.append(written(hit, "line-drops"))
    dropped = reduce(DataFrame.unionAll, found).groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return written(dropped, "line-drops")


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped places, joined again; linear in the text."""
    starts, ends = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(lines)))
    parts = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(parts), "\n")


def drop_repeated_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, batches: int = BATCHES, runs: LineRuns | None = None
) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and the columns n_lines (before) and n_dropped.

    Columns of ``docs`` with these two names are replaced.
    """
    dropped = repeated_lines(docs, doc, text, least, batches, runs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(*row_key(doc, text), row)
    both = keyed.join(dropped, ROW, "left")
    own = F.split(text_of(f"row.`{text}`"), "\n")
    fields = [
        F.when(F.col("dropped").isNull(), F.col(f"row.`{c}`")).otherwise(kept_text(own, F.col("dropped"))).alias(c)
        if c == text
        else F.col(f"row.`{c}`").alias(c)
        for c in names
    ]
    count = F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint")
    return both.select(*fields, F.size(own).cast("bigint").alias("n_lines"), count.alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, split[pos] AS line, len(split) AS n
  FROM (SELECT doc_id, split, unnest(range(1, len(split) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents))
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
