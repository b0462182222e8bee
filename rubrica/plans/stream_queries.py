"""Streaming queries run to the end of the available data; results come from their sink tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.plans import run_queries as batch
from rubrica.plans.inputs import read, table_of
from rubrica.session import fresh_path
from rubrica.streaming import live

_METRICS = ["reward_mean", "kl_divergence", "gpu_utilization"]


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of metric rows; the event id stands for the step.

    A micro-batch takes at most 1 GB of files, which bounds what a run brings in one go.
    """
    schema = read(spark, sf, "events").schema
    # a pattern finds the table whether it is one file or a folder of part files
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(1 << 30))
    stream = reader.parquet(f"{sf}/events[.]parquet")
    return table_of(stream, "metrics").where("NOT is_event").drop("is_event", "event")


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _to_table(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """All rows the stream emitted, with the number of their micro-batch."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    _finish(writer.option("checkpointLocation", fresh_path(spark, "checkpoint")))
    return spark.read.parquet(path)


def stream_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "metrics")
    _finish(live.metric_sink(_metrics(spark, sf), path, fresh_path(spark, "checkpoint"), "seq"))
    return spark.read.parquet(path).groupBy("experiment").agg(
        F.count("*").alias("n"), F.max_by("reward_mean", "seq").alias("latest")
    )


_SINK = f"{batch._STEPS} SELECT experiment, count(*) AS n, arg_max(reward_mean, seq) AS latest FROM steps GROUP BY experiment"


def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    summary = live.running_summary(_metrics(spark, sf), _METRICS, "seq")
    _finish(live.summary_sink(summary, path, fresh_path(spark, "checkpoint"), refresh=None))
    out = live.newest_summary(spark, path)
    return batch._rounded(out, [f"{m}_{s}" for m in _METRICS for s in ("mean", "std")])


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from rubrica.operators.runs import unpivot

    long = unpivot(_metrics(spark, sf), _METRICS, "seq")
    out = _to_table(live.live_alerts(long), "append", "alerts")
    return out.select("experiment", "seq", "rule", "value")


_ALERTS = f"""{batch._STEPS} SELECT experiment, seq, 'kl_too_high' AS rule, kl_divergence AS value FROM steps
WHERE kl_divergence > 1e-1 UNION ALL
SELECT experiment, seq, 'gpu_low_utilization', gpu_utilization FROM steps WHERE gpu_utilization < 50"""


def stream_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    stream = _metrics(spark, sf).select("experiment", "seq", "reward_mean")
    out = live.early_stop(stream, "reward_mean", 8, 2.5, "max", "seq")
    states = _to_table(out, "update", "early_stop")
    fields = [c for c in out.columns if c != "experiment"]
    newest = states.groupBy("experiment").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return newest.select("experiment", "s.*")


def stream_stagnation(spark: SparkSession, sf: str) -> DataFrame:
    stream = _metrics(spark, sf).select("experiment", "seq", "reward_mean")
    out = live.stagnation(stream, "reward_mean", 10, "seq")
    return _to_table(out, "append", "stagnation").select("experiment", F.col("step").alias("seq"), "since_best")


#: Parts in which late arrivals are written, and how late a row may come: a part of the month and a day.
_PARTS, _LATE = 4, "9 days"


def _arrivals(spark: SparkSession, sf: str, again: bool = True) -> DataFrame:
    """Events as a stream in order of arrival: up to a day late, in any order within a part; ``again``: a third of them twice.

    The last row lies a year ahead; it has no run and closes all that is open.
    """
    events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.withColumn("_at", F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400)))
    repeats = late.where("event_id % 3 = 0").withColumn("_at", F.col("_at") + F.pmod(F.xxhash64("ts"), F.lit(3_600)))
    rows = late.unionByName(repeats) if again else late
    first, last = rows.agg(F.min("_at"), F.max("_at")).first()
    path = fresh_path(spark, "arrivals")
    width = (last - first) // _PARTS + 1
    for part in range(_PARTS):  # one after the other: the stream takes files by age
        own = rows.where(F.floor((F.col("_at") - first) / width) == part)
        own.drop("_at").write.parquet(f"{path}/part={part}")
    closing = events.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(last + 366 * 86_400))).withColumn("user_id", F.lit(None).cast("bigint"))
    closing.write.parquet(f"{path}/part={_PARTS}")
    schema = events.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(f"{path}/part=*")
    run = F.concat(F.lit("run_"), F.col("user_id").cast("string"))
    return stream.where("user_id IS NULL OR event_type <> 'signup'").select(
        F.coalesce(run, F.lit("")).alias("experiment"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("reward_mean"), F.col("props").alias("response")
    )


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Rows delivered late and more than once, each kept once."""
    path = fresh_path(spark, "distinct")
    _finish(live.metric_sink(live.distinct_metrics(_arrivals(spark, sf), "ts", ["seq"], _LATE), path, fresh_path(spark, "checkpoint"), "seq"))
    found = spark.read.schema("seq bigint, reward_mean double, experiment string").parquet(path).where("experiment LIKE 'run%'")
    return found.groupBy("experiment").agg(F.count("*").alias("n"), F.max_by("reward_mean", "seq").alias("latest"))


def stream_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Batch metrics per day of event time over rows that come late and more than once."""
    out = live.bucketed_metrics(_arrivals(spark, sf).withColumnRenamed("reward_mean", "score"), "ts", ["seq"], "1 day", lateness=_LATE)
    rows = _to_table(out, "append", "buckets").drop("batch")
    rows = batch._rounded(rows, ["reward_mean", "reward_std", "response_length_mean", "response_length_std"])
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


_BUCKETS = """SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS responses, round(avg(value), 6) AS reward_mean,
 round(stddev_samp(value), 6) AS reward_std, max(value) AS reward_max, min(value) AS reward_min,
 round(avg(length(props)), 6) AS response_length_mean, round(stddev_samp(length(props)), 6) AS response_length_std
FROM events WHERE event_type <> 'signup' GROUP BY 1"""


def late_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Early stop over rows in any order, each given once."""
    out = live.early_stop(_arrivals(spark, sf, again=False), "reward_mean", 8, 2.5, "max", "seq", "ts", _LATE, 5 * 86_400_000)
    states = _to_table(out, "update", "early_stop").where("experiment LIKE 'run%'")
    fields = [c for c in out.columns if c != "experiment"]
    newest = states.groupBy("experiment").agg(F.max_by(F.struct(*fields), "rows").alias("s"))
    return newest.select("experiment", "s.*")


def late_stagnation(spark: SparkSession, sf: str) -> DataFrame:
    """Stagnant rows over rows in any order."""
    out = live.stagnation(_arrivals(spark, sf, again=False), "reward_mean", 10, "seq", "ts", _LATE, 5 * 86_400_000)
    rows = _to_table(out, "append", "stagnation").where("experiment LIKE 'run%'")
    return rows.select("experiment", F.col("step").alias("seq"), "since_best")


_STAGNANT = batch._STAGNATION.replace("SELECT experiment, step, step - max", "SELECT experiment, seq, step - max")

QUERIES = {
    "stream_metric_sink": stream_sink,
    "stream_summary": stream_summary,
    "stream_alerts": stream_alerts,
    "stream_early_stop": stream_early_stop,
    "stream_stagnation": stream_stagnation,
    "stream_distinct": stream_distinct,
    "stream_buckets": stream_buckets,
    "late_early_stop": late_early_stop,
    "late_stagnation": late_stagnation,
}

SQL = {
    "stream_metric_sink": _SINK,
    "stream_summary": batch.SQL["run_summaries"],
    "stream_alerts": _ALERTS,
    "stream_early_stop": batch.SQL["early_stop"],
    "stream_stagnation": f"SELECT experiment, seq, since_best FROM ({_STAGNANT}) WHERE stagnant",
    "stream_distinct": _SINK,
    "stream_buckets": _BUCKETS,
    "late_early_stop": batch.SQL["early_stop"],
    "late_stagnation": f"SELECT experiment, seq, since_best FROM ({_STAGNANT}) WHERE stagnant",
}
