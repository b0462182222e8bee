"""Readers and writers: tables written in a format, read back, and compared with the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rubrica.operators import prep, runs
from rubrica.plans import run_queries, sqltext as q
from rubrica.plans.inputs import read
from rubrica.session import fresh_path
from rubrica.sources import datasets, logs
from rubrica.streaming import live
from rubrica.streaming.tail import Folder

_DOCS = "doc_id bigint, text string, lang string"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text", "lang")


def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of one JSON array each, turned into Parquet and loaded by suffix."""
    path = fresh_path(spark, "arrays")
    part = F.floor(F.col("doc_id") / 200).cast("bigint").alias("part")
    arrays = _docs(spark, sf).groupBy(part).agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    table_path = datasets.json_to_parquet(spark, f"{path}/part=*", f"{path}.parquet", _DOCS)
    return datasets.load_dataset(spark, table_path).select("doc_id", "text", "lang")


#: Appended to every text: all that a reader of blocks could take for structure.
_NOISE = '"}], [{\\"{}:\\\\'


def json_array_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as array files of 50,000 elements, each read by several tasks.

    Every file is written by a task of its own, element after element.
    """
    path = fresh_path(spark, "blocks")
    rows = _docs(spark, sf).withColumn("file", F.floor(F.col("doc_id") / 50_000))
    element = F.to_json(F.struct("doc_id", F.concat("text", F.lit(_NOISE)).alias("text"), "lang"))
    # brackets come from the rows' places: a union with rows of brackets may reach the files in several tasks
    along = Window.partitionBy("file").orderBy("doc_id")
    opened = F.when(F.row_number().over(along) == 1, "[").otherwise(",")
    closed = F.when(F.lead(F.lit(True)).over(along).isNull(), "]").otherwise("")
    rows.select("file", F.concat(opened, element, closed).alias("value")).write.partitionBy("file").text(path)
    return datasets.read_json(spark, f"{path}/file=*", _DOCS, split=True)


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents from Parquet to JSON lines, loaded by suffix; a null stays a null."""
    path = fresh_path(spark, "lines")
    with_null = _docs(spark, sf).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    with_null.write.parquet(f"{path}.parquet")
    lines = datasets.parquet_to_json(spark, f"{path}.parquet", f"{path}.jsonl")
    raw = datasets.read_raw_lines(spark, lines)
    nulls = raw.agg(F.count(F.when(F.contains("value", F.lit('"lang":null')), 1)).alias("explicit_nulls"))
    loaded = datasets.load_dataset(spark, lines, _DOCS)
    counted = loaded.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return counted.unionByName(nulls.select(F.lit("explicit nulls").alias("lang"), F.col("explicit_nulls").alias("n"), F.lit(0).cast("bigint").alias("chars")))


_LINES = """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
 FROM (SELECT CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, text FROM documents) GROUP BY lang
UNION ALL SELECT 'explicit nulls', count(*) FILTER (doc_id % 3 = 0), 0 FROM documents"""


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation results written as CSV, Parquet and JSON and read back."""
    path = fresh_path(spark, "results")
    kinds = {"csv": datasets.load_dataset, "parquet": datasets.load_dataset, "json": datasets.read_json_lines}
    out = None
    for kind, reader in kinds.items():
        written = datasets.write_results(_docs(spark, sf), f"{path}.{kind}")
        back = reader(spark, written, _DOCS) if kind != "parquet" else reader(spark, written)
        rows = back.select(F.lit(kind).alias("kind"), "doc_id", "text", "lang")
        out = rows if out is None else out.unionByName(rows)
    return out


_RESULTS = " UNION ALL ".join(f"SELECT '{k}' AS kind, doc_id, text, lang FROM documents" for k in ("csv", "parquet", "json"))


def sample_files(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns logged as samples and read back from the sample log."""
    path = fresh_path(spark, "samples")
    rows = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("step"), F.col("role").alias("timestamp"), F.col("text").alias("response"), F.col("turn").alias("extra")
    )
    logs.append_samples(rows, path)
    kinds = {"step": "bigint", "extra": "bigint", "timestamp": "string", "response": "string"}
    return logs.wide_metrics(logs.read_samples(spark, path).drop("pos", "file", "experiment"), kinds)


def summary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Closing rows of all runs written to the summary table and read back."""
    path = fresh_path(spark, "summaries")
    logs.write_summary(runs.run_summary(run_queries.steps(spark, sf), "seq"), path)
    found = logs.read_summaries(spark, path)
    return found.select(
        F.col("experiment_name").alias("experiment"),
        "total_epochs",
        "total_steps",
        "duration_seconds",
        F.col("final_metrics")["reward_mean"].alias("final_reward"),
    )


_SUMMARY = f"{run_queries._STEPS} " + """SELECT experiment, arg_max(epoch, seq) AS total_epochs,
 arg_max(step, seq) AS total_steps, max(timestamp) - min(timestamp) AS duration_seconds,
 arg_max(reward_mean, seq) AS final_reward FROM steps GROUP BY experiment"""


def checkpoint_files(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoint rows of every fifth step written, read back, and the newest three kept."""
    path = fresh_path(spark, "checkpoints")
    rows = runs.every_n_steps(run_queries.steps(spark, sf), 5).select(
        "experiment", "step", F.lit("t").alias("timestamp"), F.create_map(F.lit("reward"), F.col("reward_mean")).alias("metrics")
    )
    logs.append_checkpoints(rows, path)
    kept = runs.kept_checkpoints(logs.read_checkpoints(spark, path), 5, 3)
    return kept.select("experiment", "step", F.col("metrics")["reward"].alias("reward"))


_CHECKPOINTS = f"""{run_queries._STEPS}, c AS (SELECT experiment, step, reward_mean AS reward,
 row_number() OVER (PARTITION BY experiment ORDER BY step DESC) AS age FROM steps WHERE step % 5 = 0)
SELECT experiment, step, reward FROM c WHERE age <= 3"""


def bounded_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns logged in three appends, each in order of the conversation; a role's log ends at 20."""
    path = fresh_path(spark, "samples")
    turns = read(spark, sf, "conversations")
    for third in range(3):
        rows = turns.where(F.col("conv_id") % 3 == third).select(
            F.col("role").alias("experiment"), F.col("conv_id").alias("step"), F.col("turn").alias("extra"), F.col("text").alias("response")
        )
        logs.append_samples(rows, path, max_samples=20, order=["step", "extra"])
    kinds = {"experiment": "string", "step": "bigint", "extra": "bigint", "response": "string"}
    return logs.wide_metrics(logs.read_samples(spark, path).drop("pos", "file", "experiment"), kinds)


_BOUNDED = """SELECT experiment, step, extra, response FROM (SELECT role AS experiment, conv_id AS step, turn AS extra, text AS response,
 row_number() OVER (PARTITION BY role ORDER BY conv_id % 3, conv_id, turn) AS place FROM conversations) WHERE place <= 20"""


def pruned_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoint rows of every fifth step taken in by three writers in turn; the newest three are held."""
    path = fresh_path(spark, "checkpoints")
    steps = run_queries.steps(spark, sf)
    rows = steps.select("experiment", "step", F.lit("t").alias("timestamp"), F.create_map(F.lit("reward"), F.col("reward_mean")).alias("metrics"))
    for part in range(3):
        logs.keep_checkpoints(rows.where(F.floor(F.col("step") / 25) % 3 == part), path, save_freq=5, keep=3)
    return logs.read_checkpoints(spark, path).select("experiment", "step", F.col("metrics")["reward"].alias("reward"))


def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """Run histories exported as Parquet, CSV and JSON lines and read back."""
    path = fresh_path(spark, "history")
    rows = run_queries.steps(spark, sf).select("experiment", "step", "reward_mean")
    rows.write.parquet(f"{path}.parquet")
    rows.write.option("header", True).csv(f"{path}.csv")
    rows.write.json(f"{path}.jsonl")
    out = None
    for kind in ("parquet", "csv", "jsonl"):
        back = logs.read_history(spark, f"{path}.{kind}")
        found = back.groupBy("experiment").agg(F.count("*").alias("n"), F.max_by("reward_mean", "step").alias("latest"))
        found = found.withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


def history_table(spark: SparkSession, sf: str) -> DataFrame:
    """Run histories exported as Parquet, CSV and JSON lines, read as the metric table."""
    path = fresh_path(spark, "history")
    rows = run_queries.steps(spark, sf).selectExpr("experiment AS run", "step AS _step", "reward_mean", "kl_divergence AS `loss/kl`", "'note' AS note")
    rows.write.parquet(f"{path}.parquet")
    rows.write.option("header", True).csv(f"{path}.csv")
    rows.write.json(f"{path}.jsonl")
    out = None
    for kind in ("parquet", "csv", "jsonl"):
        found = logs.history_metrics(spark, f"{path}.{kind}").select(
            F.lit(kind).alias("kind"), "experiment", "step", F.col("metrics")["reward_mean"].alias("reward"), F.col("metrics")["loss/kl"].alias("kl"), F.size("metrics").alias("n")
        )
        out = found if out is None else out.unionByName(found)
    return out


_TABLE = f"{run_queries._STEPS} " + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, experiment, step, reward_mean AS reward, kl_divergence AS kl,"
    " ((reward_mean IS NOT NULL)::INTEGER + (kl_divergence IS NOT NULL)::INTEGER)::INTEGER AS n FROM steps"
    for k in ("parquet", "csv", "jsonl")
)

_HISTORY = f"{run_queries._STEPS} " + " UNION ALL ".join(
    f"SELECT experiment, count(*) AS n, arg_max(reward_mean, step) AS latest, '{k}' AS kind FROM steps GROUP BY experiment"
    for k in ("parquet", "csv", "jsonl")
)


def appended_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows appended in three batches of unequal size; latest, elapsed time and history by line order.

    Every seventh value is not a number, as a diverging run logs it.
    """
    path = fresh_path(spark, "appended")
    rows = run_queries.steps(spark, sf)
    value = F.when(F.col("step") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("reward_mean"))
    rows = rows.select("experiment", "step", "epoch", "timestamp", F.create_map(F.lit("reward_mean"), value).alias("logs"))
    for low, high in ((0, 3), (3, 11), (11, None)):
        logs.append_metrics(rows.where((F.col("step") > low) & (F.lit(True) if high is None else F.col("step") <= high)), path)
    metrics = logs.read_metrics(spark, path)
    wide = logs.wide_metrics(metrics, {"step": "bigint", "timestamp": "double"}).drop("file")
    last = runs.latest_metrics(wide, "pos").select("experiment", "step", F.round("elapsed_time", 6).alias("elapsed"))
    stats = runs.summary_stats_long(logs.long_metrics(metrics)).where("metric = 'reward_mean'")
    stats = stats.select("experiment", F.round("mean", 6).alias("mean"), "values", (F.col("latest") + 0.0).alias("latest"))
    return last.join(stats, "experiment", "left")


_APPENDED = f"""{run_queries._STEPS} SELECT experiment, max(step) AS step,
 round(arg_max(timestamp, step) - arg_min(timestamp, step), 6) AS elapsed,
 round(avg(reward_mean) FILTER (step % 7 <> 0), 6) AS mean,
 nullif(count(*) FILTER (step % 7 <> 0), 0) AS "values",
 CASE WHEN count(*) FILTER (step % 7 <> 0) = 0 THEN NULL WHEN max(step) % 7 = 0 THEN 'nan'::DOUBLE
  ELSE arg_max(reward_mean, step) END AS latest
FROM steps GROUP BY experiment"""


def tailed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines of a run's log, followed by the source for growing files and counted per run."""
    path = fresh_path(spark, "tailed")
    lines = read(spark, sf, "events").selectExpr("'run_' || CAST(user_id AS STRING) AS value")
    lines.write.text(path)
    found = fresh_path(spark, "found")
    stream = live.watch_lines(spark, f"{path}/part-*")
    query = (
        stream.writeStream.format("parquet").option("path", found)
        .option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(found).groupBy(F.col("value").alias("experiment")).agg(F.count("*").alias("n"))


def rotated_log(spark: SparkSession, sf: str) -> DataFrame:
    """A run's log read before and after its files were renamed and new ones came in their place."""
    path, spare, found, checkpoint = (fresh_path(spark, name) for name in ("rotating", "spare", "found", "checkpoint"))
    lines = read(spark, sf, "events").selectExpr("'run_' || CAST(user_id AS STRING) AS value", "event_id % 2 AS half").repartition(4)
    lines.where("half = 0").select("value").write.text(path)
    lines.where("half = 1").select("value").write.text(spare)

    def follow() -> None:
        writer = live.watch_lines(spark, f"{path}/part-*").writeStream.format("parquet").option("path", found)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    follow()
    old, new = Folder(f"{path}/part-*"), Folder(f"{spare}/part-*")
    parts = sorted(filter(old.matches, old.files()))
    for name in parts:
        old.store.move(name, f"{old.root}/rotated-{name.rsplit('/', 1)[1]}")
    for k, name in enumerate(sorted(filter(new.matches, new.files()))):
        old.store.move(name, parts[k] if k < len(parts) else f"{old.root}/part-more-{k}")
    follow()
    follow()
    return spark.read.parquet(found).groupBy(F.col("value").alias("experiment")).agg(F.count("*").alias("n"))


def complete_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of log files that are complete when they appear, handed on batch by batch."""
    path, found = fresh_path(spark, "complete"), fresh_path(spark, "found")
    read(spark, sf, "events").selectExpr("'run_' || CAST(user_id AS STRING) AS value").repartition(6).write.text(path)
    lines = live.rotated_lines(spark, f"{path}/part-*", files_per_batch=2)
    query = live.on_each_line(lines, lambda rows: rows.write.mode("append").parquet(found), fresh_path(spark, "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(found).groupBy(F.col("value").alias("experiment")).agg(F.count("*").alias("n"))


_TAILED = "SELECT 'run_' || CAST(user_id AS STRING) AS experiment, count(*) AS n FROM events GROUP BY ALL"


def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per language beside the columns a preference table would still need."""
    docs = read(spark, sf, "documents").withColumnRenamed("text", "prompt")
    missing = ",".join(prep.missing_columns(docs))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("missing", F.lit(missing))


_MISSING = "SELECT lang, count(*) AS n, 'chosen,rejected' AS missing FROM documents GROUP BY lang"


def counted_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Documents within the limit of a token counter given as a Python function."""
    counter = prep.token_counter(lambda text: len(text.split()))
    return prep.drop_overlong(read(spark, sf, "documents"), 512, ["text"], counter).select("doc_id", "lang")


_COUNTED = f"SELECT doc_id, lang FROM documents WHERE len({q.words('text')}) <= 512"

QUERIES = {
    "json_arrays": json_arrays,
    "json_array_blocks": json_array_blocks,
    "json_lines": json_lines,
    "result_files": result_files,
    "sample_files": sample_files,
    "summary_files": summary_files,
    "checkpoint_files": checkpoint_files,
    "bounded_samples": bounded_samples,
    "pruned_checkpoints": pruned_checkpoints,
    "history_files": history_files,
    "history_table": history_table,
    "appended_logs": appended_logs,
    "tailed_lines": tailed_lines,
    "rotated_log": rotated_log,
    "complete_files": complete_files,
    "missing_columns": missing_columns,
    "overlong_by_function": counted_by_function,
}

SQL = {
    "json_arrays": "SELECT doc_id, text, lang FROM documents",
    "json_array_blocks": f"SELECT doc_id, text || '{_NOISE}' AS text, lang FROM documents",
    "json_lines": _LINES,
    "result_files": _RESULTS,
    "sample_files": "SELECT conv_id AS step, turn AS extra, role AS timestamp, text AS response FROM conversations",
    "summary_files": _SUMMARY,
    "checkpoint_files": _CHECKPOINTS,
    "bounded_samples": _BOUNDED,
    "pruned_checkpoints": _CHECKPOINTS,
    "history_files": _HISTORY,
    "history_table": _TABLE,
    "appended_logs": _APPENDED,
    "tailed_lines": _TAILED,
    "rotated_log": _TAILED,
    "complete_files": _TAILED,
    "missing_columns": _MISSING,
    "overlong_by_function": _COUNTED,
}
