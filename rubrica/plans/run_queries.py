"""Run-log queries over the events table: a run per user, a logged step per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.functions import display, fixed
from rubrica.operators import console, runs
from rubrica.operators.ordering import number_rows
from rubrica.plans import sqltext as q
from rubrica.plans.inputs import cte, read, table
from rubrica.session import fresh_path, spread
from rubrica.sources import logs

_STEPS = f"""{cte('metrics')}, steps AS (SELECT experiment, seq, reward_mean, kl_divergence, gpu_utilization, epoch,
 timestamp, row_number() OVER (PARTITION BY experiment ORDER BY seq) AS step FROM metrics WHERE NOT is_event)"""
_METRICS = ["reward_mean", "kl_divergence", "gpu_utilization"]


def steps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "metrics").where("NOT is_event").drop("is_event", "event")
    return number_rows(rows, ["experiment"], [F.col("seq")], "step")


def _rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "metrics").where("NOT is_event")
    out = runs.summary_stats(rows, "seq", _METRICS)
    return _rounded(out, [f"{m}_{s}" for m in _METRICS for s in ("mean", "std")])


_SUMMARIES = (
    f"{_STEPS} SELECT experiment, count(*) AS total_steps, max(epoch) AS total_epochs, "
    + ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, min({m}) AS {m}_min,"
        f" max({m}) AS {m}_max, arg_max({m}, seq) AS {m}_latest"
        for m in _METRICS
    )
    + " FROM steps GROUP BY experiment"
)


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_metrics(steps(spark, sf), "seq")


_LATEST = f"""{_STEPS}, w AS (SELECT *, timestamp - first_value(timestamp) OVER (PARTITION BY experiment ORDER BY seq)
 AS elapsed_time, row_number() OVER (PARTITION BY experiment ORDER BY seq DESC) AS rk FROM steps)
SELECT * EXCLUDE (rk) FROM w WHERE rk = 1"""


def status(spark: SparkSession, sf: str) -> DataFrame:
    return runs.status(steps(spark, sf), "seq")


_CLOCK = """printf('%02d:%02d:%02d', CAST(floor({s} / 3600) AS BIGINT), CAST(floor({s} % 3600 / 60) AS BIGINT),
 CAST(floor({s} % 60) AS BIGINT))"""
_STATUS = f"""{_LATEST.replace('SELECT * EXCLUDE (rk) FROM w WHERE rk = 1', '')}
SELECT experiment, step, epoch, printf('%.4f', reward_mean) AS reward_mean, {_CLOCK.format(s='elapsed_time')} AS elapsed,
 gpu_utilization FROM w WHERE rk = 1"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.metric_history(table(spark, sf, "metrics").where("NOT is_event"), "reward_mean", "seq", 20)
    return out.select("experiment", "seq", "value", F.col("from_end").cast("bigint").alias("from_end"))


_HISTORY = f"""{_STEPS}, w AS (SELECT experiment, seq, reward_mean AS value,
 row_number() OVER (PARTITION BY experiment ORDER BY seq DESC) AS from_end FROM steps)
SELECT * FROM w WHERE from_end <= 20"""

_TEAMS = ["team_0", "team_1", "team_2", "team_3", "team_4"]
_TEAM = "'team_' || CAST(CAST(substr(experiment, 5) AS BIGINT) % 5 AS STRING)"


def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Five runs, one per residue of the user, that together hold every logged step."""
    rows = table(spark, sf, "metrics").where("NOT is_event").withColumn("experiment", F.expr(_TEAM))
    return runs.compare(rows, _TEAMS, "reward_mean", "seq")


_COMPARE = (
    f"{_STEPS}, t AS (SELECT {_TEAM} AS team, reward_mean, row_number() OVER (PARTITION BY {_TEAM} ORDER BY seq)"
    " AS ordinal FROM steps) SELECT ordinal, "
    + ", ".join(f"max(CASE WHEN team = '{t}' THEN reward_mean END) AS {t}" for t in _TEAMS)
    + " FROM t GROUP BY ordinal"
)


def closing(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.run_summary(steps(spark, sf), "seq")
    final = F.col("final_metrics")
    return out.select(
        "experiment",
        "total_epochs",
        "total_steps",
        "duration_seconds",
        "end_time",
        final["reward_mean"].alias("final_reward"),
        final["kl_divergence"].alias("final_kl"),
    )


_CLOSING = f"""{_STEPS} SELECT experiment, arg_max(epoch, seq) AS total_epochs, arg_max(step, seq) AS total_steps,
 max(timestamp) - min(timestamp) AS duration_seconds, max(timestamp) AS end_time,
 arg_max(reward_mean, seq) AS final_reward, arg_max(kl_divergence, seq) AS final_kl FROM steps GROUP BY experiment"""


def band(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).withColumn("reward_std", F.col("kl_divergence"))
    return _rounded(runs.reward_band(rows), ["band_low", "band_high"])


_BAND = f"""{_STEPS} SELECT experiment, step, reward_mean, round(reward_mean - kl_divergence, 6) AS band_low,
 round(reward_mean + kl_divergence, 6) AS band_high FROM steps"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return runs.unpivot(steps(spark, sf), _METRICS, "step")


_LONG = f"""{_STEPS}, long AS (
 SELECT experiment, step, 'reward_mean' AS metric, reward_mean AS value FROM steps
 UNION ALL SELECT experiment, step, 'kl_divergence', kl_divergence FROM steps
 UNION ALL SELECT experiment, step, 'gpu_utilization', gpu_utilization FROM steps)"""


def kl_rows(spark: SparkSession, sf: str) -> DataFrame:
    """KL columns by name, and the loss curves the table has, as one long table."""
    rows = steps(spark, sf).withColumn("policy_loss", F.col("reward_mean") / F.lit(10.0))
    kl = runs.unpivot(rows, runs.kl_columns(rows), "step")
    return kl.unionByName(runs.curves(rows)).where("value IS NOT NULL")


_KL = f"""{_LONG} SELECT * FROM long WHERE metric LIKE '%kl%'
 UNION ALL SELECT experiment, step, 'policy_loss', reward_mean / 10e0 FROM steps"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = _long(spark, sf)
    both = rows.unionByName(rows.where("metric = 'kl_divergence'").withColumn("metric", F.lit("kl_loss")))
    found = runs.metric_categories(runs.kl_metrics(both).unionByName(both.where("metric NOT LIKE '%kl%'")))
    return found.groupBy("category", "metric").agg(F.count("*").alias("n"))


_CATEGORIES = f"""{_LONG}, c(metric, category) AS (VALUES {', '.join(
    f"('{m}', '{c}')" for c, names in fixed.METRIC_CATEGORIES.items() for m in names)}),
 b AS (SELECT metric FROM long UNION ALL SELECT 'kl_loss' FROM long WHERE metric = 'kl_divergence')
SELECT category, metric, count(*) AS n FROM b JOIN c USING (metric) GROUP BY category, metric"""


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return runs.progress(steps(spark, sf), 64, 16, ["reward_mean", "gpu_utilization"])


_PROGRESS = f"""{_STEPS}, p AS (SELECT *, timestamp - min(timestamp) OVER (PARTITION BY experiment) AS elapsed FROM steps)
SELECT experiment, step, printf('Step %d/64 (%.1f%%) | ETA: %.1fmin | ', step, step / 64e0 * 100e0,
 elapsed / step * (64 - step) / 60e0) || printf('reward_mean: %.4f', reward_mean) || ' | '
 || printf('gpu_utilization: %.4f', gpu_utilization) AS line FROM p WHERE step % 16 = 0"""


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.kept_checkpoints(steps(spark, sf), 10, 3)
    return out.select("experiment", "step", "reward_mean", F.col("age").cast("bigint").alias("age"))


_CHECKPOINTS = f"""{_STEPS}, k AS (SELECT experiment, step, reward_mean,
 row_number() OVER (PARTITION BY experiment ORDER BY step DESC) AS age FROM steps WHERE step > 0 AND step % 10 = 0)
SELECT * FROM k WHERE age <= 3"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first samples of every run's log, and how each run's last one scores."""
    rows = table(spark, sf, "rollouts").select("step", "response_id", "group_id", "response")
    kept = runs.capped_samples(rows, ["group_id", "response_id"], ["step"], 100)
    return kept.select("step", "group_id", "response_id", "response")


_SAMPLES = f"""{cte('rollouts')}, k AS (SELECT step, group_id, response_id, response,
 row_number() OVER (PARTITION BY step ORDER BY group_id, response_id) AS rk FROM rollouts)
SELECT * EXCLUDE (rk) FROM k WHERE rk <= 100"""


def sample_texts(spark: SparkSession, sf: str) -> DataFrame:
    reward = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / F.lit(1000.0))
    return read(spark, sf, "documents").select(
        "doc_id",
        display.sample_text(
            F.col("doc_id"), reward, F.col("source"), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
        ).alias("shown"),
    )


_SHOWN = """SELECT doc_id, '**Step:** ' || doc_id
 || CASE WHEN doc_id % 4 <> 0 THEN chr(10) || chr(10) || '**Reward:** ' || printf('%.4f', n_chars / 1000e0) ELSE '' END
 || chr(10) || chr(10) || '**Prompt:** ' || source
 || chr(10) || chr(10) || '**Response:** ' || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END
 || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '**Ground Truth:** ' || lang ELSE '' END AS shown FROM documents"""


def sample_cards(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(
        F.col("doc_id").alias("step"),
        (F.col("n_chars") / F.lit(1000.0)).alias("reward"),
        F.col("source").alias("prompt"),
        F.col("text").alias("response"),
    )
    return runs.sample_cards(rows, ["step"])


_CARDS = """WITH l AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS back FROM documents)
SELECT doc_id AS step, '**样本 ' || (6 - back) || '** (Step ' || doc_id || ', Reward: ' || printf('%.2f', n_chars / 1000e0)
 || ')' || chr(10) || chr(10) || '**Prompt:** ' || left(source, 200) || '...' || chr(10) || chr(10) || '**Response:** '
 || left(text, 300) || '...' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS card FROM l WHERE back BETWEEN 3 AND 5"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.alerts(_long(spark, sf))


_ALERTS = f"""{_LONG}, rules(rule, metric, condition, threshold, message) AS (VALUES {', '.join(
    f"('{r}', '{m}', '{c}', {t}::DOUBLE, {q.lit(x)})" for r, m, c, t, x in fixed.ALERT_RULES)})
SELECT experiment, step, metric, value, rule, condition, threshold, message FROM long JOIN rules USING (metric)
WHERE (condition = 'greater_than' AND value > threshold) OR (condition = 'less_than' AND value < threshold)"""


def health(spark: SparkSession, sf: str) -> DataFrame:
    rows = _long(spark, sf)
    share = rows.where("metric = 'gpu_utilization'").select(
        "experiment", "step", F.lit("preference_accuracy").alias("metric"), (F.col("value") / 100).alias("value")
    )
    return runs.health(rows.unionByName(share)).select("experiment", "step", "metric", "value", "healthy")


_HEALTH = f"""{_LONG} SELECT experiment, step, metric, value, value BETWEEN 1e-3 AND 1e-1 AS healthy FROM long
WHERE metric = 'kl_divergence' UNION ALL SELECT experiment, step, 'preference_accuracy', value / 100, value / 100 > 6e-1
FROM long WHERE metric = 'gpu_utilization'"""


def stagnation(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.stagnation(steps(spark, sf), "reward_mean", 10, "seq")
    return out.select("experiment", "step", "since_best", "stagnant")


_STAGNATION = f"""{_STEPS}, b AS (SELECT *, max(reward_mean) OVER (PARTITION BY experiment ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
 max(reward_mean) OVER (PARTITION BY experiment ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent,
 max(reward_mean) OVER (PARTITION BY experiment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING) AS old
 FROM steps)
SELECT experiment, step, step - max(CASE WHEN best IS NULL OR reward_mean > best THEN step END)
  OVER (PARTITION BY experiment ORDER BY seq) AS since_best, coalesce(recent <= old, false) AS stagnant FROM b"""


def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return runs.early_stop(steps(spark, sf), "reward_mean", 8, 2.5, "max", "seq")


def early_stop_min(spark: SparkSession, sf: str) -> DataFrame:
    return runs.early_stop(steps(spark, sf), "kl_divergence", 5, 0.02, "min", "seq")


def _stop_sql(metric: str, patience: int, delta: str, better: str, start: str) -> str:
    gain = f"s.{metric} {better} {delta}"
    with_recursive = _STEPS.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{with_recursive}, f AS (
 SELECT experiment, 0::BIGINT AS n, {start}::DOUBLE AS best, 0::BIGINT AS best_n, 0 AS counter, NULL::BIGINT AS stop
 FROM steps GROUP BY experiment
 UNION ALL
 SELECT s.experiment, s.step, CASE WHEN {gain} THEN s.{metric} ELSE f.best END,
  CASE WHEN {gain} THEN s.step ELSE f.best_n END, CASE WHEN {gain} THEN 0 ELSE f.counter + 1 END,
  coalesce(f.stop, CASE WHEN NOT ({gain}) AND f.counter + 1 >= {patience} THEN s.step END)
 FROM f JOIN steps s ON s.experiment = f.experiment AND s.step = f.n + 1)
SELECT experiment, arg_max(best, n) AS best_value, arg_max(best_n, n) AS best_row, max(n) AS rows,
 max(stop) IS NOT NULL AS should_stop, max(stop) AS stop_row FROM f GROUP BY experiment"""


# --- text logs ---------------------------------------------------------------------------------------

_LINE = """CASE WHEN event_id % 50 = 7 THEN 'broken {' WHEN event_id % 50 = 9 THEN '[1, 2]'
 WHEN event_id % 50 = 11 THEN '{"step": 1} trailing'
 WHEN event_type = 'signup' THEN '{"event": "' || event_type || '", "timestamp": "t' || CAST(event_id AS STRING)
  || '", "data": ' || props || '}'
 ELSE '{"step": ' || CAST(event_id AS STRING) || ', "timestamp": 1.5, "reward_mean": ' || CAST(value AS STRING)
  || ', "note": "a", "flag": true, "gap": null, "mixed": ' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '"one"' END
  || ', "count": ' || CAST(user_id AS STRING) || '}' END"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "events")).selectExpr(
        "'run_' || CAST(user_id AS STRING) AS experiment", "event_id AS pos", "event_type", f"{_LINE} AS value"
    )


def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Metric lines of mixed logs to the long table to statistics per run and metric."""
    long = logs.long_metrics(logs.metric_lines(logs.records(_lines(spark, sf))))
    return _rounded(runs.summary_stats_long(long), ["mean", "std"])


_GOOD = "event_id % 50 NOT IN (7, 9, 11)"
_PARSED = f"""WITH e AS (SELECT 'run_' || CAST(user_id AS STRING) AS experiment, event_id, value AS reward_mean,
 user_id::DOUBLE AS count, event_id % 2 = 0 AS even FROM events WHERE event_type <> 'signup' AND {_GOOD}),
 long AS (SELECT experiment, event_id, 'reward_mean' AS metric, reward_mean AS value FROM e
 UNION ALL SELECT experiment, event_id, 'count', count FROM e
 UNION ALL SELECT experiment, event_id, 'mixed', 1e0 FROM e WHERE experiment IN
  (SELECT experiment FROM e GROUP BY experiment HAVING bool_and(even)))
SELECT experiment, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
 max(value) AS max, arg_max(value, event_id) AS latest, count(value) AS "values" FROM long GROUP BY experiment, metric"""


def parsed_events(spark: SparkSession, sf: str) -> DataFrame:
    return logs.event_lines(logs.records(_lines(spark, sf).drop("event_type")))


_EVENTS = f"""SELECT 'run_' || CAST(user_id AS STRING) AS experiment, event_id AS pos, event_type AS event,
 't' || CAST(event_id AS STRING) AS timestamp, replace(props, ' ', '') AS data FROM events
WHERE event_type = 'signup' AND {_GOOD}"""


def malformed(spark: SparkSession, sf: str) -> DataFrame:
    return logs.malformed(_lines(spark, sf)).select("experiment", "pos", "value")


_MALFORMED = f"""SELECT 'run_' || CAST(user_id AS STRING) AS experiment, event_id AS pos, {_LINE} AS value
FROM events WHERE NOT ({_GOOD})"""


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    return logs.experiments(_lines(spark, sf))


def search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search over all metric lines, then over documents as sample lines."""
    metric = _lines(spark, sf).select(F.col("pos").alias("line"), "value")
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("line"), F.col("text").alias("value"))
    found = logs.search_logs(metric, docs, "TION", 100)
    more = logs.search_logs(metric, docs, "SIGNUP", 100)
    return found.unionByName(more)


_SEARCH = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT * FROM (SELECT 0 AS source, event_id AS line,
 'metrics.jsonl:' || event_id || ': ' || v AS hit FROM (SELECT event_id, {_LINE} AS v FROM events)
 WHERE contains(lower(v), '{word}')
 UNION ALL SELECT 1, doc_id, 'samples.jsonl:' || doc_id || ': ' || left({q.strip('text')}, 200) FROM documents
 WHERE contains(lower(text), '{word}')) ORDER BY source, line LIMIT 100)"""
    for word in ("tion", "signup")
)


def tails(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select("experiment", "pos", "value")
    last = logs.tail_lines(rows, 50).withColumn("kind", F.lit("tail"))
    newest = runs.last_samples(rows, ["pos"], 10).withColumn("kind", F.lit("samples"))
    return last.unionByName(newest)


_TAILS = f"""WITH l AS (SELECT 'run_' || CAST(user_id AS STRING) AS experiment, event_id AS pos, {_LINE} AS value,
 row_number() OVER (ORDER BY event_id DESC) AS rk FROM events)
SELECT experiment, pos, value, 'tail' AS kind FROM l WHERE rk <= 50
UNION ALL SELECT experiment, pos, value, 'samples' FROM l WHERE rk <= 10"""


def written_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows and events appended to log files, read back as text, summed up per run."""
    rows = table(spark, sf, "metrics")
    logs_map = F.create_map(F.lit("reward_mean"), F.col("reward_mean"), F.lit("epoch"), F.lit(9.0))
    path = fresh_path(spark, "logs")
    metric = rows.where("NOT is_event").select("experiment", F.col("seq").alias("step"), "epoch", "timestamp", logs_map.alias("logs"))
    logs.append_metrics(metric, path)
    data = F.create_map(F.lit("k"), F.col("gpu_utilization").cast("string"))
    logs.append_events(
        rows.where("is_event").select("experiment", "event", F.col("timestamp").cast("string").alias("timestamp"), data.alias("data")),
        path,
    )
    kinds = {"step": "bigint", "epoch": "double", "reward_mean": "double"}
    wide = logs.wide_metrics(logs.read_metrics(spark, path), kinds)
    found = wide.groupBy("experiment").agg(
        F.count("*").alias("metrics"),
        F.max("step").alias("last_step"),
        F.max("epoch").alias("epoch"),
        F.max_by("reward_mean", "step").alias("latest"),
    )
    counted = logs.read_events(spark, path).groupBy("experiment").agg(F.count("*").alias("events"))
    return found.join(counted, "experiment", "left")


_WRITTEN = f"""{cte('metrics')} SELECT experiment, count(*) FILTER (NOT is_event) AS metrics,
 max(seq) FILTER (NOT is_event) AS last_step, 9e0 AS epoch, arg_max(reward_mean, seq) FILTER (NOT is_event) AS latest,
 nullif(count(*) FILTER (is_event), 0) AS events FROM metrics GROUP BY experiment
HAVING count(*) FILTER (NOT is_event) > 0"""


def scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Exported scalar events, one column per tag."""
    long = _long(spark, sf).withColumnRenamed("metric", "tag")
    return logs.pivot_scalars(long, ["gpu_utilization", "kl_divergence", "missing_tag"]).withColumn(
        "missing_tag", F.coalesce("missing_tag", F.lit(-1.0))
    )


_SCALARS = f"""{_STEPS} SELECT experiment, step, gpu_utilization, kl_divergence, -1e0 AS missing_tag FROM steps"""

_CONSOLE = """CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'Step: ' || CAST(event_id AS STRING)
 WHEN 1 THEN '  epoch: 3 loss: ' || CAST(value AS STRING)
 WHEN 2 THEN 'step 12 reward: 0.5 kl 0.01'
 WHEN 3 THEN 'nothing here'
 WHEN 4 THEN 'policy_loss: 1.2.3'
 WHEN 5 THEN 'LR: 1e-4'
 ELSE CASE WHEN event_type = 'click' THEN 'step   5' ELSE 'STEP=5 x' END END"""


def console_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(read(spark, sf, "events")).selectExpr(
        "'run_' || CAST(user_id AS STRING) AS file", "event_id AS pos", f"{_CONSOLE} AS value"
    )
    out = console.parse_console(lines)
    return out.withColumn("raw", F.coalesce(F.element_at("raw", "loss"), F.lit("")))


_KEYS = list(fixed.CONSOLE_PATTERNS)
_FOUND = ", ".join(
    f"nullif(regexp_extract(value, {q.bare(p)}, 1), '') AS {k}" for k, p in fixed.CONSOLE_PATTERNS.items()
)
_CONSOLE_SQL = f"""WITH RECURSIVE lines AS (SELECT 'run_' || CAST(user_id AS STRING) AS file,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_CONSOLE} AS value FROM events),
 v AS (SELECT file, n, {_FOUND} FROM lines),
 r AS (SELECT file, 0::BIGINT AS n, {', '.join(f'NULL::VARCHAR AS {k}' for k in _KEYS)}, false AS done
  FROM lines GROUP BY file
 UNION ALL
 SELECT *, step IS NOT NULL AND coalesce(epoch, loss, reward, kl, lr) IS NOT NULL AS done FROM (
  SELECT v.file, v.n, {', '.join(f'coalesce(v.{k}, CASE WHEN r.done THEN NULL ELSE r.{k} END) AS {k}' for k in _KEYS)}
  FROM r JOIN v ON v.file = r.file AND v.n = r.n + 1))
SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS record,
 {', '.join(f'TRY_CAST({k} AS DOUBLE) AS {k}' for k in _KEYS)},
 CASE WHEN loss IS NOT NULL AND TRY_CAST(loss AS DOUBLE) IS NULL THEN loss ELSE '' END AS raw FROM r WHERE done"""

QUERIES = {
    "run_summaries": summaries,
    "run_latest": latest,
    "run_status": status,
    "metric_history": history,
    "run_compare": compared,
    "run_closing": closing,
    "reward_band": band,
    "kl_rows": kl_rows,
    "metric_categories": categories,
    "progress_lines": progress,
    "kept_checkpoints": checkpoints,
    "capped_samples": samples,
    "sample_texts": sample_texts,
    "sample_cards": sample_cards,
    "threshold_alerts": alerts,
    "health_ranges": health,
    "stagnation": stagnation,
    "early_stop": early_stop,
    "early_stop_min": early_stop_min,
    "metric_lines": parsed_lines,
    "event_lines": parsed_events,
    "malformed_lines": malformed,
    "experiment_list": experiments,
    "log_search": search,
    "log_tails": tails,
    "written_logs": written_logs,
    "scalar_pivot": scalars,
    "console_records": console_records,
}

SQL = {
    "run_summaries": _SUMMARIES,
    "run_latest": _LATEST,
    "run_status": _STATUS,
    "metric_history": _HISTORY,
    "run_compare": _COMPARE,
    "run_closing": _CLOSING,
    "reward_band": _BAND,
    "kl_rows": _KL,
    "metric_categories": _CATEGORIES,
    "progress_lines": _PROGRESS,
    "kept_checkpoints": _CHECKPOINTS,
    "capped_samples": _SAMPLES,
    "sample_texts": _SHOWN,
    "sample_cards": _CARDS,
    "threshold_alerts": _ALERTS,
    "health_ranges": _HEALTH,
    "stagnation": _STAGNATION,
    "early_stop": _stop_sql("reward_mean", 8, "f.best + 25e-1", ">", "'-inf'"),
    "early_stop_min": _stop_sql("kl_divergence", 5, "f.best - 2e-2", "<", "'inf'"),
    "metric_lines": _PARSED,
    "event_lines": _EVENTS,
    "malformed_lines": _MALFORMED,
    "experiment_list": "SELECT DISTINCT 'run_' || CAST(user_id AS STRING) AS experiment FROM events",
    "log_search": _SEARCH,
    "log_tails": _TAILS,
    "written_logs": _WRITTEN,
    "scalar_pivot": _SCALARS,
    "console_records": _CONSOLE_SQL,
}
