"""Run-log analytics: summaries, latest state, histories, comparisons, early stop, alerts.

Wide metric tables hold one row per logged step (``experiment``, an order column such as ``pos`` or
``step``, metric columns); long ones one row per metric value (``metric``, ``value``). A run is a
column, so every per-run loop is a grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.functions import display, fixed
from rubrica.operators.ordering import (
    GROUP_LIMIT,
    SLICE_ROWS,
    first_rows,
    join_left,
    number_rows,
    slice_window,
    sliced_rows,
    with_carry,
)
from rubrica.session import settle

#: Columns that are no metrics.
NOT_METRICS = ("step", "epoch", "timestamp")


def _number(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def metric_columns(df: DataFrame, order: str = "pos") -> list[str]:
    kinds = ("double", "float", "bigint", "int")
    skip = (*NOT_METRICS, order, "experiment")
    return [c for c, kind in df.dtypes if kind in kinds and c not in skip]


def unpivot(df: DataFrame, metrics: Sequence[str], order: str = "pos") -> DataFrame:
    """Wide metrics to (experiment, order, metric, value)."""
    ids = ["experiment", order]
    rows = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return rows.unpivot(ids, list(metrics), "metric", "value")


def summary_stats(df: DataFrame, order: str = "pos", metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per run: steps (row count), epochs, and mean, sample std, min, max, latest per metric.

    The latest value is the last row's, even if NULL; NaN counts as missing elsewhere.
    """
    metrics = metric_columns(df, order) if metrics is None else metrics
    epoch = F.max("epoch") if "epoch" in df.columns else F.lit(0)
    aggs = [
        F.count("*").alias("total_steps"),
        F.coalesce(epoch, F.lit(0)).cast("bigint").alias("total_epochs"),
    ]
    for m in metrics:
        v = _number(F.col(m))
        aggs += [
            F.avg(v).alias(f"{m}_mean"),
            F.stddev_samp(v).alias(f"{m}_std"),
            F.min(v).alias(f"{m}_min"),
            F.max(v).alias(f"{m}_max"),
            F.max_by(m, order).alias(f"{m}_latest"),
        ]
    return df.groupBy("experiment").agg(*aggs)


def summary_stats_long(df: DataFrame, order: str = "pos") -> DataFrame:
    """The same statistics per (experiment, metric) of a long table.

    A metric counts as numeric in a run if none of its values there is something else
    (``numeric`` false); others are left out. The latest value is that of the run's last row, NULL where
    the row lacks the metric.
    """
    v = _number(F.col("value"))
    ends = df.groupBy("experiment").agg(F.max(order).alias("_end"))
    rows = df.where(~F.col("metric").isin(*NOT_METRICS))
    stats = rows.groupBy("experiment", "metric").agg(
        F.bool_and("numeric").alias("_numeric"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max_by("value", order).alias("latest"),
        F.count(v).alias("values"),
        F.max(order).alias("_last"),
    )
    stats = join_left(stats.where("_numeric AND values > 0"), ends, ["experiment"])
    latest = F.when(F.col("_last") == F.col("_end"), F.col("latest"))
    return stats.withColumn("latest", latest).drop("_numeric", "_last", "_end")


def latest_metrics(df: DataFrame, order: str = "pos", ts: str = "timestamp") -> DataFrame:
    """The last row of every run, with the time since its first row."""
    cols = [c for c in df.columns if c != "experiment"]
    aggs = [F.max_by(F.struct(*cols), order).alias("last")]
    if ts in df.columns:
        aggs.append(F.min_by(ts, order).alias("_first"))
    last = df.groupBy("experiment").agg(*aggs)
    out = last.select("experiment", "last.*", *(["_first"] if ts in df.columns else []))
    if ts in df.columns:
        out = out.withColumn("elapsed_time", F.col(ts) - F.col("_first")).drop("_first")
    return out


def status(df: DataFrame, order: str = "pos") -> DataFrame:
    """Dashboard row per run; absent figures are 0."""
    last = latest_metrics(df, order)

    def value(name: str, kind: str) -> Column:
        c = F.col(name) if name in last.columns else F.lit(None)
        return F.coalesce(c.cast(kind), F.lit(0).cast(kind))

    return last.select(
        "experiment",
        value("step", "bigint").alias("step"),
        value("epoch", "bigint").alias("epoch"),
        display.fixed_point(value("reward_mean", "double"), 4).alias("reward_mean"),
        display.clock(value("elapsed_time", "double")).alias("elapsed"),
        value("gpu_utilization", "double").alias("gpu_utilization"),
    )


def curves(
    df: DataFrame, metrics: Sequence[str] = ("policy_loss", "value_loss", "kl_loss"), step: str = "step"
) -> DataFrame:
    """(experiment, step, metric, value) of those of the metrics the table has."""
    return unpivot(df, [m for m in metrics if m in df.columns], step)


def kl_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "kl" in c.lower()]


def kl_metrics(long: DataFrame) -> DataFrame:
    return long.where(F.contains(F.lower("metric"), F.lit("kl")))


def metric_history(df: DataFrame, metric: str, order: str = "pos", window: int = 100) -> DataFrame:
    """The last ``window`` values of a metric per run, numbered from the oldest kept."""
    if metric not in df.columns:
        return df.select("experiment", F.lit(None).cast("double").alias("value")).limit(0)
    last = first_rows(df.select("experiment", order, metric), ["experiment"], [F.col(order).desc()], window)
    return last.select("experiment", order, F.col(metric).alias("value"), F.col("pos").alias("from_end"))


def compare(
    df: DataFrame, experiments: Sequence[str], metric: str, order: str = "pos", limit: int = GROUP_LIMIT
) -> DataFrame:
    """One column per run, aligned by the ordinal of the row, short runs padded with NULL."""
    rows = df.where(F.col("experiment").isin(*experiments)).select("experiment", order, metric)
    rows = number_rows(rows, ["experiment"], [F.col(order)], "ordinal", limit)
    return rows.groupBy("ordinal").pivot("experiment", list(experiments)).agg(F.first(metric))


def run_summary(df: DataFrame, order: str = "pos", ts: str = "timestamp") -> DataFrame:
    """Closing row per run: epochs, steps, duration and the final metrics as a map."""
    metrics = metric_columns(df, order)
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    final = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return df.groupBy("experiment").agg(
        F.max_by("epoch", order).alias("total_epochs"),
        F.max_by("step", order).alias("total_steps"),
        (F.max(ts) - F.min(ts)).alias("duration_seconds"),
        F.max(ts).alias("end_time"),
        F.max_by(final, order).alias("final_metrics"),
    )


def reward_band(df: DataFrame, step: str = "step") -> DataFrame:
    """Mean reward with a band of one std on either side, if the table has a std."""
    mean = F.col("reward_mean")
    cols = ["experiment", step, "reward_mean"]
    if "reward_std" not in df.columns:
        return df.select(*cols)
    low, high = mean - F.col("reward_std"), mean + F.col("reward_std")
    return df.select(*cols, low.alias("band_low"), high.alias("band_high"))


def progress(
    df: DataFrame, total_steps: int, print_freq: int = 10, metrics: Sequence[str] = (), ts: str = "timestamp"
) -> DataFrame:
    """Progress line of every ``print_freq``-th step; elapsed time counts from the run's start."""
    start = df.groupBy("experiment").agg(F.min(ts).alias("_start"))
    shown = df.where(F.col("step") % print_freq == 0).join(start, "experiment")
    line = display.progress_text(
        F.col("step"), total_steps, F.col(ts) - F.col("_start"), [(m, F.col(m)) for m in metrics]
    )
    return shown.select("experiment", "step", line.alias("line"))


def every_n_steps(df: DataFrame, n: int = 100) -> DataFrame:
    return df.where((F.col("step") > 0) & (F.col("step") % n == 0))


def kept_checkpoints(df: DataFrame, save_freq: int = 100, keep: int = 5) -> DataFrame:
    """The newest ``keep`` of the steps at which a checkpoint was saved, per run."""
    return first_rows(every_n_steps(df, save_freq), ["experiment"], [F.col("step").desc()], keep, "age")


def capped_samples(df: DataFrame, order: Sequence[str], by: Sequence[str] = ("experiment",), n: int = 100) -> DataFrame:
    """The first ``n`` samples per run in arrival order; a sample log takes no more."""
    return first_rows(df, by, [F.col(c) for c in order], n)


def last_samples(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The last ``n`` rows of the whole table; all of them for 0."""
    return df if n == 0 else df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sample_cards(df: DataFrame, order: Sequence[str], recent: int = 5, shown: int = 3) -> DataFrame:
    """Dashboard cards of the first ``shown`` of the last ``recent`` samples."""
    rows = last_samples(df, order, recent).orderBy(*order).limit(shown)
    number = F.row_number().over(Window.orderBy(*order))  # over the few rows left
    fields = [F.col(c) for c in ("step", "reward", "prompt", "response")]
    return rows.select(*order, display.sample_card(number, *fields).alias("card"))


def metric_categories(long: DataFrame) -> DataFrame:
    """Join each metric to its dashboard categories (a metric may have two)."""
    rows = [(m, category) for category, names in fixed.METRIC_CATEGORIES.items() for m in names]
    categories = long.sparkSession.createDataFrame(rows, "metric string, category string")
    return long.join(F.broadcast(categories), "metric")


# --- rules ---------------------------------------------------------------------------------------


def alerts(long: DataFrame, rules: Sequence[tuple] = tuple(fixed.ALERT_RULES)) -> DataFrame:
    """Metric values that break a threshold rule, with the rule's name and message."""
    table = long.sparkSession.createDataFrame(
        [tuple(r) for r in rules],
        "rule string, metric string, condition string, threshold double, message string",
    )
    value, threshold = F.col("value"), F.col("threshold")
    above = (F.col("condition") == "greater_than") & (value > threshold)
    below = (F.col("condition") == "less_than") & (value < threshold)
    return long.join(F.broadcast(table), "metric").where(above | below)


def health(long: DataFrame, ranges: Sequence[tuple] = tuple(fixed.HEALTH_RANGES)) -> DataFrame:
    """Add ``healthy`` to the values of metrics with a known range.

    A range without a high end is an exclusive minimum.
    """
    table = long.sparkSession.createDataFrame(
        [tuple(r) for r in ranges], "metric string, low double, high double"
    )
    v = F.col("value")
    inside = F.when(F.col("high").isNull(), v > F.col("low")).otherwise(v.between(F.col("low"), F.col("high")))
    return long.join(F.broadcast(table), "metric").withColumn("healthy", inside)


def _records(
    df: DataFrame, metric: str, order: str, sign: float, limit: int, slice_rows: int
) -> tuple[DataFrame, str | None]:
    """Add ``_v`` (signed value), ``_n`` and ``_record``: whether it exceeds all earlier values."""
    rows = df.where(_number(F.col(metric)).isNotNull())
    rows = rows.withColumn("_v", F.col(metric) * F.lit(sign))
    rows, cut = sliced_rows(rows, ["experiment"], [F.col(order)], limit, slice_rows)
    rows = with_carry(rows, ["experiment"], cut, [("max", F.max("_v"), "_before", "double")])
    earlier = slice_window(["experiment"], cut, F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("_v").over(earlier), F.col("_before"))
    record = best.isNull() | (F.col("_v") > best)
    return rows.withColumn("_record", record).drop("_before"), cut


def stagnation(
    df: DataFrame,
    metric: str = fixed.STAGNATION_RULE[1],
    window: int = fixed.STAGNATION_RULE[2],
    order: str = "pos",
    limit: int = GROUP_LIMIT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``since_best`` (rows since the metric last exceeded all before) and ``stagnant``.

    A row is stagnant once the best of the last ``window`` rows is no better than what came
    before them, which is the case exactly if no new best fell into those rows. NULL values are
    left out.
    """
    rows, cut = _records(df, metric, order, 1.0, limit, slice_rows)
    last = F.max(F.when(F.col("_record"), F.col("_n")))
    rows = with_carry(rows, ["experiment"], cut, [("max", last, "_before", "bigint")])
    running = slice_window(["experiment"], cut, F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(last.over(running), F.col("_before"))
    rows = rows.withColumn("since_best", F.col("_n") - best)
    rows = rows.withColumn("stagnant", F.col("since_best") >= window)
    return rows.drop("_v", "_n", "_slice", "_record", "_before")


def early_stop(
    df: DataFrame,
    metric: str = "eval_reward",
    patience: int = 5,
    min_delta: float = 0.001,
    mode: str = "max",
    order: str = "epoch",
    limit: int = GROUP_LIMIT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Early-stopping outcome per run: best value, whether and at which row it stopped.

    The best moves only on a gain above ``min_delta``, the counter of rows without one starts
    again there, and a stop stays. Rows lacking the metric do not count.

    A gain must exceed every earlier value, so only running records can be gains. Where every run
    fits into a slice they are folded in one expression per run. Else a record's successor, the next that
    beats it by ``min_delta``, is found for all records at once, and the gains are those that successors reach
    from the first record: in every round paths double in length, so a run of any size takes few rounds.
    """
    sign = 1.0 if mode == "max" else -1.0
    rows, cut = _records(df, metric, order, sign, limit, slice_rows)
    record = F.when(F.col("_record") & (F.col("_v") > float("-inf")), F.struct("_n", "_v"))
    if cut is None:
        runs = rows.groupBy("experiment").agg(F.count("*").alias("rows"), F.sort_array(F.collect_list(record)).alias("_records"))
        runs = runs.withColumn("_end", _folded(F.col("_records"), F.col("rows"), patience, min_delta)).where("_end.row IS NOT NULL")
        stop = F.col("_end.stop")
        best = (F.col("_end.best") * F.lit(sign)).alias("best_value")
        return runs.select("experiment", best, F.col("_end.row").alias("best_row"), "rows", stop.isNotNull().alias("should_stop"), stop.alias("stop_row"))
    rows = settle(rows.select("experiment", "_n", record.alias("_found")), "records")
    records = rows.where("_found IS NOT NULL").select("experiment", "_n", "_found._v")
    gains = join_left(_reached(records, min_delta, limit, slice_rows), records, ["experiment", "_n"])
    totals = rows.groupBy("experiment").agg(F.count("*").alias("rows"))
    window = Window.partitionBy("experiment").orderBy("_n")
    spans = join_left(gains, totals, ["experiment"])
    until = F.coalesce(F.lead("_n").over(window) - 1, F.col("rows"))
    spans = spans.withColumn("_stop", F.when(until - F.col("_n") >= patience, F.col("_n") + patience))
    return spans.groupBy("experiment").agg(
        (F.max_by("_v", "_n") * F.lit(sign)).alias("best_value"),
        F.max("_n").alias("best_row"),
        F.max("rows").alias("rows"),
        F.min("_stop").isNotNull().alias("should_stop"),
        F.min("_stop").alias("stop_row"),
    )


def _folded(records: Column, rows: Column, patience: int, min_delta: float) -> Column:
    """(best, row, stop) of a run from its records in order: one number each at any time."""
    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(float("-inf")).alias("best"), none.alias("row"), none.alias("stop"))

    def stopped(state: Column, last: Column) -> Column:
        """The first row at which the run had waited long enough, with no gain up to ``last``."""
        return F.coalesce(state["stop"], F.when(last - state["row"] >= patience, state["row"] + F.lit(patience).cast("bigint")))

    def step(state: Column, record: Column) -> Column:
        gain = F.struct(record["_v"].alias("best"), record["_n"].alias("row"), stopped(state, record["_n"] - 1).alias("stop"))
        return F.when(record["_v"] > state["best"] + F.lit(min_delta), gain).otherwise(state)

    def end(state: Column) -> Column:
        return F.struct(state["best"].alias("best"), state["row"].alias("row"), stopped(state, rows).alias("stop"))

    return F.aggregate(records, start, step, end)


def _successors(records: DataFrame, min_delta: float, limit: int, slice_rows: int) -> DataFrame:
    """(experiment, _n, _next): for each record the next one that beats it by ``min_delta``, if there is one.

    Records rise, so that is the first in order of value behind the record's own value plus ``min_delta``.
    """
    own = records.select("experiment", F.col("_v").alias("_x"), F.lit(0).alias("_ask"), F.col("_n").alias("_of"))
    asks = records.select("experiment", (F.col("_v") + F.lit(min_delta)).alias("_x"), F.lit(1).alias("_ask"), F.col("_n").alias("_of"))
    order = [F.col("_x"), F.col("_ask"), F.col("_of")]
    both, cut = sliced_rows(own.unionAll(asks), ["experiment"], order, limit, slice_rows)
    record = F.when(F.col("_ask") == 0, F.col("_of"))
    both = with_carry(both, ["experiment"], cut, [("last", F.min(record), "_after", "bigint")], reverse=True)
    back = slice_window(["experiment"], cut, F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.last(record, ignorenulls=True).over(back), F.col("_after"))
    found = both.withColumn("_next", following).where("_ask = 1 AND _next IS NOT NULL")
    return found.select("experiment", F.col("_of").alias("_n"), "_next")


def _reached(records: DataFrame, min_delta: float, limit: int, slice_rows: int) -> DataFrame:
    """(experiment, _n): the records on the way of successors from each run's first."""
    reached = records.groupBy("experiment").agg(F.min("_n").alias("_n"))
    jump = settle(_successors(records, min_delta, limit, slice_rows), "jumps")
    while True:
        # reached holds all within 2**k steps, jump leads 2**k steps on
        more = settle(_jumped(reached, jump, "_n"), "reached").select("experiment", F.col("_next").alias("_n"))
        if more.isEmpty():
            return reached
        reached = reached.unionAll(more)
        jump = settle(_jumped(jump, jump, "_next"), "jumps")


def _jumped(rows: DataFrame, jump: DataFrame, at: str) -> DataFrame:
    """Where ``jump`` leads from the record in ``at``; rows without such a jump go."""
    to = jump.select(F.col("experiment").alias("_run"), F.col("_n").alias("_from"), F.col("_next").alias("_to"))
    both = rows.join(to, F.col("experiment").eqNullSafe(F.col("_run")) & (F.col(at) == F.col("_from")))
    return both.select("experiment", "_n", F.col("_to").alias("_next"))
