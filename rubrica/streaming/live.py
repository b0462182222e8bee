"""Live run logs: metric sink, running summary, alerts, early stop, stagnation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rubrica.operators import groups, runs
from rubrica.session import settle
from rubrica.streaming.tail import NAME, register

#: Event time in milliseconds, for the processors (their rows lose names that begin with an underscore).
MILLIS = "event_millis"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_lines(
    spark: SparkSession, path: str, range_bytes: int = 64 << 20, max_bytes: int | None = None, state: str | None = None
) -> DataFrame:
    """(file, offset, value): complete lines appended to the files of a pattern, renamed, cut short or not.

    With ``max_bytes`` a micro-batch takes about so many bytes, and ``state`` names a folder for the offsets.
    """
    register(spark)
    reader = spark.readStream.format(NAME).option("rangeBytes", str(range_bytes))
    if max_bytes:
        reader = reader.option("maxBytesPerBatch", str(max_bytes)).option("state", state or "")
    return reader.load(path)


def rotated_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(file, value): lines of files that are complete when they appear."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return stream.select(F.col("_metadata.file_path").alias("file"), "value")


def on_each_line(lines: DataFrame, callback: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of new lines to ``callback`` as a DataFrame, polling each second."""
    writer = lines.writeStream.foreachBatch(lambda batch, _: callback(batch))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


def metric_sink(metrics: DataFrame, path: str, checkpoint: str, order: str | None = None, buckets: int = 16) -> DataStreamWriter:
    """Append metric rows to a Parquet table laid out by ``bucket``, the bucket of the run.

    A micro-batch writes a few files per bucket, however many runs there are (``run_bucket`` tells where a run
    is). With ``order``, such as the step, a run's rows are dealt over up to four tasks.
    """
    keys = ["bucket", F.pmod(F.xxhash64(order), F.lit(4))] if order else ["bucket"]
    dealt = metrics.withColumn("bucket", run_bucket(F.col("experiment"), buckets)).repartition(*keys)
    writer = dealt.writeStream.format("parquet").partitionBy("bucket").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint)


def run_bucket(experiment: Column, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(experiment), F.lit(buckets)).cast("int")


def distinct_metrics(metrics: DataFrame, event_time: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Drop re-delivered rows; the watermark bounds what has to be remembered."""
    return metrics.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def bucketed_metrics(
    rows: DataFrame, event_time: str, keys: list[str], width: str = "1 hour", by: Sequence[str] = (), lateness: str = "1 hour"
) -> DataFrame:
    """Batch metrics per bucket of event time: re-delivered rows count once, rows up to ``lateness`` late count.

    ``keys`` tell rows apart. A bucket is given once, when the watermark has passed its end; state is the
    keys seen within the lateness and a row per open bucket and group. ``rows`` are as ``groups.batch_metrics`` takes them.
    """
    distinct = distinct_metrics(rows, event_time, keys, lateness).withColumn("bucket", F.window(event_time, width))
    metrics = groups.batch_metrics(distinct, ["bucket", *by])
    return metrics.withColumn("bucket", F.col("bucket.start"))


def running_summary(metrics: DataFrame, columns: list[str], order: str = "step") -> DataFrame:
    """The batch summary kept up to date; state is one row per run, its moments merged row by row."""
    return runs.summary_stats(metrics, order, columns)


def summary_sink(summary: DataFrame, path: str, checkpoint: str, refresh: str | None = "5 seconds", compact_every: int = 100) -> DataStreamWriter:
    """After every refresh write the runs that changed to ``path/batch=<n>``; a run's newest row counts.

    Every ``compact_every`` batches the newest row of every run is written with them, so that a reader
    needs no batch before (``newest_summary`` looks no further back).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, target = batch.sparkSession, f"{path}/batch={number:012d}"
        if number % compact_every or not number:
            batch.write.mode("overwrite").parquet(target)
            return
        changed = settle(batch, "summary")  # the micro-batch is read twice
        earlier = newest_summary(spark, path, before=number)
        rest = earlier.join(changed.select("experiment"), "experiment", "left_anti")
        changed.unionByName(rest).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).parquet(target)

    writer = summary.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)


def newest_summary(spark: SparkSession, path: str, before: int | None = None, compact_every: int = 100) -> DataFrame:
    """The newest row of every run, from the last compacted batch on."""
    table = spark.read.parquet(path)
    if before is not None:
        table = table.where(F.col("batch") < before)
    last = table.agg(F.max("batch")).first()[0] or 0  # from the folders' names
    table = table.where(F.col("batch") >= last - last % compact_every)
    fields = [c for c in table.columns if c not in ("experiment", "batch")]
    newest = table.groupBy("experiment").agg(F.max_by(F.struct(*fields), "batch").alias("row"))
    return newest.select("experiment", "row.*")


def live_alerts(long: DataFrame) -> DataFrame:
    """Threshold alerts, row by row; no state."""
    return runs.alerts(long)


class _PerRun(StatefulProcessor):
    """Shared part of the per-run folds: rows of a micro-batch in order, one state row per run."""

    state_schema = ""

    def __init__(self, order: str, metric: str) -> None:
        self.order, self.metric = order, metric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a run's rows of one micro-batch; maxFilesPerTrigger or the like bounds them
        yield self.fold(key[0], pd.concat(list(rows)).dropna(subset=[self.metric]).sort_values(self.order))

    def fold(self, run: str, rows: pd.DataFrame | dict[str, Sequence]) -> pd.DataFrame:
        """Take in rows that follow all rows before, by columns; returns what to give out."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Released(StatefulProcessor):
    """Rows in any order, released in order of their event time (``MILLIS``) when the watermark has passed.

    The rows of a run that wait are held in one value, so that a micro-batch costs a run a few calls to the
    state store. Where they are more than ``HELD``, they are put away frame by frame under the bucket of their
    event time. A timer stands at the end of the first open bucket; when it fires, the buckets that the watermark
    has passed are sorted and folded in turn, and forgotten. So a task holds one bucket of one run, or ``HELD`` rows,
    and the state holds what is later than the watermark.
    """

    #: Waiting rows of a run that are held in one value, and rows folded at once.
    HELD = 4096

    def __init__(self, fold: _PerRun, bucket_ms: int) -> None:
        self.inner, self.bucket_ms = fold, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)
        self.handle = handle
        rows = "times array<bigint>, orders array<bigint>, values array<double>"
        # rows in hand; buckets put away and their parts; the next timer, -1 if there is none
        self.held = handle.getValueState("held", f"{rows}, buckets array<bigint>, parts array<bigint>, timer bigint")
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.get()
        hand, away, timer = self._opened(known)
        for frame in rows:
            frame = frame[frame[self.inner.metric].notna()]
            columns = frame[MILLIS].tolist(), frame[self.inner.order].tolist(), frame[self.inner.metric].astype(float).tolist()
            hand += zip(*columns)
            if len(hand) > self.HELD:
                for bucket, own in self._by_bucket(hand).items():
                    self.waiting.updateValue((bucket, away.get(bucket, 0)), tuple(map(list, zip(*own))))
                    away[bucket] = away.get(bucket, 0) + 1
                hand = []
        if known or hand or away:
            self._keep(hand, away, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        known = self.held.get()
        if known is None:
            raise RuntimeError("the checkpoint is of an earlier layout of waiting rows")
        hand, away, _ = self._opened(known)
        ready, found = self._by_bucket(hand), []
        for bucket in sorted({*ready, *away}):
            if (bucket + 1) * self.bucket_ms > passed:
                break
            own = ready.pop(bucket, [])
            for part in range(away.pop(bucket, 0)):
                own += zip(*self.waiting.getValue((bucket, part)))
                self.waiting.removeKey((bucket, part))
            found += sorted(own)
            if len(found) > self.HELD:
                yield from self._folded(key[0], found)
                found = []
        yield from self._folded(key[0], found)
        self._keep([row for own in ready.values() for row in own], away, -1)

    def _opened(self, known: tuple | None) -> tuple[list[tuple], dict[int, int], int]:
        """Rows in hand, parts of each bucket put away, and the next timer."""
        if known is None:
            return [], {}, -1
        times, orders, values, buckets, parts, timer = known
        return list(zip(times, orders, values)), dict(zip(buckets, parts)), timer

    def _by_bucket(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        found: dict[int, list[tuple]] = {}
        for row in rows:
            found.setdefault(int(row[0] // self.bucket_ms), []).append(row)
        return found

    def _keep(self, hand: list[tuple], away: dict[int, int], timer: int) -> None:
        """Write what waits, with a timer at the end of its first bucket."""
        first = min([*away, *(int(row[0] // self.bucket_ms) for row in hand)], default=None)
        if first is not None and (timer < 0 or (first + 1) * self.bucket_ms < timer):
            timer = (first + 1) * self.bucket_ms
            self.handle.registerTimer(timer)
        columns = map(list, zip(*hand)) if hand else ([], [], [])
        self.held.update((*columns, list(away), list(away.values()), timer))

    def _folded(self, run: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            times, orders, values = zip(*rows)
            out = self.inner.fold(run, {self.inner.order: orders, self.inner.metric: values})
            if len(out):
                yield out

    def close(self) -> None:
        self.inner.close()


class EarlyStop(_PerRun):
    """Best value, rows since it, and the latched stop of every run."""

    state_schema = "best double, best_row bigint, rows bigint, stop_row bigint"
    output = "experiment string, best_value double, best_row bigint, rows bigint, should_stop boolean, stop_row bigint"

    def __init__(self, metric: str, patience: int, min_delta: float, mode: str, order: str) -> None:
        super().__init__(order, metric)
        self.patience, self.min_delta = patience, min_delta
        self.sign = 1.0 if mode == "max" else -1.0

    def fold(self, run: str, rows: pd.DataFrame | dict[str, Sequence]) -> pd.DataFrame:
        best, best_row, n, stop = self.state.get() or (float("-inf"), 0, 0, -1)
        for value in rows[self.metric]:
            n += 1
            if value * self.sign > best + self.min_delta:
                best, best_row = value * self.sign, n
            elif stop < 0 and n - best_row >= self.patience:
                stop = n
        self.state.update((float(best), int(best_row), int(n), int(stop)))
        return pd.DataFrame(
            {
                "experiment": [run],
                "best_value": [best * self.sign],
                "best_row": [best_row],
                "rows": [n],
                "should_stop": [stop >= 0],
                "stop_row": pd.array([stop if stop >= 0 else None], dtype="Int64"),
            }
        )


class Stagnation(_PerRun):
    """A row for every row of a run whose best lies ``window`` or more rows back."""

    state_schema = "best double, best_row bigint, rows bigint"
    output = "experiment string, step bigint, since_best bigint"

    def __init__(self, metric: str, window: int, order: str) -> None:
        super().__init__(order, metric)
        self.window = window

    def fold(self, run: str, rows: pd.DataFrame | dict[str, Sequence]) -> pd.DataFrame:
        best, best_row, n = self.state.get() or (float("-inf"), 0, 0)
        found = []
        for step, value in zip(rows[self.order], rows[self.metric]):
            n += 1
            if value > best or n == 1:
                best, best_row = value, n
            elif n - best_row >= self.window:
                found.append((run, int(step), n - best_row))
        self.state.update((float(best), int(best_row), int(n)))
        return pd.DataFrame(found, columns=["experiment", "step", "since_best"])


def _stateful(metrics: DataFrame, processor: _PerRun, mode: str, event_time: str | None, lateness: str, bucket_ms: int) -> DataFrame:
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    output, fold, time_mode = processor.output, processor, "None"
    if event_time:
        metrics = metrics.withWatermark(event_time, lateness).withColumn(MILLIS, F.unix_millis(event_time))
        fold, time_mode = _Released(processor, bucket_ms), "EventTime"
    return metrics.groupBy("experiment").transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=output, outputMode=mode, timeMode=time_mode
    )


def early_stop(
    metrics: DataFrame,
    metric: str = "eval_reward",
    patience: int = 5,
    min_delta: float = 0.001,
    mode: str = "max",
    order: str = "epoch",
    event_time: str | None = None,
    lateness: str = "10 minutes",
    bucket_ms: int = 60_000,
) -> DataFrame:
    """The state of every run that moved on, after each micro-batch.

    With ``event_time`` rows may come in any order, up to ``lateness`` late: they are folded in order of event
    time, then ``order``, a bucket of time at a time, once the watermark has passed it. Without, rows must
    arrive in order from batch to batch; within a batch they are sorted.
    """
    return _stateful(metrics, EarlyStop(metric, patience, min_delta, mode, order), "update", event_time, lateness, bucket_ms)


def stagnation(
    metrics: DataFrame,
    metric: str = "reward_mean",
    window: int = 100,
    order: str = "step",
    event_time: str | None = None,
    lateness: str = "10 minutes",
    bucket_ms: int = 60_000,
) -> DataFrame:
    """Stagnant rows as they arrive; order as for ``early_stop``."""
    return _stateful(metrics, Stagnation(metric, window, order), "append", event_time, lateness, bucket_ms)
