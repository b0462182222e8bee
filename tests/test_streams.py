"""Streams against their batch twins, and the append-aware line source."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rubrica.operators import runs
from rubrica.session import fresh_path
from rubrica.streaming import live, tail

SCHEMA = "experiment string, epoch bigint, eval_reward double"


def drain(stream, spark, mode="append"):
    """Run a stream over what there is; returns its rows with the batch number."""
    path = fresh_path(spark, "out")

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", fresh_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def batches(spark, tmp_path, sizes=(7, 1, 30, 12)):
    """Rows of three runs in several files, read one file per micro-batch."""
    rng = random.Random(4)
    rows, epoch = [], 0
    for k, size in enumerate(sizes):
        part = []
        for _ in range(size):
            part += [(f"r{j}", epoch, round(rng.uniform(0, 1), 3)) for j in range(3)]
            epoch += 1
        rng.shuffle(part)
        lines = "\n".join(json.dumps(dict(zip(("experiment", "epoch", "eval_reward"), r))) for r in part)
        (tmp_path / f"{k}.json").write_text(lines)
        rows += part
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    return stream, spark.createDataFrame(rows, SCHEMA)


def test_early_stop_equals_batch(spark, tmp_path):
    stream, table = batches(spark, tmp_path)
    for k in range(4):  # files are taken in order of age
        os.utime(tmp_path / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    out = drain(live.early_stop(stream, patience=6, min_delta=0.01), spark, "update")
    assert out.select("batch").distinct().count() > 1
    newest = out.groupBy("experiment").agg(F.max_by(F.struct(*[c for c in out.columns if c != "batch"]), "batch").alias("s"))
    want = runs.early_stop(table, patience=6, min_delta=0.01)
    key = lambda df: sorted(tuple(r) for r in df.select(*want.columns).collect())
    assert key(newest.select("s.*")) == key(want)


def test_stagnation_equals_batch(spark, tmp_path):
    stream, table = batches(spark, tmp_path)
    for k in range(4):
        os.utime(tmp_path / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    out = drain(live.stagnation(stream, "eval_reward", 5, "epoch"), spark)
    want = runs.stagnation(table, "eval_reward", 5, "epoch").where("stagnant")
    got = sorted((r["experiment"], r["step"], r["since_best"]) for r in out.collect())
    assert got == sorted((r["experiment"], r["epoch"], r["since_best"]) for r in want.collect())


def test_rotated_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("three\n")
    out = drain(live.rotated_lines(spark, str(tmp_path)), spark)
    assert sorted(r["value"] for r in out.collect()) == ["one", "three", "two"]


def test_tail_reads_appended_lines_once(spark, tmp_path):
    log = tmp_path / "run.log"
    texts = [f"line {i} 日志" for i in range(200)]
    log.write_text("\n".join(texts[:50]) + "\npart", encoding="utf8")
    seen = []
    lines = live.watch_lines(spark, str(tmp_path / "*.log"), range_bytes=100)
    checkpoint = fresh_path(spark, "checkpoint")

    def run():
        query = (
            lines.writeStream.foreachBatch(lambda rows, _: seen.extend(r["value"] for r in rows.orderBy("offset").collect()))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    assert seen == texts[:50]  # the unfinished line waits
    with open(log, "a", encoding="utf8") as file:
        file.write("ial\n" + "\n".join(texts[50:]) + "\n")
    run()
    assert seen == [*texts[:50], "partial", *texts[50:]]


def follow(reader, state):
    """What one micro-batch reads, in the order of its partitions."""
    end = reader.latestOffset()
    rows = [row[2] for part in reader.partitions(state, end) for row in reader.read(part)]
    state.clear()
    state.update(end)
    return rows


def test_tail_survives_rotation(tmp_path):
    log, state = tmp_path / "run.log", {}
    reader = tail.TailReader({"path": f"{tmp_path}/*.log"})
    assert follow(reader, state) == []
    log.write_text("a1\na2\n")
    assert follow(reader, state) == ["a1", "a2"]
    with log.open("a") as file:  # written, then renamed before the next poll
        file.write("a3\n")
    log.rename(tmp_path / "run.log.1")
    log.write_text("b1\n")
    assert sorted(follow(reader, state)) == ["a3", "b1"]
    log.write_text("c1\n")  # cut short and written anew, as long as before
    assert follow(reader, state) == ["c1"]
    log.write_text("")
    assert follow(reader, state) == []
    log.write_text("d1\nd2\nd3\n")
    assert follow(reader, state) == ["d1", "d2", "d3"]
    log.unlink()
    assert follow(reader, state) == []
    log.write_text("e1\n")
    assert follow(reader, state) == ["e1"]
    (tmp_path / "run.log.1").rename(tmp_path / "old.log")  # the pattern matches it now: nothing twice
    assert follow(reader, state) == []


def test_tail_finds_a_renamed_file_again_when_it_reads(tmp_path):
    log = tmp_path / "run.log"
    log.write_text("a1\na2\n")
    reader = tail.TailReader({"path": str(log)})
    parts = reader.partitions({}, reader.latestOffset())
    log.rename(tmp_path / "run.log.1")
    log.write_text("other\n")
    assert [row[2] for part in parts for row in reader.read(part)] == ["a1", "a2"]
    (tmp_path / "run.log.1").unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    lossy = tail.TailReader({"path": str(log), "failOnDataLoss": "false"})
    assert list(lossy.read(parts[0])) == []


def test_tail_takes_a_batch_at_a_time(tmp_path):
    texts = [f"line {k} " + "x" * (1 + k % 50) for k in range(400)]
    (tmp_path / "a.log").write_text("\n".join(texts[:300]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(texts[300:]) + "\nunfinished")
    options = {"path": f"{tmp_path}/*.log", "maxBytesPerBatch": "900", "state": f"{tmp_path}/state"}
    state, seen, reader = {}, [], tail.TailReader(options)
    for k in range(200):
        if k % 5 == 4:
            reader = tail.TailReader(options)  # a restart: only the notes tell where it was
        rows = follow(reader, state)
        assert sum(map(len, rows)) <= 1000
        seen += rows
        if not rows:
            break
    assert sorted(seen) == sorted(texts) and k > 10
    with pytest.raises(ValueError):
        tail.TailReader({"path": "x", "maxBytesPerBatch": "5"})


def test_patterns_and_addresses(tmp_path):
    for name in ("a/x.log", "b/y.log", "b/y.txt", "b/c/z.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name + "\n")
    for prefix in ("", "file:", "file://"):
        assert sorted(follow(tail.TailReader({"path": f"{prefix}{tmp_path}/*/*.log"}), {})) == ["a/x.log", "b/y.log"]


def test_ranges_cover_every_line_once(tmp_path):
    log = tmp_path / "x.log"
    texts = ["", "a", "bb" * 40, "c", "", "dd" * 7] * 9
    log.write_text("\n".join(texts) + "\n")
    for size in (1, 2, 3, 7, 50, 10_000):
        reader = tail.TailReader({"path": str(log), "rangeBytes": str(size)})
        end = reader.latestOffset()
        found = [row for part in reader.partitions({}, end) for row in reader.read(part)]
        assert [row[2] for row in found] == texts


def test_dedup_within_watermark(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "t": "2024-01-01T00:00:00"}\n{"k": 1, "t": "2024-01-01T00:00:01"}\n')
    stream = spark.readStream.schema("k int, t timestamp").json(str(tmp_path))
    assert drain(live.distinct_metrics(stream, "t", ["k"]), spark).count() == 1


def shuffled(spark, tmp_path):
    """Rows of three runs in any order over five files; the last row only closes what is open."""
    rng = random.Random(8)
    rows = [(f"r{j}", k, None if k % 9 == 4 else round(rng.uniform(0, 1), 3), f"2024-01-01T00:{k:02d}:{7 * j:02d}") for j in range(3) for k in range(50)]
    table = spark.createDataFrame(rows, f"{SCHEMA}, at string")
    rng.shuffle(rows)
    parts = [rows[k::4] for k in range(4)] + [[("end", 0, 0.0, "2025-01-01T00:00:00")]]
    for k, part in enumerate(parts):
        lines = "\n".join(json.dumps(dict(zip(("experiment", "epoch", "eval_reward", "at"), r))) for r in part)
        (tmp_path / f"{k}.json").write_text(lines)
        os.utime(tmp_path / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(f"{SCHEMA}, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    return stream, table


@pytest.mark.parametrize("bucket_ms", [60_000, 17 * 60_000])
def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path, bucket_ms):
    stream, table = shuffled(spark, tmp_path)
    timed = {"event_time": "at", "lateness": "2 hours", "bucket_ms": bucket_ms}
    out = drain(live.early_stop(stream, patience=6, min_delta=0.01, **timed), spark, "update").where("experiment <> 'end'")
    want = runs.early_stop(table, patience=6, min_delta=0.01)
    newest = out.groupBy("experiment").agg(F.max_by(F.struct(*want.columns[1:]), "rows").alias("s"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(newest.select("experiment", "s.*")) == key(want)
    found = drain(live.stagnation(stream, "eval_reward", 5, "epoch", **timed), spark).where("experiment <> 'end'")
    stagnant = runs.stagnation(table, "eval_reward", 5, "epoch").where("stagnant").select("experiment", "epoch", "since_best")
    assert key(found.select("experiment", "step", "since_best")) == key(stagnant)


def test_buckets_close_once_and_count_a_row_once(spark, tmp_path):
    stream, table = shuffled(spark, tmp_path)
    for k in range(4):  # every file is delivered again
        (tmp_path / f"again{k}.json").write_text((tmp_path / f"{k}.json").read_text())
        os.utime(tmp_path / f"again{k}.json", (1_000_001 + k, 1_000_001 + k))
    rows = stream.selectExpr("experiment", "epoch", "at", "eval_reward AS score", "experiment AS response")
    out = drain(live.bucketed_metrics(rows, "at", ["experiment", "epoch"], "10 minutes", lateness="2 hours"), spark)
    assert sorted(r.responses for r in out.collect()) == [30] * 5
    by_run = live.bucketed_metrics(rows, "at", ["experiment", "epoch"], "1 hour", ["experiment"], "2 hours")
    got = {r.experiment: (r.responses, r.reward_max) for r in drain(by_run, spark).where("experiment <> 'end'").collect()}
    want = {r.experiment: (50, r.m) for r in table.groupBy("experiment").agg(F.max("eval_reward").alias("m")).collect()}
    assert got == want


def test_a_refresh_writes_the_changed_runs(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "summary"), str(tmp_path / "checkpoint")
    source.mkdir()
    seen = []
    for k in range(5):
        rows = [("all", k, float(k)), (f"r{k % 2}", k, 1.0 + k)]
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("experiment", "epoch", "eval_reward"), r))) for r in rows))
        seen += rows
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        summary = live.running_summary(stream, ["eval_reward"], "epoch")
        live.summary_sink(summary, path, checkpoint, refresh=None, compact_every=3).start().awaitTermination()
    batches = {r["batch"]: r["n"] for r in spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert batches == {0: 2, 1: 2, 2: 2, 3: 3, 4: 2}  # the fourth holds every run
    want = runs.summary_stats(spark.createDataFrame(seen, SCHEMA), "epoch", ["eval_reward"])
    newest = live.newest_summary(spark, path, compact_every=3)
    assert sorted(newest.select(*want.columns).collect()) == sorted(want.collect())


def test_metric_sink_writes_few_files_for_many_runs(spark, tmp_path):
    rows = [(f"r{k}/=%", k % 7, float(k)) for k in range(500)] + [("", 1, 0.5), (None, 2, 0.25)]
    spark.createDataFrame(rows, SCHEMA).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
    for order in (None, "epoch"):
        out = f"{tmp_path}/out{order}"
        live.metric_sink(stream, out, fresh_path(spark, "checkpoint"), order).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(out)
        assert sorted((tuple(r) for r in found.select("experiment", "epoch", "eval_reward").collect()), key=repr) == sorted(rows, key=repr)
        assert len(list((tmp_path / f"out{order}").rglob("part-*.parquet"))) <= 16 * 4
        assert found.where(F.col("bucket") != live.run_bucket(F.col("experiment"))).count() == 0


class _Store:
    """A state variable of one run, counting its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.rows = calls, None, {}

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self.rows

    def getValue(self, key):
        self.calls.append("getValue")
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.rows[key] = value

    def removeKey(self, key):
        self.calls.append("removeKey")
        del self.rows[key]


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, *_):
        return _Store(self.calls)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


class _Now:
    def __init__(self, at):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at


@pytest.mark.parametrize("held", [4096, 5])
def test_waiting_rows_cost_a_run_few_calls(held):
    import pandas as pd

    rng = random.Random(3)
    rows = [(k * 10, k, rng.uniform(0, 1)) for k in range(300)]
    want = live.EarlyStop("m", 6, 0.01, "max", "step")
    want.init(_Handle())
    last = want.fold("r", {"step": [r[1] for r in rows], "m": [r[2] for r in rows]})
    shuffled_rows = rng.sample(rows, len(rows))
    released, handle, out = live._Released(live.EarlyStop("m", 6, 0.01, "max", "step"), 100), _Handle(), []
    released.HELD = held
    released.init(handle)
    for part in range(3):
        frame = pd.DataFrame(shuffled_rows[part::3], columns=[live.MILLIS, "step", "m"])
        list(released.handleInputRows(("r",), iter([frame]), _Now(0)))
    for watermark in (1_000, 10_000):
        while due := [at for at in handle.timers if at < watermark]:
            handle.timers.discard(min(due))
            now = _Now(watermark)
            now.getExpiryTimeInMs = lambda at=min(due): at
            out += list(released.handleExpiredTimer(("r",), now, now))
    assert out[-1].equals(last)
    assert held == 5 or len(handle.calls) < 30  # 30 buckets
