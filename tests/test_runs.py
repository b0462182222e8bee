"""Run analytics, console parsing and log files against plain Python on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rubrica.operators import console, ordering, rollout_stats, runs
from rubrica.sources import logs


def series(spark, data):
    rows = [(e, i, v) for e, values in data.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "experiment string, epoch int, eval_reward double")


def stop_of(values, patience, min_delta, mode):
    best, counter, stop, best_row = (float("-inf") if mode == "max" else float("inf")), 0, None, None
    n = 0
    for value in values:
        if value is None:
            continue
        n += 1
        if value > best + min_delta if mode == "max" else value < best - min_delta:
            best, counter, best_row = value, 0, n
        else:
            counter += 1
        if counter >= patience and stop is None:
            stop = n
    return best, best_row, n, stop


@pytest.mark.parametrize("limit, slice_rows", [(10**6, 10**5), (10**6, 3), (10, 4)])
@pytest.mark.parametrize("mode", ["max", "min"])
def test_early_stop(spark, limit, slice_rows, mode):
    rng = random.Random(3)
    data = {f"r{k}": [round(rng.uniform(0, 1), 3) for _ in range(40)] for k in range(6)}
    data["slow"] = [1.0, 1.0005, 1.001, 1.0011, 1.5, None, 1.4, 1.4, 1.4]
    data["rising"] = [i * 0.0004 for i in range(30)]
    data["flat"] = [0.5] * 12
    out = runs.early_stop(series(spark, data), "eval_reward", 4, 0.001, mode, limit=limit, slice_rows=slice_rows)
    got = {r["experiment"]: (r["best_value"], r["best_row"], r["rows"], r["stop_row"]) for r in out.collect()}
    assert got == {e: stop_of(v, 4, 0.001, mode) for e, v in data.items()}


@pytest.mark.parametrize("limit, slice_rows", [(10**6, 10**5), (10**6, 3), (10, 4)])
def test_stagnation(spark, limit, slice_rows):
    rng = random.Random(5)
    data = {f"r{k}": [rng.uniform(0, 1) for _ in range(50)] for k in range(3)}
    out = runs.stagnation(series(spark, data), "eval_reward", 5, "epoch", limit, slice_rows)
    for row in out.collect():
        values, i = data[row["experiment"]], row["epoch"]
        recent, old = values[max(0, i - 4) : i + 1], values[: max(0, i - 4)]
        assert row["stagnant"] == (bool(old) and max(recent) <= max(old))


def test_summary_and_latest(spark):
    rows = [("a", 0, 0, 10.0, 1.0, None), ("a", 1, 2, 13.0, float("nan"), 2.0), ("b", 0, None, 1.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "experiment string, pos int, epoch int, timestamp double, x double, y double")
    out = {r["experiment"]: r.asDict() for r in runs.summary_stats(df).collect()}
    assert out["a"]["total_steps"] == 2 and out["a"]["total_epochs"] == 2 and out["b"]["total_epochs"] == 0
    assert out["a"]["x_mean"] == 1.0 and out["a"]["x_std"] is None and out["a"]["x_latest"] != out["a"]["x_latest"]
    latest = {r["experiment"]: r for r in runs.latest_metrics(df).collect()}
    assert latest["a"]["elapsed_time"] == 3.0 and latest["a"]["y"] == 2.0
    status = {r["experiment"]: r for r in runs.status(df).collect()}
    assert status["a"]["step"] == 0 and status["a"]["elapsed"] == "00:00:03"
    summary = {r["experiment"]: r for r in runs.run_summary(df.withColumn("step", F.col("pos"))).collect()}
    assert summary["a"]["final_metrics"]["y"] == 2.0


def test_history_and_compare(spark):
    df = series(spark, {"a": [1.0, 2.0, 3.0], "b": [9.0]})
    kept = runs.metric_history(df, "eval_reward", "epoch", 2).where("experiment = 'a'")
    assert sorted(r["value"] for r in kept.collect()) == [2.0, 3.0]
    assert runs.metric_history(df, "absent", "epoch").count() == 0
    for limit in (10**6, 2):
        out = runs.compare(df, ["a", "b"], "eval_reward", "epoch", limit).orderBy("ordinal").collect()
        assert [(r["a"], r["b"]) for r in out] == [(1.0, 9.0), (2.0, None), (3.0, None)]
    assert runs.last_samples(df, ["epoch"], 0).count() == 4


@pytest.mark.parametrize("limit", [10**6, 5])
def test_number_rows(spark, limit):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(5)
    out = ordering.number_rows(df, ["g"], [F.col("k").desc(), F.col("i")], limit=limit).collect()
    for g in "ab":
        got = [(r["k"], r["i"]) for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["pos"])]
        assert got == sorted(((k, i) for h, k, i in rows if h == g), key=lambda x: (-x[0], x[1]))


PATTERNS = {
    "step": r"step[:\s]+(\d+)", "epoch": r"epoch[:\s]+(\d+)", "loss": r"loss[:\s]+([\d.]+)",
    "reward": r"reward[:\s]+([\d.]+)", "kl": r"kl[:\s]+([\d.]+)", "lr": r"lr[:\s]+([\d.e-]+)",
}


def console_of(lines):
    out, held = [], {}
    for line in lines:
        for key, pattern in PATTERNS.items():
            found = re.search(pattern, line.strip(), re.IGNORECASE)
            if found:
                try:
                    held[key] = float(found.group(1))
                except ValueError:
                    held[key] = found.group(1)
        if "step" in held and len(held) > 1:
            out.append(held)
            held = {}
    return out


@pytest.mark.parametrize("limit, slice_rows", [(10**6, 10**5), (10**6, 3), (20, 4)])
def test_console(spark, limit, slice_rows):
    rng = random.Random(11)
    kinds = ["step: {n}", "Step {n}", "loss: 0.{n}", "EPOCH: {n} lr: 1e-{n}", "step {n} reward: 1.{n}", "noise", "kl: 1.2.{n}", "step={n}"]
    files = {f"f{k}": [rng.choice(kinds).format(n=rng.randrange(9)) for _ in range(60)] for k in range(4)}
    rows = [(f, i, x) for f, lines in files.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, pos int, value string")
    out = console.parse_console(df, limit=limit, slice_rows=slice_rows).collect()
    for f, lines in files.items():
        got = []
        for r in sorted((r for r in out if r["file"] == f), key=lambda r: r["record"]):
            got.append({k: r["raw"].get(k, r[k]) for k in PATTERNS if r[k] is not None or k in r["raw"]})
        assert got == console_of(lines)


def test_log_folder(spark, tmp_path):
    (tmp_path / "a_metrics_x_metrics.jsonl").write_text(
        "\n".join(
            [
                '{"event": "train_begin", "timestamp": "t", "data": {}}',
                '{"step": 1, "epoch": 0, "timestamp": 1.5, "reward_mean": 0.5, "note": "n"}',
                "broken {", "123", "", '{"step": 2} x',
                '{"step": 2, "epoch": 0, "timestamp": 2.5, "reward_mean": 1, "extra": null}',
            ]
        )
    )
    (tmp_path / "b_metrics.jsonl").write_text('{"step": 7, "timestamp": 1, "flag": true}\n')
    (tmp_path / "samples.jsonl").write_text('{"step": 1, "prompt": "Alpha"}\nbad\n' + json.dumps({"p": "x" * 300}) + "\n")
    (tmp_path / "b_summary.json").write_text(json.dumps({"experiment_name": "b", "final_metrics": {"m": 1, "note": "x", "loss": 0.5}}, indent=2))
    folder = str(tmp_path)
    assert [r[0] for r in logs.list_experiments(spark, folder).collect()] == ["b", "a_metrics_x"]
    metrics = logs.read_metrics(spark, folder)
    assert metrics.count() == 3
    wide = logs.wide_metrics(metrics, {"step": "bigint", "reward_mean": "double"})
    assert sorted((r["experiment"], r["step"], r["reward_mean"]) for r in wide.collect()) == [
        ("a_metrics_x", 1, 0.5), ("a_metrics_x", 2, 1.0), ("b", 7, None),
    ]
    events = logs.read_events(spark, folder).collect()
    assert [(r["event"], r["data"]) for r in events] == [("train_begin", "{}")]
    stats = {(r["experiment"], r["metric"]): r for r in runs.summary_stats_long(logs.long_metrics(metrics)).collect()}
    assert set(stats) == {("a_metrics_x", "reward_mean")}
    assert stats["a_metrics_x", "reward_mean"]["latest"] == 1.0
    assert logs.read_samples(spark, folder).count() == 2
    assert logs.read_samples(spark, str(tmp_path / "none"), "b").count() == 0
    summary = logs.read_summaries(spark, folder).first()
    assert (summary["final_metrics"], summary["final_notes"]) == ({"m": 1.0, "loss": 0.5}, {"note": "x"})
    metric_lines = logs.line_numbers(logs.read_lines(spark, f"{folder}/a_metrics_x_metrics.jsonl"))
    sample_lines = logs.line_numbers(logs.read_lines(spark, f"{folder}/samples.jsonl"))
    hits = [r["hit"] for r in logs.search_logs(metric_lines, sample_lines, "ALPHA").collect()]
    assert hits == ['samples.jsonl:0: {"step": 1, "prompt": "Alpha"}']
    hits = [r["hit"] for r in logs.search_logs(metric_lines, sample_lines, "x").collect()]
    assert hits[0] == 'metrics.jsonl:5: {"step": 2} x' and len(hits[-1]) == len("samples.jsonl:2: ") + 200
    tail = logs.tail_lines(logs.read_lines(spark, f"{folder}/samples.jsonl"), 2).collect()
    assert [r["value"][:3] for r in tail] == ["bad", '{"p']


def test_written_summaries_samples_checkpoints(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a", i, 0, float(i), 0.5 * i) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "experiment string, step int, epoch int, timestamp double, reward double")
    logs.write_summary(runs.run_summary(df, "step"), folder)
    summary = logs.read_summaries(spark, folder).first()
    assert summary["total_steps"] == 1000 and summary["duration_seconds"] == 999.0
    assert summary["final_metrics"] == {"reward": 500.0}
    points = runs.every_n_steps(df, 100).select(
        "experiment", "step", F.col("timestamp").cast("string").alias("timestamp"), F.create_map(F.lit("m"), "reward").alias("metrics")
    )
    logs.append_checkpoints(points, folder)
    (tmp_path / "checkpoint_step50_info.json").write_text('{"step": 50, "timestamp": "t", "metrics": {}}')
    found = logs.read_checkpoints(spark, folder)
    assert found.count() == 11
    kept = runs.kept_checkpoints(found.where("experiment = 'a'"))
    assert sorted(r["step"] for r in kept.collect()) == [600, 700, 800, 900, 1000]
    samples = df.select("step", F.lit("t").alias("timestamp"), F.lit("p").alias("prompt"), F.lit("r").alias("response"), "reward")
    logs.append_samples(runs.capped_samples(samples, ["step"], [], 100).drop("pos"), folder)
    assert logs.read_samples(spark, folder).count() == 100


def test_sample_log_ends_at_its_limit(spark, tmp_path):
    folder = str(tmp_path)
    schema = "experiment string, step int, response string"
    rows = [("a", k, f"r{k}") for k in range(70)] + [("b", k, "x") for k in range(8)] + [(None, k, "n") for k in range(12)]
    for k in range(0, 70, 20):
        part = [r for r in rows if k <= r[1] < k + 20]
        logs.append_samples(spark.createDataFrame(part, schema).repartition(3), folder, max_samples=50)
    held = spark.read.schema(schema).json(f"{folder}/samples.jsonl").collect()
    assert sorted((r for r in held), key=repr) == sorted(((e, s, t) for e, s, t in rows if e != "a" or s < 50), key=repr)
    one = str(tmp_path / "one")
    for k in (0, 30):
        logs.append_samples(spark.createDataFrame([(k + j,) for j in range(30)], "step int"), one, max_samples=40)
    assert sorted(r.step for r in spark.read.json(f"{one}/samples.jsonl").collect()) == list(range(40))


def test_kept_checkpoints_are_the_newest(spark, tmp_path):
    folder = str(tmp_path)
    schema = "experiment string, step int, timestamp string, metrics map<string, double>"

    def save(steps, value, run="a"):
        return logs.keep_checkpoints(spark.createDataFrame([(run, s, "t", {"m": value}) for s in steps], schema), folder)

    def held():
        return sorted((r.experiment, r.step, r.metrics["m"]) for r in logs.read_checkpoints(spark, folder).collect())

    assert save([0, 50, 100, 200, 300], 1.0) == 0
    assert held() == [("a", s, 1.0) for s in (100, 200, 300)]
    save([400, 500, 300], 2.0)
    assert held() == [("a", 100, 1.0), ("a", 200, 1.0), ("a", 300, 2.0), ("a", 400, 2.0), ("a", 500, 2.0)]
    assert save([600, 100], 3.0, "b") == 2
    assert save(range(600, 1300, 100), 4.0) == 3
    assert held() == [*[("a", s, 4.0) for s in range(800, 1300, 100)], ("b", 100, 3.0), ("b", 600, 3.0)]
    table = tmp_path / "kept_checkpoints"
    assert sorted(p.name for p in table.glob("version=*")) == ["version=2", "version=3"]
    (table / "version=4").mkdir()  # a writer lost before its end
    assert len(held()) == 7 and save([1300], 5.0, "b") == 4


def test_lines_as_trainers_write_them(spark):
    rows = ['{"loss": 1.5, "kl": 0.1}', '{"loss": NaN, "kl": Infinity}', '{"loss": 2, "loss": 0.5}', '{"a": 1} x', '{"a": 1}{"b": 2}',
            '{"a": 1}, {"b": 2}', "[1]", "", None, '{"a": [1, {"b": NaN}]} ']
    lines = spark.createDataFrame([(k, "r", v) for k, v in enumerate(rows)], "pos int, experiment string, value string")
    assert [r["pos"] for r in logs.records(lines).orderBy("pos").collect()] == [0, 1, 2, 9]
    assert [r["pos"] for r in logs.malformed(lines).orderBy("pos").collect()] == [3, 4, 5, 6, 7, 8]
    long = logs.long_metrics(logs.records(lines))
    stats = {r["metric"]: r for r in runs.summary_stats_long(long, "pos").collect()}
    assert (stats["loss"]["values"], stats["loss"]["mean"], stats["loss"]["latest"]) == (2, 1.0, None)
    assert stats["kl"]["max"] == float("inf") and stats["kl"]["latest"] is None


def test_appends_keep_their_order(spark, tmp_path):
    schema = "experiment string, step int, epoch int, timestamp double, logs map<string, double>"

    def rows(first, last):
        return spark.createDataFrame([("a", k, 0, float(k), {"x": float(k)}) for k in range(first, last)], schema).repartition(7)

    for first, last in ((0, 5), (5, 500), (500, 503)):
        logs.append_metrics(rows(first, last), str(tmp_path))
    metrics = logs.wide_metrics(logs.read_metrics(spark, str(tmp_path)), {"step": "bigint", "timestamp": "double", "x": "double"})
    last = runs.latest_metrics(metrics.drop("file"), "pos").first()
    assert (last["step"], last["elapsed_time"]) == (502, 502.0)
    assert [r["step"] for r in metrics.orderBy("pos").collect()] == list(range(503))
    numbered = logs.line_numbers(logs.read_lines(spark, f"{tmp_path}/*_metrics.jsonl")).orderBy("line").collect()
    assert [r["line"] for r in numbered] == list(range(503)) and len({r["file"] for r in numbered}) == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "loss", 0.5), (1, "kl", 0.1), (2, "loss", 0.4)], "step int, tag string, value double")
    wide = logs.pivot_scalars(df, ["loss", "kl"]).orderBy("step").collect()
    assert [tuple(r) for r in wide] == [(1, 0.5, 0.1), (2, 0.4, None)]
    df.write.parquet(str(tmp_path / "h"))
    df.write.option("header", True).csv(str(tmp_path / "h.csv"))
    df.write.json(str(tmp_path / "h.jsonl"))
    for name in ("h", "h.csv", "h.jsonl"):
        assert logs.read_history(spark, str(tmp_path / name)).agg(F.sum("value")).first()[0] == 1.0


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "big.log").write_text("\n".join(texts) + "\n")
    (tmp_path / "small.log").write_text("one\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for limit in (10**6, 500):
            lines = logs.read_lines(spark, str(tmp_path))
            out = logs.line_numbers(lines, limit).where("file LIKE '%big%'").orderBy("line").collect()
            assert [r["value"] for r in out] == texts and [r["line"] for r in out] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("limit, slice_rows", [(10**6, None), (10**6, 3), (10, 4)])
@pytest.mark.parametrize("gamma, lam", [(1.0, 0.95), (0.9, 0.0), (1.0, 1.0), (0.5, 0.1)])
def test_gae(spark, limit, slice_rows, gamma, lam):
    rng = random.Random(2)
    data = {s: [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n)] for s, n in enumerate([1, 2, 30, 13])}
    rows = [(s, t, r, v) for s, seq in data.items() for t, (r, v) in enumerate(seq)]
    df = spark.createDataFrame(rows, "seq int, t int, reward double, value double")
    out = rollout_stats.gae(df, "seq", "t", gamma=gamma, lam=lam, limit=limit, slice_rows=slice_rows)
    got = {(r["seq"], r["t"]): (r["advantage"], r["return"]) for r in out.collect()}
    for s, seq in data.items():
        following, advantage = 0.0, 0.0
        for t in reversed(range(len(seq))):
            r, v = seq[t]
            advantage = r + gamma * following - v + gamma * lam * advantage
            following = v
            assert got[s, t] == pytest.approx((advantage, advantage + v))


def test_appends_of_many_runs_share_few_files(spark, tmp_path):
    names = [f"run {k}+/\t%" for k in range(300)] + ["a_metrics", ""]
    schema = "experiment string, step int, epoch int, timestamp double, logs map<string, double>"
    for first in (0, 3):
        rows = [(n, k, 0, float(k), {"x": float(k)}) for n in names for k in range(first, first + 3)]
        logs.append_metrics(spark.createDataFrame(rows, schema).repartition(5), str(tmp_path))
    events = [(n, "start", "t", {"k": n}) for n in names]
    logs.append_events(spark.createDataFrame(events, "experiment string, event string, timestamp string, data map<string, string>"), str(tmp_path))
    assert len(list(tmp_path.rglob("part-*"))) < 100
    (tmp_path / "own_metrics.jsonl").write_text('{"step": 0, "tab": "\\t"}\n')
    metrics = logs.wide_metrics(logs.read_metrics(spark, str(tmp_path)), {"step": "bigint"}).orderBy("pos").collect()
    found = {}
    for r in metrics:
        found.setdefault(r["experiment"], []).append(r["step"])
    assert found == {n: list(range(6)) for n in names} | {"own": [0]}
    back = logs.read_events(spark, str(tmp_path)).collect()
    assert {r["experiment"]: json.loads(r["data"])["k"] for r in back} == {n: n for n in names} and len(back) == len(names)
    listed = [r[0] for r in logs.list_experiments(spark, str(tmp_path)).collect()]
    assert sorted(listed) == sorted([*names, "own"])
