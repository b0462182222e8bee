"""Dataset shaping, validation, splits, files, chat templates, evaluation, judge plumbing."""

import json

import pytest
from pyspark.sql import functions as F

from rubrica.functions.display import chat_prompt, sample_text
from rubrica.operators import evaluation, judging, prep
from rubrica.sources.scores import ScoreCache
from rubrica.sources import datasets


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def lines(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "row_id int, value string")


def test_sft(spark):
    data = [("a", None, "o"), ("b", "", "o"), ("c", "x", "o"), (None, "y", None)]
    df = spark.createDataFrame(data, "instruction string, input string, output string")
    assert [tuple(r) for r in prep.prepare_sft(df).collect()] == [
        ("a", "o"), ("b", "o"), ("c\n\n输入: x", "o"), ("\n\n输入: y", None),
    ]
    assert prep.prepare_sft(df.drop("input")).first()["prompt"] == "a"


def test_missing_key_is_empty_null_stays(spark):
    df = lines(spark, ['{"prompt": null}', '{"ground_truth": "g", "data_source": "other"}'])
    out = [tuple(r) for r in prep.prepare_rl(df, data_source="s", raw="value").collect()]
    assert out == [(None, "", "s"), ("", "g", "s")]
    dpo = [tuple(r) for r in prep.prepare_dpo(df, chosen="ground_truth", raw="value").collect()]
    assert dpo == [(None, "", ""), ("", "g", "")]


def test_validation(spark):
    good = lines(spark, ['{"a": null, "b": 1}', '{"b": 2, "a": 3}'])
    assert tuple(prep.validate(good, ["a", "b"]).first())[:3] == (True, 2, 0)
    bad = lines(spark, ['{"a": 1, "b": 1}', "{}", "[1]", "nonsense"])
    assert tuple(prep.validate(bad, ["a", "b"]).first()) == (False, 4, 3, 1, ["a", "b"])
    assert prep.validate(bad.limit(0), ["a"]).first()["valid"] is False
    assert prep.missing_columns(bad) == ["prompt", "chosen", "rejected"]


@pytest.mark.parametrize("limit", [1_000_000, 3])
@pytest.mark.parametrize("n, ratio", [(1000, 0.1), (7, 0.5), (10, 0.0), (10, 1.0), (0, 0.1)])
def test_split_is_exact(spark, n, ratio, limit):
    df = spark.range(n)
    out = prep.split_train_val(df, ["id"], ratio, limit=limit)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    cut = int(n * (1 - ratio))
    assert got == {k: v for k, v in (("train", cut), ("val", n - cut)) if v}
    assert out.select("id").distinct().count() == n
    again = prep.split_train_val(df.repartition(7), ["id"], ratio, limit=limit)
    assert rows(again, "id") == rows(out, "id")
    ordered = prep.split_train_val(df, ["id"], ratio, shuffle=False, limit=limit)
    assert all(r["split"] == ("train" if r["id"] < cut else "val") for r in ordered.collect())


def test_split_of_copies(spark):
    """A third of the rows share one key; the sizes stay exact."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    out = prep.split_train_val(df, ["k"], 0.3, limit=100)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 2100, "val": 900}


def test_length_rules(spark):
    df = spark.createDataFrame([("a b c",), ("a  b",), ("",)], "prompt string")
    assert [r[0] for r in prep.drop_overlong(df, 2).collect()] == ["a  b", ""]
    counter = prep.token_counter(len)
    assert [r[0] for r in prep.drop_overlong(df, 4, tokens=counter).collect()] == ["a  b", ""]
    cut = df.select(*[prep.truncate(F.col("prompt"), 2, m).alias(m) for m in ("right", "left")]).collect()
    assert [tuple(r) for r in cut] == [("a ", " c"), ("a ", " b"), ("", "")]
    cut = df.select(*[prep.truncate_tokens(F.col("prompt"), 2, m).alias(m) for m in ("right", "left")]).collect()
    assert [tuple(r) for r in cut] == [("a b", "b c"), ("a b", "a b"), ("", "")]
    with pytest.raises(Exception, match="longer than 2"):
        df.select(prep.truncate_tokens(F.col("prompt"), 2, "error")).collect()
    with pytest.raises(Exception, match="longer than 2"):
        df.select(prep.truncate(F.col("prompt"), 2, "error")).collect()


def test_conversations(spark):
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(25)], "conv_id int, turn int, role string, text string")
    (out,) = prep.conversations(turns).collect()
    assert [m["content"] for m in out["conversations"]] == [f"t{t}" for t in range(25)]


def test_json_files(spark, tmp_path):
    path = tmp_path / "in.json"
    records = [{"prompt": "你好", "ground_truth": "1", "data_source": "m"}, {"prompt": "q", "ground_truth": None}]
    path.write_text(json.dumps(records, ensure_ascii=False, indent=2), encoding="utf8")
    table = datasets.json_to_parquet(spark, str(path), str(tmp_path / "t.parquet"), datasets.SCHEMAS["rl"])
    back = datasets.parquet_to_json(spark, table, str(tmp_path / "out.jsonl"))
    text = "".join(p.read_text(encoding="utf8") for p in sorted((tmp_path / "out.jsonl").glob("part-*")))
    assert '"你好"' in text and '"ground_truth":null' in text
    assert rows(datasets.load_dataset(spark, back, datasets.SCHEMAS["rl"]), "prompt") == rows(
        datasets.load_dataset(spark, table), "prompt"
    )
    single = tmp_path / "one.json"
    single.write_text('{"prompt": "p"}')
    assert datasets.load_dataset(spark, str(single)).count() == 1
    (tmp_path / "empty.json").write_text("[]")
    assert datasets.load_dataset(spark, str(tmp_path / "empty.json"), datasets.SCHEMAS["rl"]).count() == 0
    df = spark.createDataFrame([("a\"b\nc", 1)], "x string, y int")
    with pytest.raises(ValueError):
        datasets.write_results(df, str(tmp_path / "r.xlsx"))
    for name in ("r.csv", "r.parquet", "r.json"):
        written = datasets.write_results(df, str(tmp_path / name))
        reader = datasets.read_json_lines if written.endswith(".json") else datasets.load_dataset
        assert reader(spark, written).first()["x"] == 'a"b\nc'


def test_chat_templates(spark):
    def shown(template, system):
        return spark.range(1).select(chat_prompt(F.lit("P"), system, template)).first()[0]

    assert shown("chatml", F.lit("S")) == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\n"
    )
    assert shown("chatml", None) == "<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\n"
    assert shown("llama", F.lit("S")) == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nP [/INST]"
    assert shown("llama", F.lit("")) == "<s>[INST] P [/INST]"
    assert shown("anything", F.lit("S")) == "S\n\n用户: P\n\n助手: "


def test_sample_text(spark):
    none = F.lit(None)
    df = spark.range(1).select(
        sample_text(F.lit(3), F.lit(1234.5), F.lit("p" * 201), none.cast("string"), F.lit("g")).alias("a"),
        sample_text(none.cast("int"), none.cast("double"), F.lit("p"), F.lit("r"), none.cast("string")).alias("b"),
    )
    assert df.first()["a"] == f"**Step:** 3\n\n**Reward:** 1234.5000\n\n**Prompt:** {'p' * 200}...\n\n**Ground Truth:** g"
    assert df.first()["b"] == "**Prompt:** p\n\n**Response:** r"


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_evaluation_pairs_by_position(spark, limit):
    items = spark.createDataFrame([(9, "a", "x"), (5, "b", "y"), (7, "c", "z")], "n int, prompt string, id string")
    answers = spark.createDataFrame([(1, "r1"), (2, "r2")], "k int, response string")
    out = evaluation.assemble(items, answers, [F.col("n")], [F.col("k")], hidden=["n"], limit=limit)
    assert out.columns == ["id", "prompt", "response", "ground_truth"]
    assert rows(out, "id") == [("y", "b", "r1", ""), ("z", "c", "r2", "")]


def test_judge_calls_retry_and_cache(spark, tmp_path):
    log = tmp_path / "calls"

    def client(body):
        with open(log, "a") as file:
            file.write("x")
        if "broken" in body:
            raise RuntimeError
        return json.dumps({"choices": [{"message": {"content": '{"score": 7}'}}]})

    data = [("math", "p", "fine", "1"), ("math", "p", "fine", "1"), (None, "p", "broken", None)]
    df = spark.createDataFrame(data, "preset string, prompt string, response string, ground_truth string").coalesce(1)
    left = judging.unscored(df, spark.createDataFrame([], "request_key string, cached_score double"))
    out = judging.judged(judging.call_judge(judging.with_request(left), client, tries=3, pause=0.0)).collect()
    assert {r["response"]: r["score"] for r in out} == {"fine": 0.7, "broken": 0.5}
    replies = spark.createDataFrame([(client("x"),), (None,)], "reply string")
    normal = judging.judged(replies, method="linear", scale=0.5, bias=0.1, default=0.2).collect()
    assert sorted(round(r["score"], 6) for r in normal) == [0.2, 0.45]
    assert len(log.read_text()) == 5
    cache = judging.request_key(df.where("response = 'fine'")).select(
        "request_key", F.lit(0.7).alias("score"), F.lit(100.0).alias("scored_at")
    )
    assert judging.unscored(df, judging.fresh(cache, now=200.0)).count() == 1
    assert judging.unscored(df, judging.fresh(cache, now=9000.0)).count() == 2
    assert judging.with_cached(df, judging.fresh(cache, now=200.0)).where("cached_score = 0.7").count() == 2


def test_second_run_asks_nothing(spark, tmp_path):
    log = tmp_path / "calls"

    def client(body):
        with open(log, "a") as file:
            file.write("x")
        if "broken" in body and len(log.read_text()) < 9:
            raise RuntimeError
        return json.dumps({"choices": [{"message": {"content": '{"score": 7}'}}]})

    data = [("math", "p", "fine", "1"), ("math", "p", "fine", "1"), (None, "p", "other", None), (None, "p", "broken", None)]
    df = spark.createDataFrame(data, "preset string, prompt string, response string, ground_truth string").coalesce(1)
    store = ScoreCache(spark, str(tmp_path / "scores"), buckets=3)

    def run(now):
        out = judging.score_with_cache(df, store, client, now=now, tries=2, pause=0.0).collect()
        return sorted((r.response, r.score) for r in out), len(log.read_text())

    first = [("broken", 0.5), ("fine", 0.7), ("fine", 0.7), ("other", 0.7)]
    assert run(100.0) == (first, 4)  # the broken one twice
    assert run(200.0) == (first, 6)
    store.compact(now=200.0)
    log.write_text("x" * 10)
    last = [("broken", 0.7), ("fine", 0.7), ("fine", 0.7), ("other", 0.7)]
    assert run(300.0) == (last, 11)
    assert run(400.0) == (last, 11)  # all is known
    assert run(3800.0) == (last, 13)  # two are too old, the third is not
    store.compact(now=3800.0)
    assert store.rows().count() == 3 and ScoreCache(spark, str(tmp_path / "scores")).fresh(now=3800.0).count() == 3


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cached_scores_stay_in_place(spark, tmp_path):
    def client(body):
        if "broken" in body:
            raise RuntimeError
        return json.dumps({"choices": [{"message": {"content": '{"score": 7}'}}]})

    def second(body):
        return json.dumps({"choices": [{"message": {"content": '{"score": 9}'}}]})

    responses = [f"{'broken' if n % 5 == 0 else 'fine'} {n % 100}" for n in range(300)]
    data = [(n, "math", "p", text, "1") for n, text in enumerate(responses)]
    schema = "n int, preset string, prompt string, response string, ground_truth string"
    df = spark.createDataFrame(data, schema).repartition(3)
    store = ScoreCache(spark, str(tmp_path / "scores"), buckets=8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judging.score_with_cache(df, store, client, now=100.0, tries=1, pause=0.0)
        store.compact(now=200.0)
        out = judging.score_with_cache(df, store, second, now=200.0, tries=1, pause=0.0)
        assert _exchanges(store.fresh(now=200.0)) == 0  # a snapshot and an append
        assert _exchanges(out.select("n", "score")) == 1  # the requests', to the scores
        assert out.columns == ["request_key", *df.columns, "score"]
        assert {r.n: r.score for r in out.collect()} == {n: 0.9 if n % 5 == 0 else 0.7 for n in range(300)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert store.rows().count() == 100


def test_scores_of_other_layouts(spark, tmp_path):
    path = str(tmp_path / "it's scores")
    schema = "request_key string, score double, scored_at double, bucket int"
    old = [(k, 0.1, at, b) for b, (k, at) in enumerate([("a", 10.0), ("b", 20.0), (None, 30.0)])]
    spark.createDataFrame(old, schema).write.partitionBy("bucket").parquet(f"{path}/kind=append/id=1")
    kept = [("a", 0.2, 5.0, 0), ("c", 0.2, 5.0, 1)]
    spark.createDataFrame(kept, schema).write.partitionBy("bucket").parquet(f"{path}/kind=snapshot/id=0")
    def scores(buckets, now):
        return {r.request_key: r.cached_score for r in ScoreCache(spark, path, buckets).fresh(now, 100.0).collect()}

    assert scores(3, 20.0) == {"a": 0.1, "b": 0.1, "c": 0.2, None: 0.1}
    new = spark.createDataFrame([("b", 0.3, 40.0), ("d", 0.3, 110.0)], "request_key string, score double, scored_at double")
    ScoreCache(spark, path, 3).append(new)
    want = {"a": 0.1, "b": 0.3, "c": 0.2, "d": 0.3, None: 0.1}
    assert scores(3, 50.0) == scores(4, 50.0) == want
    for buckets in (3, 4, 4):  # compacted again and again, with nothing new in between
        ScoreCache(spark, path, buckets).compact(now=105.0, ttl=100.0)
        assert scores(3, 50.0) == scores(4, 50.0) == want
        assert ScoreCache(spark, path, 3).rows().count() == 5
    ScoreCache(spark, path, 4).compact(now=130.0, ttl=100.0)
    assert scores(3, 50.0) == scores(4, 50.0) == {"b": 0.3, "d": 0.3, None: 0.1}


@pytest.mark.parametrize("limit, slice_rows", [(10**6, 10**5), (10**6, 4), (10, 4)])
def test_context_replies(spark, limit, slice_rows):
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(3) for t in range(1 + 12 * c)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(4)
    for width in (None, 1, 3, 9):
        out = prep.context_replies(df, context_turns=width, limit=limit, slice_rows=slice_rows)
        got = {(r.conv_id, r.turn): ([m.content for m in r.context], r.reply) for r in out.collect()}
        want = {(c, t): ([f"{c}-{k}" for k in range(0 if width is None else max(0, t - width), t)], x) for c, t, role, x in turns if role == "assistant"}
        assert got == want


def test_cut_texts_are_parts_of_the_text(spark):
    path = "/opt/tokenizers/word_bpe_49k.json"
    texts = ["", None, "  one  two\tthree\n four ", "word", "don't stop-believing, 日本語 größe!  ok", "a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for offsets in (prep.word_offsets, prep.tokenizer_offsets(path), lambda t: [(k, k + 1) for k in range(len(t))]):
        for limit in (0, 1, 2, 3, 50):
            cuts = [prep.cut_tokens(limit, mode, offsets)(F.col("text")).alias(mode) for mode in ("right", "left")]
            for row in df.select("text", *cuts).collect():
                if row.text is None:
                    assert row.right is None and row.left is None
                    continue
                n = len(offsets(row.text))
                assert row.text.startswith(row.right) and row.text.endswith(row.left)
                assert (row.right, row.left) == (row.text, row.text) if n <= limit else True
                assert len(offsets(row.right)) <= max(limit, 0) or n <= limit
    assert df.select(prep.cut_tokens(2)(F.col("text"))).collect()[2][0] == "  one  two"
    with pytest.raises(Exception, match="longer than 2"):
        df.select(prep.cut_tokens(2, "error")(F.col("text"))).collect()
    with pytest.raises(ValueError):
        prep.cut_tokens(2, "middle")
