"""Scores of golden responses in the three rule sets, group ranking and pairs."""

import pytest
from pyspark.sql import functions as F

from rubrica.operators import groups, scoring

SCHEMA = "group_id int, i int, data_source string, response string, ground_truth string"


def score(spark, reward, rows, **columns):
    df = spark.createDataFrame([(0, i, *row) for i, row in enumerate(rows)], SCHEMA)
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return [r["score"] for r in scoring.score(df, reward).orderBy("i").collect()]


def test_common(spark):
    rows = [
        ("math", "首先计算2+3=5，然后乘以4得到20。\\boxed{20}", "20"),
        ("qa", "中国的首都是北京市，位于华北地区。", "北京"),
        ("math", "答案: 42", "42"),
        ("math", "#### 1,234", "1234"),
        ("math", "text ####", "1"),
        ("math", "\\boxed{Yes }", "yes"),
        ("math", "\\boxed{inf}", "inf"),
        ("code", "class A: pass", ""),
        ("unknown", "#### 5", "5.0000001"),
        ("qa", "x", ""),
        ("math", None, "1"),
        ("qa", "alpha gamma", "alpha beta"),
    ]
    assert score(spark, "common", rows) == [1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.5, 1.0, 1.0, 0.0, 0.5]


def test_grpo(spark):
    rows = [
        ("math", "第一步: 15 + 27 = 42\n#### 42", "42"),
        ("math", "答案是 \\boxed{42}", "42"),
        ("math", "我觉得答案是43", "42"),
        ("math", "不知道", "42"),
        ("qa", "北京是中国的首都城市。", "北京"),
        ("qa", "中国的首都在华北地区。", "北京"),
        ("math", "#### 43", "42"),
        ("other", "#### 43", "42"),
        ("math", "#### 1,234", "1234"),
        ("sentiment", "It is POSITIVE", "Positive"),
        ("sentiment", "It is fine", "fine"),
        ("code", "x = 1", ""),
        ("code", "x = = 1", ""),
        ("math", "\\boxed{1e400}", "1e400"),
        ("math", "\\boxed{042.0}", "42"),
        ("math", "\\boxed{ }", None),
    ]
    assert score(spark, "grpo", rows) == [
        1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.1, 0.0, 0.1, 1.0, 0.0, 0.1, 0.0, 1.0, 1.0, 1.0,
    ]


def test_pass_rate(spark):
    rows = [("code", "x = 1", ""), ("code", "x = = 1", "")]
    assert score(spark, "grpo", rows, pass_rate=F.lit(0.75)) == [0.75, 0.0]
    assert score(spark, "gspo", rows, pass_rate=F.lit(1.0)) == [0.6, 0.0]
    assert score(spark, "grpo", rows, pass_rate=F.lit(None).cast("double")) == [0.1, 0.0]


def test_gspo_ranking_and_pairs(spark):
    texts = ["首先，我们计算15+27=42。\n#### 42", "答案是42", "我觉得是43吧", "不知道怎么算"]
    df = spark.createDataFrame([(0, i, "math_reasoning", x, "42") for i, x in enumerate(texts)], SCHEMA)
    scored = scoring.score(df, "gspo")
    ranked = groups.rank_responses(scored, "group_id", "i").orderBy("rank").collect()
    assert [(r["i"], r["score"]) for r in ranked] == [(0, 1.2), (1, 0.0), (2, 0.0), (3, 0.0)]
    pairs = groups.preference_pairs(scored, "group_id", "i").collect()
    assert sorted((p["chosen_i"], p["rejected_i"], p["score_diff"]) for p in pairs) == [
        (0, 1, 1.2), (0, 2, 1.2), (0, 3, 1.2),
    ]


def test_gspo_dialogue_and_code(spark):
    rows = [
        ("chat", "please " + "x" * 50, "hello xx"),
        ("chat", "x" * 20, "a b c d e xxxx"),
        ("code", 'def f(x) -> int:\n    """d"""\n    return 1', ""),
    ]
    assert score(spark, "gspo", rows) == pytest.approx([0.7, 0.2, 0.5])  # "-> int" hides the function


def _numbered(spark, scores):
    rows = [(g, i, float(s), f"r{g}-{i}") for g, group in scores.items() for i, s in enumerate(group)]
    return spark.createDataFrame(rows, "group_id int, i int, score double, response string")


def brute_pairs(scores, margin):
    out = []
    for g, group in scores.items():
        ranked = sorted(range(len(group)), key=lambda i: (-group[i], i))
        for x in range(len(ranked)):
            for y in range(x + 1, len(ranked)):
                a, b = ranked[x], ranked[y]
                if group[a] - group[b] >= margin:
                    out.append((g, a, b, group[a] - group[b]))
    return sorted(out)


@pytest.mark.parametrize("margin", [0.1, 0.5, 0.0])
def test_pairs_in_blocks(spark, margin):
    """A group above the block size is met block by block, with the very same pairs."""
    import random

    rng = random.Random(7)
    scores = {0: [rng.choice([0.0, 0.1, 0.2, 1.1, 1.2]) for _ in range(60)], 1: [1.2, 1.1], 2: [0.0]}
    pairs = groups.preference_pairs(_numbered(spark, scores), "group_id", "i", margin=margin, block=7)
    got = sorted((p["group_id"], p["chosen_i"], p["rejected_i"], p["score_diff"]) for p in pairs.collect())
    assert got == brute_pairs(scores, margin)
    if margin > 0:
        levels = groups.preference_levels(_numbered(spark, scores), "group_id", margin=margin)
        assert levels.agg(F.sum("pairs")).first()[0] == len(got)


def test_margin_on_raw_doubles(spark):
    pairs = groups.preference_pairs(_numbered(spark, {0: [1.2, 1.1], 1: [0.2, 0.1]}), "group_id", "i")
    assert [p["group_id"] for p in pairs.collect()] == [1]


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_null_group_is_a_group(spark, limit):
    rows = [(None, i, float(i)) for i in range(4)] + [(1, 9, 1.0)]
    df = spark.createDataFrame(rows, "group_id int, i int, score double")
    out = groups.group_advantages(df, "group_id", by_std=False).collect()
    assert sorted(r["advantage"] for r in out) == [-1.5, -0.5, 0.0, 0.5, 1.5]
    ranked = groups.rank_responses(df, "group_id", "i", limit=limit).collect()
    assert sorted((r["rank"] for r in ranked if r["group_id"] is None)) == [1, 2, 3, 4]
    pairs = groups.preference_pairs(df, "group_id", "i", carry=[], block=limit).collect()
    assert sorted((p["chosen_i"], p["rejected_i"]) for p in pairs) == [(a, b) for a in range(4) for b in range(a)]
    assert groups.preference_levels(df, "group_id").agg(F.sum("pairs")).first()[0] == 6


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_rank_and_advantages_with_a_large_group(spark, limit):
    import statistics

    scores = {0: [(i * 7) % 5 / 10 for i in range(50)], 1: [0.5], 2: [0.3, 0.3], 3: [1.0, 0.0]}
    df = _numbered(spark, scores)
    ranked = groups.rank_responses(df, "group_id", "i", limit=limit).collect()
    for g, group in scores.items():
        order = [r["i"] for r in sorted((r for r in ranked if r["group_id"] == g), key=lambda r: r["rank"])]
        assert order == sorted(range(len(group)), key=lambda i: (-group[i], i))
        assert sorted(r["rank"] for r in ranked if r["group_id"] == g) == list(range(1, len(group) + 1))
    out = groups.group_advantages(df, "group_id").collect()
    best = {r["group_id"]: r for r in groups.best_response_advantages(df, "group_id", "i").collect()}
    assert all(best[r["group_id"]]["i"] == r["i"] for r in ranked if r["rank"] == 1)
    for g, group in scores.items():
        mean = statistics.mean(group)
        std = statistics.stdev(group) if len(group) > 1 else 0.0
        for row in (r for r in out if r["group_id"] == g):
            want = 0.0 if std < 1e-12 else (row["score"] - mean) / std
            assert row["advantage"] == pytest.approx(want)


def test_python_reward(spark):
    def compute_score(data_source, solution_str, ground_truth, extra_info=None):
        return {"score": len(solution_str), "other": 1}

    rule = scoring.python_reward(compute_score)
    df = spark.createDataFrame([(0, 0, "x", "abc", "")], SCHEMA)
    assert rule(df).first()["score"] == 3.0
    with pytest.raises(KeyError):
        scoring.score(df, "nothing")


def test_reward_arguments(spark):
    df = spark.createDataFrame([(0, 0, "gsm8k", "#### 42", "42")], SCHEMA)
    assert scoring.score(df, "grpo", correct=2.0).first()["score"] == 2.0
    assert scoring.score(df, "process", correct=2.0).first()["score"] >= 2.0
    assert 0 <= scoring.score(df, "composite", weights={"math": 1.0, "format": 1.0}).first()["score"] <= 1


def test_only_code_rows_reach_python(spark):
    df = spark.createDataFrame([(0, 0, "code", "x = 1", ""), (0, 1, "math", "#### 1", "1")], SCHEMA)
    plan = scoring.score(df, "grpo")._jdf.queryExecution().optimizedPlan().toString()
    python = plan[plan.index("ArrowEvalPython") :]
    assert "Filter" in python and plan.count("ArrowEvalPython") == 1
