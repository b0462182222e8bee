"""Extraction and normalisation on golden texts, including the documented oddities."""

import pytest
from pyspark.sql import functions as F

from rubrica.functions import fixed, judge, rewards as r, text as t
from rubrica.functions.display import clock, fixed_point
from rubrica.operators.judging import parse_scores


def values(spark, texts, column):
    rows = [(i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, x string").select("i", column(F.col("x")).alias("v"))
    return [row["v"] for row in df.orderBy("i").collect()]


def test_boxed(spark):
    texts = [r"\boxed{1} then \boxed{ 2 }", r"\boxed{}", "none", r"\boxed{a\boxed{b}", "\\boxed{x\ny}"]
    assert values(spark, texts, t.boxed_answer) == ["2", None, None, "a\\boxed{b", "x\ny"]


def test_marked_text(spark):
    texts = ["#### 1,234", "a ####", "a#####5", "no", "x #### 1 #### 2"]
    assert values(spark, texts, t.marked_text) == ["1234", "", "#5", None, "2"]


def test_marked_number(spark):
    texts = ["#### 1,234", "答案: none Answer: 7", "最终答案 9", "The answer is -3.50!", "#### ４２", "####"]
    assert values(spark, texts, lambda c: t.marked_number(c, fixed.GRPO_MARKERS)) == [
        "1", "7", None, "-3.50", "４２", None,
    ]
    assert values(spark, texts, lambda c: t.marked_number(c, fixed.GSPO_MARKERS))[2] == "9"


def test_normalize_number(spark):
    texts = ["1,234", " 4 2 ", "1_000", "1d", "４２", "inf", "1e3", ".5", "5.", "--1", "", "1__0", "\u30007\u3000"]
    assert values(spark, texts, t.normalize_number) == [
        1234.0, 42.0, 1000.0, None, 42.0, float("inf"), 1000.0, 0.5, 5.0, None, None, None, 7.0,
    ]


def test_words_and_strip(spark):
    assert values(spark, ["\u3000a\x1cb  c\n", ""], t.words) == [["a", "b", "c"], []]
    assert values(spark, ["\u3000 x \x1f"], t.strip) == ["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', True), ("null", True), ("1, 2", False), ("{} x", False), ("[1]]", False), ("", False),
        ('1} , "w": {"v":2', False), ("1] [2", False), ('1,"w":2', False), ("  [1, {}] ", True), ("nope", False),
    ],
)
def test_is_json(spark, text, want):
    assert values(spark, [text], t.is_json) == [want]


def test_format_reward(spark):
    texts = ['{"a": 1}', 'x {"a": 2} y', "x {} y", "none", "[1, 2"]
    assert values(spark, texts, r.format_reward) == [1.0, 0.5, 0.0, 0.0, 0.0]
    assert values(spark, ["# T", "a **b** c", "```", "x", "a\n## b"], lambda c: r.format_reward(c, "markdown")) == [
        1.0, 1.0, 1.0, 0.0, 1.0,
    ]


def test_length_rewards(spark):
    got = values(spark, ["x" * 25, "x" * 50, "😀" * 50, "x" * 4000, ""], r.length_penalty_reward)
    assert got == pytest.approx([0.95, 1.0, 1.0, 0.9, 0.9])


def test_syntax_check_runs_nothing(spark, tmp_path):
    target = tmp_path / "ran"
    texts = [f"open({str(target)!r}, 'w')", "def f(:", "return 1", None, "x = 1\0"]
    assert values(spark, texts, r.parses_as_python) == [True, False, False, None, False]
    assert not target.exists()


def test_judge_scores(spark):
    texts = [
        '{"score": 11}', '{"score": "8"}', '{"score": "8/10"}', "得分8分", "15", "", '{"reason": "x"}',
        '{"score": null} 9', "I give 7.5 of 10", '{"score": [1]}', '{"score": -3}', "{bad} 4", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    assert [row["score"] for row in parse_scores(df).orderBy("i").collect()] == [
        1.0, 0.8, 0.8, 0.5, 0.5, 0.5, 0.5, 0.5, 0.75, 0.5, 0.1, 0.4, 0.5,
    ]


def test_judge_prompt_fills_literally(spark):
    row = spark.range(1).select(
        judge.user_prompt(F.lit("math_plain"), F.lit("{response}"), F.lit("R"), F.lit(None).cast("string")).alias("p")
    ).first()
    assert "{response}" in row["p"] and "\nR\n" in row["p"] and "\n无\n" in row["p"] and '{"score": <' in row["p"]


def test_fixed_point_rounds_like_printf(spark):
    numbers = [0.15, 0.25, 0.35, 2.5, 128.85, 1e15 + 0.5, -0.15, 0.0, 1 / 3, 12345.65]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [row["v"] for row in df.select("i", fixed_point(F.col("x"), 1).alias("v")).orderBy("i").collect()]
    assert got == [f"{x:.1f}" for x in numbers]


def test_clock(spark):
    df = spark.createDataFrame([(0.0,), (3661.9,), (90000.0,)], "s double").select(clock(F.col("s")).alias("v"))
    assert sorted(row["v"] for row in df.collect()) == ["00:00:00", "01:01:01", "25:00:00"]
