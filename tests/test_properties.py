"""Text functions against Python's own string methods, and invariants, on random inputs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rubrica.functions import fixed, rewards as r, text as t
from rubrica.operators import groups, scoring

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def random_texts(alphabet, n=1500, longest=12, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(n)]


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", column(F.col("x")).alias("v"))
    return [row["v"] for row in df.orderBy("i").collect()]


def python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_space_characters():
    assert sorted(fixed.SPACE_CHARS) == sorted(SPACES)


def test_strip_words_lower(spark):
    texts = random_texts([*SPACES, *"aBç你😀"])
    assert apply(spark, texts, t.strip) == [x.strip() for x in texts]
    assert apply(spark, texts, t.words) == [x.split() for x in texts]
    assert apply(spark, texts, F.length) == [len(x) for x in texts]


def test_float(spark):
    texts = random_texts([*"0123456789" * 2, *"+-._eE,", "４", "٣", "n", "inf", "nan", "d", "f"], 4000, 8)
    got = apply(spark, texts, t.to_float)
    want = [python_float(x) for x in texts]
    assert [x for x in zip(texts, got, want) if repr(x[1]) != repr(x[2])] == []


def test_regexes(spark):
    alphabet = [*"{}12.- ", "\\boxed{", "####", "答案:", "Answer:", "\n", "x", "４", "Step", "首先"]
    texts = random_texts(alphabet, 2500, 14)
    boxed = [re.findall(r"\\boxed\{([^}]+)\}", x) for x in texts]
    assert apply(spark, texts, t.boxed_answer) == [m[-1].strip() if m else None for m in boxed]
    tails = [x.split("####")[-1] if "####" in x else None for x in texts]
    assert apply(spark, texts, lambda c: t.after_marker(c, "####")) == tails
    numbers = [re.findall(r"-?\d+\.?\d*", x) if x else [] for x in tails]
    assert apply(spark, texts, lambda c: t.marked_number(c, ["####"])) == [m[0] if m else None for m in numbers]
    steps = [len(re.findall(r"Step\s*\d+", x)) for x in texts]
    assert apply(spark, texts, lambda c: F.regexp_count(c, F.lit(fixed.GSPO_STEPS[1]))) == steps


def test_is_json(spark):
    texts = random_texts([*'{}[]":, 1', '"a"', "null", '{"b":', "-", ".5", "true"], 4000, 7, 3)

    def valid(x):
        try:
            json.loads(x)
            return True
        except ValueError:
            return False

    got = apply(spark, texts, t.is_json)
    wrong = [(x, g) for x, g in zip(texts, got) if g != valid(x)]
    assert [x for x in wrong if len(set(re.findall(r'"\w"', x[0]))) == len(re.findall(r'"\w"', x[0]))] == []


def test_scores_stay_in_bounds(spark):
    alphabet = ["\\boxed{4}", "#### 4", "因为", "Step 1", "1+1=2", "def f():", "please ", "x" * 60, "First", "\n", '"""', "yes"]
    rng = random.Random(9)
    sources = [s for group in (fixed.COMMON_SOURCES, fixed.GRPO_SOURCES, fixed.GSPO_SOURCES) for n in group.values() for s in n]
    rows = [
        (i % 97, i, rng.choice([*sources, "other"]), "".join(rng.choices(alphabet, k=rng.randrange(8))), rng.choice(["4", "yes", ""]))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "group_id int, i int, data_source string, response string, ground_truth string")
    for reward, top in (("common", 1.0), ("grpo", 1.0), ("gspo", 1.5), ("length_penalty", 1.0)):
        low, high = scoring.score(df, reward).agg(F.min("score"), F.max("score")).first()
        assert 0.0 <= low and high <= top
    quality = df.select(r.reasoning_quality(F.col("response")).alias("q")).agg(F.min("q"), F.max("q")).first()
    assert 0.0 <= quality[0] and quality[1] <= 0.5
    scored = scoring.score(df, "gspo")
    sums = groups.group_advantages(scored, "group_id").groupBy("group_id").agg(F.sum("advantage").alias("s"))
    assert sums.where("abs(s) > 1e-6").count() == 0
    pairs = groups.preference_pairs(scored, "group_id", "i", carry=[])
    assert pairs.where("score_diff < 0.1 OR chosen_score <= rejected_score").count() == 0
    back = pairs.selectExpr("rejected_i AS chosen_i", "chosen_i AS rejected_i")
    assert pairs.join(back, ["chosen_i", "rejected_i"], "left_semi").count() == 0


@pytest.mark.parametrize("source, n", [("dialogue", 3), ("qa", 2)])
def test_overlap_against_sets(spark, source, n):
    vocabulary = ["alpha", "Beta", "gamma", "\u3000", " ", "  ", "\n", "delta"]
    truths, texts = random_texts(vocabulary, 800, 9, n), random_texts(vocabulary, 800, 9, n + 10)
    df = spark.createDataFrame(
        [(i, source, x, y) for i, (x, y) in enumerate(zip(texts, truths))],
        "i int, data_source string, response string, ground_truth string",
    )
    got = [row["score"] for row in scoring.score_gspo(df).orderBy("i").collect()]
    for text, truth, score in zip(texts, truths, got):
        said, want = text.lower(), truth.lower()
        if source == "dialogue":
            size = 0.3 if 50 <= len(text) <= 500 else 0.2 if 20 <= len(text) <= 1000 else 0.0
            assert score == size + (0.3 if any(w in said for w in want.split()[:5]) else 0.0)
        else:
            words = set(want.split())
            share = 1.0 if want.strip() in said.strip() else len(words & set(said.split())) / len(words)
            assert score == (1.0 if share > 0.8 else 0.5 if share > 0.5 else 0.1 if share > 0.2 else 0.0)
