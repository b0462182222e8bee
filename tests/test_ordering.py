"""Numbering across ranges: the same rows as one window, and one shuffle of them."""

import random

import pytest
from pyspark.sql import functions as F

from rubrica.operators import evaluation
from rubrica.operators.ordering import number_rows


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("down", [False, True])
def test_ranges_number_like_a_window_in_one_shuffle(spark, by, down):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), None if k == 5 else k, "wide text") for k in range(2000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, k int, text string").repartition(5)
    order = [F.col("k").desc() if down else F.col("k")]
    ranged = number_rows(df, by, order, limit=100)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(ranged.collect()) == key(number_rows(df, by, order, limit=10**6, bound=1).collect())
    plan = ranged._jdf.queryExecution().sparkPlan().toString()
    assert by or ("Window" in plan and "BroadcastHashJoin" in plan and "row_number" not in plan)


def test_only_pairs_cross_the_join(spark):
    items = spark.createDataFrame([(k, f"p{k}") for k in range(900)], "k int, prompt string").repartition(3)
    turns = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "k int, text string")
    for limit in (10, 10**6):
        out = evaluation.assemble(items, turns, [F.col("k")], [F.col("k")], response="text", hidden=["k"], limit=limit)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("<= 40") >= 2
        got = sorted((r["id"], r["prompt"], r["response"]) for r in out.collect())
        assert got == [(k + 1, f"p{k}", f"r{k}") for k in range(40)]
