"""Prompt-group queries: ranking, preference pairs, advantages, batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.operators import groups, scoring
from rubrica.plans import sqltext as q
from rubrica.plans.inputs import cte, read, table

#: Rollouts with the score of one rule set, shared by the SQL below.
_GRPO = f"{cte('rollouts')}, scored AS (SELECT *, {q.grpo()} AS score FROM rollouts)"
_GSPO = f"{cte('rollouts')}, scored AS (SELECT *, {q.gspo()} AS score FROM rollouts)"


def _scored(spark: SparkSession, sf: str, reward: str) -> DataFrame:
    return scoring.score(table(spark, sf, "rollouts"), reward)


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt groups without their scores, to measure group sizes on."""
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"))


def best_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: score, compare within the prompt group, keep the best response of each prompt.

    One aggregation: no sort, and one row per prompt and task in the shuffle.
    """
    best = groups.best_response_advantages(_scored(spark, sf, "grpo"), "group_id", "response_id")
    return best.select(
        "group_id", "response_id", "response", "score", (F.round("advantage", 6) + 0.0).alias("advantage")
    )


_ADVANTAGE = """CASE WHEN std IS NULL OR std < 1e-12 THEN 0e0 ELSE (score - mean) / std END"""

_BEST = f"""{_GRPO}, w AS (SELECT *, avg(score) OVER (PARTITION BY group_id) AS mean,
  stddev_samp(score) OVER (PARTITION BY group_id) AS std,
  row_number() OVER (PARTITION BY group_id ORDER BY score DESC, response_id) AS rk FROM scored)
SELECT group_id, response_id, response, score, round({_ADVANTAGE}, 6) + 0e0 AS advantage FROM w WHERE rk = 1"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "gspo").select("group_id", "response_id", "score")
    out = groups.rank_responses(scored, "group_id", "response_id", sizes=_sizes(spark, sf))
    return out.select("group_id", "response_id", "score", "rank")


_RANKED = f"""{_GSPO} SELECT group_id, response_id, score,
 row_number() OVER (PARTITION BY group_id ORDER BY score DESC, response_id) AS rank FROM scored"""


def top_responses(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "grpo").select("group_id", "response_id", "score")
    best = groups.best_responses(scored, "group_id", "response_id", n=3)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def advantages(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "grpo").select("group_id", "response_id", "score")
    out = groups.group_advantages(scored, "group_id", sizes=_sizes(spark, sf))
    return out.select(
        "group_id",
        "response_id",
        F.round("group_mean", 6).alias("group_mean"),
        F.round("group_std", 6).alias("group_std"),
        (F.round("advantage", 6) + 0.0).alias("advantage"),
        (F.round(F.col("score") - F.col("group_mean"), 6) + 0.0).alias("centred"),
    )


_TOP = f"""{_GRPO}, w AS (SELECT group_id, response_id, score,
  row_number() OVER (PARTITION BY group_id ORDER BY score DESC, response_id) AS rank FROM scored)
SELECT * FROM w WHERE rank <= 3"""

_ADVANTAGES = f"""{_GRPO}, w AS (SELECT *, avg(score) OVER (PARTITION BY group_id) AS mean,
  stddev_samp(score) OVER (PARTITION BY group_id) AS std FROM scored)
SELECT group_id, response_id, round(mean, 6) AS group_mean, round(std, 6) AS group_std,
 round({_ADVANTAGE}, 6) + 0e0 AS advantage, round(score - mean, 6) + 0e0 AS centred FROM w"""


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return groups.preference_levels(_scored(spark, sf, "gspo"), "group_id")


_PAIRS = f"""{_GSPO}, pairs AS (
 SELECT a.group_id, a.response_id AS chosen_response_id, b.response_id AS rejected_response_id,
  a.score AS chosen_score, b.score AS rejected_score, a.score - b.score AS score_diff,
  a.response AS chosen_response, b.response AS rejected_response
 FROM scored a JOIN scored b ON a.group_id = b.group_id AND a.score > b.score
 WHERE a.score - b.score >= 1e-1)"""

_LEVELS = f"""{_PAIRS}, n AS (SELECT group_id, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT p.group_id, chosen_score, rejected_score, score_diff, count(*) AS pairs,
 any_value(a.n) AS n_chosen, any_value(b.n) AS n_rejected
FROM pairs p JOIN n a ON a.group_id = p.group_id AND a.score = chosen_score
JOIN n b ON b.group_id = p.group_id AND b.score = rejected_score
GROUP BY p.group_id, chosen_score, rejected_score, score_diff"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "gspo")
    return groups.preference_pairs(scored, "group_id", "response_id", sizes=_sizes(spark, sf))


def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf, "grpo").withColumn("format_ok", F.col("score") > 0)
    out = groups.batch_metrics(scored, ["data_source", "step"])
    rounded = ["reward_mean", "reward_std", "response_length_mean", "response_length_std", "format_accuracy"]
    return out.withColumns({c: F.round(c, 9) for c in rounded})


_BATCH = f"""{_GRPO} SELECT data_source, step, count(*) AS responses, round(avg(score), 9) AS reward_mean,
 round(stddev_samp(score), 9) AS reward_std, max(score) AS reward_max, min(score) AS reward_min,
 round(avg(length(response)), 9) AS response_length_mean,
 round(stddev_samp(length(response)), 9) AS response_length_std,
 round(avg(CASE WHEN score > 0 THEN 1e0 ELSE 0e0 END), 9) AS format_accuracy
FROM scored GROUP BY data_source, step"""

#: Rollouts of which one prompt holds a third.
_HOT = "CASE WHEN response_id % 3 = 0 THEN 0 ELSE group_id END"


def hot_group(spark: SparkSession, sf: str) -> DataFrame:
    """Advantages and best response where one prompt holds a third of all responses."""
    rows = table(spark, sf, "rollouts").withColumn("group_id", F.expr(_HOT))
    scored = scoring.score(rows, "grpo").select("group_id", "response_id", "score")
    compared = groups.group_advantages(scored, "group_id")
    best = groups.best_response_advantages(scored, "group_id", "response_id", carry=[])
    best = best.select(F.col("group_id").alias("_g"), F.col("response_id").alias("best_id"))
    out = compared.join(best, F.col("group_id") == F.col("_g"))
    return out.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.max("best_id").alias("best_id"),
        (F.round(F.max("advantage"), 6) + 0.0).alias("highest"),
        (F.round(F.min("advantage"), 6) + 0.0).alias("lowest"),
    )


_HOT_SQL = f"""{cte('rollouts')}, hot AS (SELECT * REPLACE ({_HOT} AS group_id) FROM rollouts),
 scored AS (SELECT group_id, response_id, {q.grpo()} AS score FROM hot),
 g AS (SELECT group_id, avg(score) AS mean, stddev_samp(score) AS std, max(score) AS high, min(score) AS low,
  count(*) AS n FROM scored GROUP BY group_id)
SELECT g.group_id, n, (SELECT min(response_id) FROM scored s WHERE s.group_id = g.group_id AND s.score = g.high) AS best_id,
 round({_ADVANTAGE.replace('score', 'high')}, 6) + 0e0 AS highest,
 round({_ADVANTAGE.replace('score', 'low')}, 6) + 0e0 AS lowest FROM g"""

QUERIES = {
    "hot_group": hot_group,
    "best_responses": best_responses,
    "top_responses": top_responses,
    "ranked_responses": ranked,
    "group_advantages": advantages,
    "preference_levels": levels,
    "preference_pairs": pairs,
    "batch_metrics": batch_metrics,
}

SQL = {
    "hot_group": _HOT_SQL,
    "best_responses": _BEST,
    "top_responses": _TOP,
    "ranked_responses": _RANKED,
    "group_advantages": _ADVANTAGES,
    "preference_levels": _LEVELS,
    "preference_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "batch_metrics": _BATCH,
}
