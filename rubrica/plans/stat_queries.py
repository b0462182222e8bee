"""Rollout statistics over log-probabilities derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.operators import groups, rollout_stats as stats
from rubrica.plans.inputs import cte, table

_TOKENS = cte("tokens")


def gae(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "tokens").select("seq_id", "token_id", "reward", "value")
    out = stats.gae(tokens, "seq_id", "token_id", gamma=0.99, lam=0.95)
    names = ["delta", "advantage", "return"]
    return out.select("seq_id", "token_id", *[(F.round(c, 10) + 0.0).alias(c) for c in names])


_GAE = f"""{_TOKENS}, n AS (SELECT *, row_number() OVER w AS pos,
 reward + 99e-2 * coalesce(lead(value) OVER w, 0e0) - value AS delta FROM tokens
 WINDOW w AS (PARTITION BY seq_id ORDER BY token_id)),
 a AS (SELECT x.seq_id, x.token_id, any_value(x.delta) AS delta, any_value(x.value) AS value,
 sum(pow(99e-2 * 95e-2, y.pos - x.pos) * y.delta) AS advantage
 FROM n x JOIN n y ON x.seq_id = y.seq_id AND y.pos >= x.pos GROUP BY x.seq_id, x.token_id, x.pos)
SELECT seq_id, token_id, round(delta, 10) + 0e0 AS delta, round(advantage, 10) + 0e0 AS advantage,
 round(advantage + value, 10) + 0e0 AS "return" FROM a"""


def surrogate(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.surrogate_stats(table(spark, sf, "tokens").withColumn("b", F.expr("seq_id % 50")), ["b"], 0.05)
    return out.select("b", F.round("policy_loss", 6).alias("policy_loss"), F.round("clip_fraction", 6).alias("clip_fraction"))


_SURROGATE = f"""{_TOKENS}, r AS (SELECT seq_id % 50 AS b, exp(logp - old_logp) AS ratio, advantage AS a FROM tokens)
SELECT b, round(-avg(least(ratio * a, least(greatest(ratio, 1e0 - 5e-2), 1e0 + 5e-2) * a)), 6) AS policy_loss,
 round(avg(CASE WHEN ratio < 1e0 - 5e-2 OR ratio > 1e0 + 5e-2 THEN 1e0 ELSE 0e0 END), 6) AS clip_fraction
FROM r GROUP BY b"""


def kl(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.kl_stats(table(spark, sf, "tokens").withColumn("b", F.expr("seq_id % 50")), ["b"])
    return out.select("b", *[F.round(c, 6).alias(c) for c in ("kl", "abs", "mse", "low_var_kl")])


_KL = f"""{_TOKENS}, d AS (SELECT seq_id % 50 AS b, logp - ref_logp AS d FROM tokens)
SELECT b, round(avg(d), 6) AS kl, round(avg(abs(d)), 6) AS abs, round(avg(d * d / 2), 6) AS mse,
 round(avg(exp(-d) + d - 1), 6) AS low_var_kl FROM d GROUP BY b"""


def preference(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of a pair of responses per prompt, and the share ordered as preferred.

    The odd tokens of a prompt are its chosen response, the even ones the rejected; a response's
    log-probability sums all its tokens'.
    """
    tokens = table(spark, sf, "tokens").withColumn("odd", F.expr("token_id % 2 = 1"))
    sums = [
        F.coalesce(F.sum(F.when(F.col("odd") == odd, F.col(c))), F.lit(0.0)).alias(f"{side}_{c}")
        for side, odd in (("chosen", True), ("rejected", False))
        for c in ("logp", "ref_logp")
    ]
    pairs = tokens.groupBy("seq_id").agg(*sums)
    out = stats.preference_loss(pairs, 0.1, "sigmoid", 0.1)
    for loss in ("hinge", "ipo"):
        out = stats.preference_loss(out.withColumnRenamed("loss", f"_{loss}"), 0.1, loss)
        out = out.withColumnsRenamed({"loss": loss, f"_{loss}": "loss"})
    return out.select("seq_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("margin", "loss", "hinge", "ipo")])


_PAIRS = f"""{_TOKENS}, p AS (SELECT seq_id,
 coalesce(sum(logp) FILTER (token_id % 2 = 1), 0e0) - coalesce(sum(ref_logp) FILTER (token_id % 2 = 1), 0e0)
 - (coalesce(sum(logp) FILTER (token_id % 2 <> 1), 0e0) - coalesce(sum(ref_logp) FILTER (token_id % 2 <> 1), 0e0)) AS x
 FROM tokens GROUP BY seq_id),
 m AS (SELECT seq_id, x, 1e-1 * x AS m FROM p)"""
_PREFERENCE = f"""{_PAIRS} SELECT seq_id, round(m, 6) + 0e0 AS margin,
 round(ln(1 + exp(-m)) * 9e-1 + ln(1 + exp(m)) * 1e-1, 6) + 0e0 AS loss, round(greatest(1 - m, 0), 6) + 0e0 AS hinge,
 round(pow(x - 5e0, 2), 6) + 0e0 AS ipo FROM m"""


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return groups.preference_accuracy(preference(spark, sf)).withColumn(
        "preference_accuracy", F.round("preference_accuracy", 6)
    )


_ACCURACY = f"""{_PAIRS} SELECT count(*) AS pairs,
 round(avg(CASE WHEN round(m, 6) > 0 THEN 1e0 ELSE 0e0 END), 6) AS preference_accuracy FROM m"""


def losses(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "tokens").select("seq_id", (-F.col("logp")).alias("loss"))
    modes = [("token-mean", None), ("seq-mean-token-sum-norm", None), ("seq-mean-token-sum-norm", 16)]
    parts = [
        stats.aggregate_loss(tokens, "seq_id", mode=mode, horizon=horizon).select(
            F.lit(f"{mode}/{horizon or 'longest'}").alias("mode"), F.round("loss", 6).alias("loss")
        )
        for mode, horizon in modes
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LOSSES = f"""{_TOKENS}, s AS (SELECT seq_id, sum(-logp) AS total, count(*) AS n FROM tokens GROUP BY seq_id)
SELECT 'token-mean/longest' AS mode, round(avg(-logp), 6) AS loss FROM tokens
UNION ALL SELECT 'seq-mean-token-sum-norm/longest', round(avg(total) / max(n), 6) FROM s
UNION ALL SELECT 'seq-mean-token-sum-norm/16', round(avg(total) / 16, 6) FROM s"""

QUERIES = {
    "gae": gae,
    "clipped_surrogate": surrogate,
    "kl_estimates": kl,
    "preference_loss": preference,
    "preference_accuracy": accuracy,
    "loss_aggregation": losses,
}

SQL = {
    "gae": _GAE,
    "clipped_surrogate": _SURROGATE,
    "kl_estimates": _KL,
    "preference_loss": _PREFERENCE,
    "preference_accuracy": _ACCURACY,
    "loss_aggregation": _LOSSES,
}
