"""Statistics over logged rewards and log-probabilities, as table operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.operators.ordering import (
    GROUP_LIMIT,
    join_left,
    slice_window,
    sliced_rows,
    with_carry,
)
from rubrica.session import settle


def _slice_rows(decay: float, most: int = 4096) -> int:
    """Longest slice over which powers of ``decay`` stay far from underflow."""
    if decay >= 1.0:
        return most
    return max(1, min(most, int(math.log(1e-200) / math.log(decay))))


def gae(
    tokens: DataFrame,
    seq: str,
    order: str,
    reward: str = "reward",
    value: str = "value",
    gamma: float = 1.0,
    lam: float = 0.95,
    limit: int = GROUP_LIMIT,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ``delta``, ``advantage`` (generalised advantage estimate) and ``return``.

    delta = r + gamma * next value - value, with 0 after the last token; the advantage is delta
    plus gamma * lam times the next advantage. A sequence is worked on in slices: each adds up its
    own part as a running sum of discounted deltas; what follows a slice enters as the advantage
    at the start of the next one, decayed.
    """
    decay = gamma * lam
    n = slice_rows or (_slice_rows(decay) if decay > 0 else 4096)
    rows, cut = sliced_rows(tokens, [seq], [F.col(order)], limit, n)
    rows = rows.withColumn("_i", (F.col("_n") - 1) % n)
    first_value = F.min_by(F.col(value), F.col("_n")).cast("double")
    rows = with_carry(rows, [seq], cut, [("last", first_value, "_after", "double")], reverse=True)
    back = slice_window([seq], cut, F.col(order).desc())
    following = F.coalesce(F.lag(value).over(back), F.col("_after"), F.lit(0.0))
    rows = rows.withColumn("delta", F.col(reward) + F.lit(gamma) * following - F.col(value))
    own = F.col("delta")
    if decay > 0:
        weight = F.pow(F.lit(decay), F.col("_i"))
        upto = back.rowsBetween(Window.unboundedPreceding, 0)
        own = F.sum(F.col("delta") * weight).over(upto) / weight
    rows = rows.withColumn("advantage", own)
    if cut and decay > 0:
        rows = settle(rows, "slices")
        later = rows.where("_i = 0 AND _slice > 0").select(seq, "_slice", "advantage")
        later = _chain(later, seq, decay**n).withColumn("_slice", F.col("_slice") - 1)
        rows = join_left(rows, later, [seq, "_slice"])
        rest = F.coalesce("_next", F.lit(0.0)) * F.pow(F.lit(decay), F.lit(n) - F.col("_i"))
        rows = rows.withColumn("advantage", F.col("advantage") + rest)
    rows = rows.withColumn("return", F.col("advantage") + F.col(value))
    return rows.drop("_n", "_slice", "_i", "_after", "_next")


def _chain(starts: DataFrame, seq: str, step: float) -> DataFrame:
    """Advantage at the start of every slice but the first: its own plus ``step`` times the next slice's.

    Each slice is the map x -> own + step * x. In every round a slice takes over the map of as many
    slices again as it has; after log2 of their number all are composed. One row per slice crosses the
    window, and rounds end early where the power of ``step`` has vanished.
    """
    most = starts.agg(F.max("_slice")).first()[0] or 0
    window = Window.partitionBy(seq).orderBy("_slice")
    rows, reach, power = starts.withColumnRenamed("advantage", "_next"), 1, step
    while reach < most and power:
        rows = rows.withColumn("_next", F.col("_next") + F.lit(power) * F.coalesce(F.lead("_next", reach).over(window), F.lit(0.0)))
        reach, power = 2 * reach, power * power
    return rows


def clipped_surrogate(
    df: DataFrame,
    logp: str = "logp",
    old_logp: str = "old_logp",
    advantage: str = "advantage",
    clip: float = 0.2,
) -> DataFrame:
    """Add ``ratio``, ``objective`` = min(ratio * A, clipped ratio * A), and ``clipped``."""
    df = df.withColumn("ratio", F.exp(F.col(logp) - F.col(old_logp)))
    low, high = F.lit(1.0 - clip), F.lit(1.0 + clip)
    held = F.least(F.greatest(F.col("ratio"), low), high)
    a = F.col(advantage)
    df = df.withColumn("objective", F.least(F.col("ratio") * a, held * a))
    return df.withColumn("clipped", (F.col("ratio") < low) | (F.col("ratio") > high))


def surrogate_stats(df: DataFrame, by: list[str], clip: float = 0.2) -> DataFrame:
    """Mean policy loss and share of clipped tokens."""
    return clipped_surrogate(df, clip=clip).groupBy(*by).agg(
        (-F.avg("objective")).alias("policy_loss"),
        F.avg(F.col("clipped").cast("int")).alias("clip_fraction"),
    )


def kl_estimate(logp: Column, ref_logp: Column, kind: str = "low_var_kl") -> Column:
    """Per-token KL estimate: kl, abs, mse, low_var_kl."""
    diff = logp - ref_logp
    estimates = {
        "kl": diff,
        "abs": F.abs(diff),
        "mse": F.lit(0.5) * diff * diff,
        "low_var_kl": F.exp(-diff) + diff - F.lit(1.0),
    }
    if kind not in estimates:
        raise ValueError(f"unknown KL estimate {kind!r}")
    return estimates[kind]


def kl_stats(df: DataFrame, by: list[str], logp: str = "logp", ref_logp: str = "ref_logp") -> DataFrame:
    kinds = ("kl", "abs", "mse", "low_var_kl")
    means = [F.avg(kl_estimate(F.col(logp), F.col(ref_logp), kind)).alias(kind) for kind in kinds]
    return df.groupBy(*by).agg(*means)


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(
    df: DataFrame,
    beta: float = 0.1,
    loss: str = "sigmoid",
    label_smoothing: float = 0.0,
    reference_free: bool = False,
) -> DataFrame:
    """Add ``margin`` and ``loss`` to pairs with chosen/rejected log-probabilities.

    Reads chosen_logp, rejected_logp, chosen_ref_logp, rejected_ref_logp. Losses: sigmoid,
    hinge, ipo.
    """
    chosen, rejected = F.col("chosen_logp"), F.col("rejected_logp")
    logit = chosen - rejected
    if not reference_free:
        logit = (chosen - F.col("chosen_ref_logp")) - (rejected - F.col("rejected_ref_logp"))
    margin = F.lit(beta) * logit
    losses = {
        "sigmoid": _softplus(-margin) * F.lit(1.0 - label_smoothing)
        + _softplus(margin) * F.lit(label_smoothing),
        "hinge": F.greatest(F.lit(1.0) - margin, F.lit(0.0)),
        "ipo": F.pow(logit - F.lit(1.0 / (2.0 * beta)), F.lit(2.0)),
    }
    if loss not in losses:
        raise ValueError(f"unknown loss {loss!r}")
    return df.withColumn("margin", margin).withColumn("loss", losses[loss])


def aggregate_loss(
    tokens: DataFrame, seq: str, loss: str = "loss", mode: str = "token-mean", horizon: int | None = None
) -> DataFrame:
    """One row: the loss over all tokens.

    ``token-mean`` is the mean over tokens. ``seq-mean-token-sum-norm`` is the mean over
    sequences of the token sum divided by ``horizon``, by default the longest sequence.
    """
    if mode == "token-mean":
        return tokens.agg(F.avg(loss).alias("loss"))
    if mode != "seq-mean-token-sum-norm":
        raise ValueError(f"unknown mode {mode!r}")
    sums = tokens.groupBy(seq).agg(F.sum(loss).alias("_sum"), F.count("*").alias("_n"))
    norm = F.lit(float(horizon)) if horizon else F.max("_n").cast("double")
    return sums.agg((F.avg("_sum") / norm).alias("loss"))
