"""Operators over prompt groups: ranking, preference pairs, advantages, batch metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rubrica.operators.ordering import GROUP_LIMIT, first_rows, join_left, number_rows, with_group_values

#: Responses of one group that meet the same number of others in one join key.
BLOCK_ROWS = 2_000


def rank_responses(
    df: DataFrame,
    group: str,
    index: str,
    score: str = "score",
    limit: int = GROUP_LIMIT,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Rank within the group, best first; ties keep the order of ``index``."""
    order = [F.col(score).desc(), F.col(index).asc()]
    return number_rows(df, [group], order, "rank", limit, sizes)


def best_responses(df: DataFrame, group: str, index: str, score: str = "score", n: int = 1) -> DataFrame:
    """The ``n`` best responses of every group."""
    order = [F.col(score).desc(), F.col(index).asc()]
    return first_rows(df, [group], order, n, "rank")


def best_response_advantages(
    df: DataFrame, group: str, index: str, score: str = "score", carry: Sequence[str] = ("response",)
) -> DataFrame:
    """The best response of every group with its group-relative advantage, in one aggregation.

    Each task keeps one row per group and adds up the scores, so a group of any size is safe.
    """
    r = F.nanvl(F.col(score), F.lit(None).cast("double"))
    kept = F.struct(index, *carry, score)
    found = df.groupBy(group).agg(
        F.max_by(kept, F.struct(F.col(score), -F.col(index))).alias("_best"),
        F.avg(r).alias("group_mean"),
        F.stddev_samp(r).alias("group_std"),
    )
    return _with_advantage(found.select(group, "_best.*", "group_mean", "group_std"), score)


def preference_levels(df: DataFrame, group: str, score: str = "score", margin: float = 0.1) -> DataFrame:
    """The preference relation by score level: every (chosen, rejected) level pair of a group.

    Says the same as the full list of pairs in a few rows per group, however many responses share
    a score: the rule sets know only some twenty score values. ``pairs`` counts the pairs meant.
    The margin must be positive.
    """
    if margin <= 0:
        raise ValueError("margin must be positive")
    levels = df.groupBy(group, score).agg(F.count("*").alias("n"))
    a = levels.select(group, F.col(score).alias("chosen_score"), F.col("n").alias("n_chosen"))
    b = levels.select(group, F.col(score).alias("rejected_score"), F.col("n").alias("n_rejected"))
    diff = F.col("chosen_score") - F.col("rejected_score")
    b = b.withColumnRenamed(group, "_group")
    pairs = a.join(b.hint("merge"), F.col(group).eqNullSafe(F.col("_group"))).where(diff >= margin)
    return pairs.drop("_group").withColumn("score_diff", diff).withColumn(
        "pairs", F.col("n_chosen") * F.col("n_rejected")
    )


def preference_pairs(
    df: DataFrame,
    group: str,
    index: str,
    score: str = "score",
    margin: float = 0.1,
    carry: Sequence[str] = ("response",),
    block: int = BLOCK_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(chosen, rejected, score_diff) for responses of a group whose scores differ by the margin.

    The difference is taken on raw doubles, unrounded. Both sides read one shuffle of the scored
    rows (hence the merge hint: a broadcast would score twice and grow with the data). Only pairs within the margin leave the
    join. A group of more than ``block`` responses is cut into blocks by a hash of ``index``; each
    pair of blocks is a join key of its own, so no key holds more than about ``block`` rows of either
    side and every pair is met exactly once. Block counts come from an aggregation within the plan, over
    ``sizes`` (by default ``df``), a cheaper table with the same groups. NULL is a group like any
    other. For groups too large to list use ``preference_levels``.
    """
    measured = df if sizes is None else sizes
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int").alias("_k")
    large = measured.groupBy(group).count().where(F.col("count") > block).select(group, blocks)
    rows = join_left(df.select(group, index, score, *carry), large, [group])
    rows = rows.withColumn("_k", F.coalesce("_k", F.lit(1)))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64(index), F.col("_k")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))

    def side(name: str, own: str, other: str) -> DataFrame:
        keys = [F.col(group).alias(f"_{name}_group"), F.col(own).alias(f"_{name}_i"), F.col(other).alias(f"_{name}_j")]
        return rows.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in (index, score, *carry)])

    same = (
        F.col("_chosen_group").eqNullSafe(F.col("_rejected_group"))
        & (F.col("_chosen_i") == F.col("_rejected_i"))
        & (F.col("_chosen_j") == F.col("_rejected_j"))
    )
    pairs = side("chosen", "_mine", "_other").join(side("rejected", "_other", "_mine").hint("merge"), same)
    pairs = pairs.withColumn(group, F.col("_chosen_group"))
    diff = F.col(f"chosen_{score}") - F.col(f"rejected_{score}")
    earlier = (diff > 0) | ((diff == 0) & (F.col(f"chosen_{index}") < F.col(f"rejected_{index}")))
    pairs = pairs.where(earlier & (diff >= margin)).withColumn("score_diff", diff)
    kept = [f"{side}_{c}" for side in ("chosen", "rejected") for c in (index, score, *carry)]
    return pairs.select(group, *kept, "score_diff")


def group_advantages(
    df: DataFrame,
    group: str,
    reward: str = "score",
    by_std: bool = True,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Reward relative to its group: (r - mean) / sample std, or r - mean without ``by_std``.

    0 where the std is NULL (one response) or below 1e-12 (equal rewards). ``sizes`` is a cheaper table with
    the same groups to measure.
    """
    r = F.nanvl(F.col(reward), F.lit(None).cast("double"))
    stats = {"group_mean": F.avg(r), "group_std": F.stddev_samp(r)}
    return _with_advantage(with_group_values(df, [group], stats, sizes=sizes), reward, by_std)


def _with_advantage(out: DataFrame, reward: str, by_std: bool = True) -> DataFrame:
    r = F.nanvl(F.col(reward), F.lit(None).cast("double"))
    centred = r - F.col("group_mean")
    flat = F.col("group_std").isNull() | (F.col("group_std") < 1e-12)
    scaled = F.when(flat, F.lit(0.0)).otherwise(centred / F.col("group_std"))
    return out.withColumn("advantage", scaled if by_std else centred)


def batch_metrics(df: DataFrame, by: Sequence[str], reward: str = "score") -> DataFrame:
    """Reward and length statistics per batch key; ``format_ok`` boolean if there is one."""
    n = F.length("response").cast("double")
    r = F.nanvl(F.col(reward), F.lit(None).cast("double"))
    aggs = [
        F.count("*").alias("responses"),
        F.avg(r).alias("reward_mean"),
        F.stddev_samp(r).alias("reward_std"),
        F.max(r).alias("reward_max"),
        F.min(r).alias("reward_min"),
        F.avg(n).alias("response_length_mean"),
        F.stddev_samp(n).alias("response_length_std"),
    ]
    if "format_ok" in df.columns:
        aggs.append(F.avg(F.col("format_ok").cast("int")).alias("format_accuracy"))
    return df.groupBy(*by).agg(*aggs)


def preference_accuracy(pairs: DataFrame, margin_col: str = "margin") -> DataFrame:
    """Share of pairs the policy orders as preferred (margin above 0)."""
    hit = (F.col(margin_col) > 0).cast("int")
    return pairs.agg(F.count("*").alias("pairs"), F.avg(hit).alias("preference_accuracy"))
