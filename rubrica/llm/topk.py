"""The best rows of each key, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts a key's rows are ranked in before the best of all parts are ranked together.
PARTS = 32


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: str, k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, numbered from 1 in the column ``rank``.

    Rows of one key are first ranked in parts chosen by the hash of ``salt``, so that however many
    tasks contribute, a task ranks a part, and in the end ``PARTS * k`` rows.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    few = df.withColumn("_part", part).withColumn(rank, first).where(F.col(rank) <= k).drop("_part", rank)
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
