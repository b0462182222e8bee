"""Order-dependent building blocks that stay exact when one group holds much of the table.

A plain window puts a whole group into one task. These helpers look at group sizes first (reading
the key columns only) and take the plain window where every group is small; a group above the
limit is cut into slices, worked on slice by slice, and stitched together with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rubrica.session import settle

#: Rows of one group that a single task may hold.
GROUP_LIMIT = 1_000_000
#: Rows per slice of a scan over a numbered group, and of a whole table numbered by one task.
SLICE_ROWS = 100_000


def group_bound(df: DataFrame, by: Sequence[str], enough: int) -> int:
    """Rows of the largest group, or the row count where that is ``enough`` or less."""
    total = df.count()
    if total <= enough or not by:
        return total
    return df.groupBy(*by).count().agg(F.max("count")).first()[0]


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    out: str = "pos",
    limit: int = GROUP_LIMIT,
    sizes: DataFrame | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Exact 1-based position of each row within its group.

    ``sizes`` is a cheaper table with the same groups to measure, by default ``df``; ``bound`` is
    the size of the largest group where the caller knows it. With a group above ``limit`` the
    table is range-partitioned on (group, order), which cuts inside a group; each range numbers
    its own rows as it is sorted and adds the rows of earlier ranges. The ranges come from a sample,
    so they are written once, with the places, before two branches read them.
    """
    by, order = list(by), list(order)
    limit = limit if by else min(limit, SLICE_ROWS)
    if bound is None:
        bound = group_bound(df if sizes is None else sizes, by, limit)
    if bound <= limit:
        window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    # a row's place within its range is its place in the sorted partition, so the rows cross one shuffle
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*by, *order)
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    summary = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*by, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if not by:  # a row per range; else a shuffle of the rows would begin before its size is known
        summary = F.broadcast(summary)
    position = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return join_left(placed, summary, [*by, "_range"]).withColumn(out, position).drop("_place", "_range", "_first", "_before")


def sliced_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    limit: int,
    slice_rows: int,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, str | None]:
    """Number the rows as ``_n`` and cut groups into slices of ``slice_rows``.

    Returns the rows and the slice column, None where every group fits into one slice.
    """
    bound = group_bound(df if sizes is None else sizes, by, min(limit, slice_rows))
    rows = number_rows(df, by, order, "_n", limit, bound=bound)
    if bound <= slice_rows:
        return rows, None
    at = F.floor((F.col("_n") - 1) / F.lit(slice_rows)).cast("bigint")
    return rows.withColumn("_slice", at), "_slice"


def slice_window(by: Sequence[str], slice_col: str | None, *order: Column) -> WindowSpec:
    """Window over a slice, or the whole group without slices. Ordered as the rows were numbered,
    it needs no further sort."""
    keys = [*by, slice_col] if slice_col else list(by)
    return Window.partitionBy(*keys).orderBy(*order)


def with_carry(
    df: DataFrame,
    by: Sequence[str],
    slice_col: str | None,
    carries: Sequence[tuple[str, Column, str, str]],
    reverse: bool = False,
) -> DataFrame:
    """Add to each row what the slices before its own add up to (after it, with ``reverse``).

    ``carries`` holds (combine, per-slice aggregate, output name, type) with combine one of sum,
    max, last. NULL in the first slice, and everywhere without slices. The rows are written once, for
    the per-slice summary and the join to it; one summary row per slice crosses the window.
    """
    by = list(by)
    if slice_col is None:
        return df.withColumns({name: F.lit(None).cast(kind) for _, _, name, kind in carries})
    df = settle(df, "slices")
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    order = F.col(slice_col).desc() if reverse else F.col(slice_col).asc()
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*by, slice_col).agg(*[agg.alias(name) for _, agg, name, _ in carries])
    summary = summary.select(
        *by,
        slice_col,
        *[fold[combine](F.col(name)).over(window).alias(name) for combine, _, name, _ in carries],
    )
    return join_left(df, summary, [*by, slice_col])


def join_left(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which NULL is a value like any other, as it is in a grouping."""
    renamed = extra.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"_key_{k}" for k in keys])


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "pos"
) -> DataFrame:
    """First ``n`` rows per group. Spark limits each task to n rows per group before the shuffle,
    so a group of any size is safe."""
    if not by:
        few = df.orderBy(*order).limit(n)
        return few.withColumn(out, F.row_number().over(Window.orderBy(*order)))
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def with_group_values(
    df: DataFrame, by: Sequence[str], values: dict[str, Column], limit: int = GROUP_LIMIT, sizes: DataFrame | None = None
) -> DataFrame:
    """Add group aggregates to every row; ``df`` is computed once.

    ``sizes`` is a cheaper table with the same groups. Where it shows that every group fits into a task, a
    window does it. Else the rows are written, the aggregates are added up before their shuffle and joined back,
    one row per group: a group of any size is split by the adaptive skew join.
    """
    by = list(by)
    if sizes is not None and group_bound(sizes, by, limit) <= limit:
        return df.withColumns({n: c.over(Window.partitionBy(*by)) for n, c in values.items()})
    df = settle(df, "rows")
    return join_left(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in values.items()]), by)
