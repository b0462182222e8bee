"""Records out of console logs.

Every line may hold values for some keys; values gather, later ones replacing earlier ones, until a
step and at least one other key are held. Then a record is complete and gathering starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.functions import fixed, text as t
from rubrica.operators.ordering import (
    GROUP_LIMIT,
    SLICE_ROWS,
    slice_window,
    sliced_rows,
    with_carry,
)
from rubrica.session import once


def line_values(line: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """First match of each pattern in a line, NULL without one."""
    return {key: F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for key, p in patterns.items()}


def parse_console(
    lines: DataFrame,
    file: str = "file",
    order: str = "pos",
    value: str = "value",
    patterns: dict[str, str] | None = None,
    limit: int = GROUP_LIMIT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(file, record, one double per pattern, raw) in the order of completion.

    ``raw`` maps a key to its text where that is no number. ``patterns`` must include ``step``.

    A line matters only by whether it has a step (s), another key (o) or both (b). With the
    lines that have any, a record completes at every b, and at a letter that differs from the one
    before if that one was kept; kept and completing letters take turns in a stretch of
    alternating letters. So it is the parity within the stretch that decides, which slices of a
    file can work out on their own once they know how the slice before ended.
    """
    patterns = patterns or fixed.CONSOLE_PATTERNS
    keys = list(patterns)
    found = once(lines.select(file, order, value), **line_values(F.col(value), patterns)).drop(value)
    other = F.coalesce(*[F.col(k) for k in keys if k != "step"]).isNotNull()
    kind = (
        F.when(F.col("step").isNotNull() & other, F.lit("b"))
        .when(F.col("step").isNotNull(), F.lit("s"))
        .when(other, F.lit("o"))
    )
    rows = found.withColumn("_x", kind).where("_x IS NOT NULL")
    sizes = lines.select(file)
    rows, cut = sliced_rows(rows, [file], [F.col(order)], limit, slice_rows, sizes)
    here = slice_window([file], cut, F.col(order))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)

    rows = with_carry(rows, [file], cut, [("max", F.max(F.struct("_n", "_x")), "_end", "struct<_n: bigint, _x: string>")])
    before = F.coalesce(F.lag("_x").over(here), F.col("_end")["_x"])
    fresh = before.isNull() | (before == "b") | (before == F.col("_x"))
    rows = rows.withColumn("_start", F.when(fresh, F.col("_n"))).drop("_end")

    rows = with_carry(rows, [file], cut, [("max", F.max("_start"), "_open", "bigint")])
    start = F.coalesce(F.max("_start").over(upto), F.col("_open"))
    done = (F.col("_x") == "b") | ((F.col("_n") - start) % 2 == 1)
    rows = rows.withColumn("_done", done.cast("int")).drop("_open", "_start")

    rows = with_carry(rows, [file], cut, [("sum", F.sum("_done"), "_past", "bigint")])
    complete = F.sum("_done").over(upto) - F.col("_done") + F.coalesce("_past", F.lit(0))
    rows = rows.withColumn("record", complete.cast("bigint"))

    latest = [F.max_by(k, F.when(F.col(k).isNotNull(), F.col("_n"))).alias(k) for k in keys]
    records = rows.groupBy(file, "record").agg(*latest, F.max("_done").alias("_done")).where("_done = 1")
    numbers = [t.to_float(F.col(k)).alias(k) for k in keys]
    texts = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    raw = F.map_filter(texts, lambda _, v: v.isNotNull() & t.to_float(v).isNull())
    return records.select(file, "record", *numbers, raw.alias("raw"))
