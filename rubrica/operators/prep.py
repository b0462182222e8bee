"""Shaping raw records into training tables, validation, length rules, splits."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType

from rubrica.functions import text as t
from rubrica.operators.ordering import GROUP_LIMIT, SLICE_ROWS, number_rows, sliced_rows


def _field(df: DataFrame, key: str, raw: str | None) -> Column:
    """Value of a key, "" where the key is missing.

    Without ``raw`` a key is missing if the table has no such column. With ``raw``, the column
    holding the JSON line, it is missing where the line lacks it; an explicit null stays NULL.
    """
    if raw is None:
        return F.col(key) if key in df.columns else F.lit("")
    has = F.array_contains(F.json_object_keys(raw), key)
    return F.when(has, F.get_json_object(raw, f"$.{key}")).otherwise(F.lit(""))


def prepare_sft(
    df: DataFrame,
    instruction: str = "instruction",
    input: str = "input",
    output: str = "output",
    raw: str | None = None,
) -> DataFrame:
    """(prompt, response): a non-empty input is appended to the instruction.

    A NULL instruction counts as empty.
    """
    ask = F.coalesce(_field(df, instruction, raw), F.lit(""))
    given = _field(df, input, raw)
    prompt = F.when(given != "", F.concat(ask, F.lit("\n\n输入: "), given)).otherwise(ask)
    return df.select(prompt.alias("prompt"), _field(df, output, raw).alias("response"))


def prepare_rl(
    df: DataFrame,
    prompt: str = "prompt",
    ground_truth: str = "ground_truth",
    data_source: str = "custom",
    raw: str | None = None,
) -> DataFrame:
    """(prompt, ground_truth, data_source); the source is the given constant for every row."""
    return df.select(
        _field(df, prompt, raw).alias("prompt"),
        _field(df, ground_truth, raw).alias("ground_truth"),
        F.lit(data_source).alias("data_source"),
    )


def prepare_dpo(
    df: DataFrame,
    prompt: str = "prompt",
    chosen: str = "chosen",
    rejected: str = "rejected",
    raw: str | None = None,
) -> DataFrame:
    """(prompt, chosen, rejected)."""
    keys = {"prompt": prompt, "chosen": chosen, "rejected": rejected}
    return df.select(*[_field(df, key, raw).alias(name) for name, key in keys.items()])


def conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
) -> DataFrame:
    """Turns to one row per conversation: an array of (role, content) in turn order."""
    message = F.struct(F.col(turn), F.col(role).alias("role"), F.col(content).alias("content"))
    arrays = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"], x["content"]))
    return arrays.select(conversation, messages.alias("conversations"))


def context_replies(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    replier: str = "assistant",
    context_turns: int | None = None,
    limit: int = GROUP_LIMIT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """A row per turn of the replier: (conversation, turn, context, reply), the context an array of (role, content).

    With ``context_turns`` the context holds that many turns before the reply; a long conversation is then
    cut into slices, each of which also gets the last turns of the slice before. Without, it holds all earlier
    turns, which for a conversation of n turns makes n * n / 2 by definition.
    """
    order = [F.col(turn), F.col(role), F.col(content)]
    message = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    kept = [conversation, turn, "context", F.col(content).alias("reply")]
    if context_turns is None:
        earlier = Window.partitionBy(conversation).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return turns.withColumn("context", F.collect_list(message).over(earlier)).where(F.col(role) == replier).select(*kept)
    size = max(slice_rows, context_turns)
    rows, cut = sliced_rows(turns, [conversation], order, limit, size)
    if cut is None:
        rows = rows.withColumns({"_at": F.lit(0), "_own": F.lit(True)})
    else:
        last = F.col("_n") > (F.col(cut) + 1) * size - context_turns
        both = F.when(last, F.array(F.col(cut), F.col(cut) + 1)).otherwise(F.array(F.col(cut)))
        rows = rows.withColumn("_at", F.explode(both)).withColumn("_own", F.col("_at") == F.col(cut))
    earlier = Window.partitionBy(conversation, "_at").orderBy("_n").rowsBetween(-context_turns, -1)
    rows = rows.withColumn("context", F.collect_list(message).over(earlier))
    return rows.where(F.col("_own") & (F.col(role) == replier)).select(*kept)


def missing_columns(df: DataFrame, required: Sequence[str] = ("prompt", "chosen", "rejected")) -> list[str]:
    """Required columns the table lacks; reads the schema only."""
    return [c for c in required if c not in df.columns]


def _missing_keys(required: Sequence[str], raw: str) -> Column:
    wanted = F.array(*[F.lit(k) for k in required])
    present = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.filter(wanted, lambda k: ~F.array_contains(present, k))


def violations(lines: DataFrame, required: Sequence[str], raw: str = "value", row: str = "row_id") -> DataFrame:
    """Rows whose JSON line lacks required keys, with the missing keys in the order required.

    A key holding null counts as present. A line that is no object lacks every key.
    """
    checked = lines.select(row, _missing_keys(required, raw).alias("missing"))
    return checked.where(F.size("missing") > 0)


def validate(lines: DataFrame, required: Sequence[str], raw: str = "value", row: str = "row_id") -> DataFrame:
    """One row: valid, rows, and the first violation (row id and missing keys). Empty is invalid."""
    checked = lines.select(row, _missing_keys(required, raw).alias("missing"))
    bad_row = F.when(F.size("missing") > 0, F.col(row))
    found = checked.agg(
        F.count("*").alias("rows"),
        F.count(bad_row).alias("bad"),
        F.min(bad_row).alias("first_bad"),
        F.min_by("missing", bad_row).alias("missing"),
    )
    valid = (F.col("bad") == 0) & (F.col("rows") > 0)
    return found.select(valid.alias("valid"), "rows", "bad", "first_bad", "missing")


def whitespace_tokens(c: Column) -> Column:
    return F.size(t.words(c))


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Token counter from a Python function, run in Arrow batches."""

    @F.pandas_udf(IntegerType())
    def counter(text: pd.Series) -> pd.Series:
        return text.map(lambda s: count(s) if s is not None else 0).astype("int32")

    return counter


def drop_overlong(
    df: DataFrame,
    limit: int,
    columns: Sequence[str] = ("prompt",),
    tokens: Callable[[Column], Column] = whitespace_tokens,
) -> DataFrame:
    """Keep rows whose columns together hold at most ``limit`` tokens."""
    total = sum((tokens(F.col(c)) for c in columns), F.lit(0))
    return df.where(total <= limit)


def truncate(c: Column, limit: int, mode: str = "right") -> Column:
    """Cut to ``limit`` characters: ``right``/``keep_start`` keep the start, ``left``/``keep_end``
    keep the end, ``error`` fails the query on a longer text."""
    if mode in ("right", "keep_start"):
        return F.substring(c, 1, limit)
    if mode in ("left", "keep_end"):
        return F.when(F.length(c) > limit, F.right(c, F.lit(limit))).otherwise(c)
    if mode == "error":
        message = F.concat(F.lit(f"text longer than {limit} characters: "), F.length(c).cast("string"))
        return F.when(F.length(c) > limit, F.raise_error(message).cast("string")).otherwise(c)
    raise ValueError(f"unknown truncation mode {mode!r}")


def truncate_tokens(c: Column, limit: int, mode: str = "right") -> Column:
    """Cut to ``limit`` words between white space, joined by single blanks; modes as in ``truncate``."""
    words = t.words(c)
    n = F.size(words)
    if mode in ("right", "keep_start"):
        return F.array_join(F.slice(words, 1, limit), " ")
    if mode in ("left", "keep_end"):
        return F.array_join(F.slice(words, F.greatest(n - limit, F.lit(0)) + 1, F.lit(limit)), " ")
    if mode == "error":
        message = F.concat(F.lit(f"text longer than {limit} tokens: "), n.cast("string"))
        return F.when(n > limit, F.raise_error(message).cast("string")).otherwise(c)
    raise ValueError(f"unknown truncation mode {mode!r}")


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of every word between white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def tokenizer_offsets(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Offsets by a tokenizer file (``tokenizers`` format), which must lie on every executor."""
    return functools.partial(_file_offsets, path)


def _file_offsets(path: str, text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b in _tokenizer(path).encode(text, add_special_tokens=False).offsets if b > a]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_tokens(
    limit: int, mode: str = "right", offsets: Callable[[str], list[tuple[int, int]]] = word_offsets
) -> Callable[[Column], Column]:
    """Cut texts to ``limit`` tokens where the tokens stand: the result is part of the text, unchanged.

    ``offsets`` gives the start and end of a text's tokens; modes as in ``truncate``. A text within the limit
    stays whole, white space and all; NULL stays NULL. Runs in Arrow batches.
    """
    if mode not in ("right", "keep_start", "left", "keep_end", "error"):
        raise ValueError(f"unknown truncation mode {mode!r}")

    def cut(text: str | None) -> str | None:
        spans = [] if text is None else offsets(text)
        if len(spans) <= limit:
            return text
        if mode == "error":
            raise ValueError(f"text longer than {limit} tokens: {len(spans)}")
        if not limit:
            return ""
        return text[: spans[limit - 1][1]] if mode in ("right", "keep_start") else text[spans[-limit][0] :]

    @F.pandas_udf(StringType())
    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return cut_all


def split_train_val(
    df: DataFrame,
    key: Sequence[str],
    val_ratio: float = 0.1,
    shuffle: bool = True,
    seed: int = 42,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``split`` (train or val): exactly ``int(n * (1 - val_ratio))`` rows are train.

    ``key`` identifies a row. Shuffled, rows are taken in the order of a seeded hash: counts per
    hash bucket tell in which bucket the cut falls, and only that bucket is ranked. Unshuffled,
    rows keep the order of the key.
    """
    order = [F.col(k) for k in key]
    if not shuffle:
        cut = int(df.count() * (1 - val_ratio))
        numbered = number_rows(df, [], order, "_pos", limit)
        split = F.when(F.col("_pos") <= cut, F.lit("train")).otherwise(F.lit("val"))
        return numbered.withColumn("split", split).drop("_pos")
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *order))
    hashed = hashed.withColumn("_bucket", F.shiftrightunsigned("_h", 48).cast("int"))
    # at most 65,536 buckets, whatever the row count
    counts = sorted((r["_bucket"], r["count"]) for r in hashed.groupBy("_bucket").count().collect())
    cut = int(sum(n for _, n in counts) * (1 - val_ratio))
    before, edge = 0, -1
    for bucket, n in counts:
        if before + n > cut:
            edge = bucket
            break
        before += n
    else:
        return df.withColumn("split", F.lit("train"))
    sure = F.when(F.col("_bucket") < edge, F.lit("train")).otherwise(F.lit("val"))
    rest = hashed.where(F.col("_bucket") != edge).withColumn("split", sure)
    inner = hashed.where(F.col("_bucket") == edge)
    bound = dict(counts)[edge]
    ranked = number_rows(inner, [], [F.col("_h"), *order], "_pos", limit, bound=bound)
    inside = F.when(F.col("_pos") <= cut - before, F.lit("train")).otherwise(F.lit("val"))
    edge_rows = ranked.withColumn("split", inside).drop("_pos")
    return rest.unionByName(edge_rows).drop("_h", "_bucket")
