"""Benchmark decontamination by one Aho-Corasick automaton.

Test questions and answers are normalised to words (A-Z lowered; digits, a-z and everything beyond
ASCII) and cut into windows of ``WINDOW`` words. One automaton holds every window with a blank on
either side; a document's normalised text runs through it once, whatever the number of windows.
Each hit is mapped from the normalised text to words, and from words to characters of the original.

Windows are broadcast, at most ``MAX_BYTES`` of them at a time: a larger benchmark is cut by window
hash into parts of bounded size, and every row passes the parts one after the other, each adding what it
finds to the row's own hits. So the automaton fits any executor, no benchmark is too large, and the number
of parts changes no row.

Null or empty texts have no words; an item without words matches nothing; an item without an id hits words
but is not listed; repeated items count once per item_id; repeated documents are scanned alike and all given
back; an empty benchmark leaves every document clean; a long text is scanned whole. Extra columns are ignored whatever their names, and ``drop_contaminated``
and ``cut_contaminated`` keep those of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rubrica.llm.common import LOWER, UPPER, ascii_lower, read, text_of, written

WINDOW = 10
#: Most bytes of window text in one automaton.
MAX_BYTES = 32 << 20
#: Most parts that a task passes in one go.
CHAINED = 6
#: Words of lowered text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWERED = str.maketrans(UPPER, LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWERED))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window with the items that hold it; an item of fewer words than
    ``width`` is a window itself."""
    own = F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(f"({WORD.pattern})"), F.lit(1))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), own.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    cut = F.transform(starts, lambda k: F.array_join(F.slice("w", k + 1, F.lit(width)), " "))
    windows = rows.select("item", F.explode(F.array_distinct(cut)).alias("window"))
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Matcher:
    """The automaton over the windows, and what it finds in a text."""

    def __init__(self, windows: Sequence[tuple[str, Sequence[str]]]):
        self.items = [items for _, items in windows]
        self.widths = [w.count(" ") + 1 for w, _ in windows]
        self.automaton = ahocorasick.Automaton()
        for number, (window, _) in enumerate(windows):
            self.automaton.add_word(f" {window} ", number)
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words in the text, runs of hit words (first, after last), items found."""
        own = words(text)
        if not own or not self.items:
            return len(own), [], []
        line = " " + " ".join(own) + " "
        hits = [(end, number) for end, number in self.automaton.iter(line)]
        if not hits:
            return len(own), [], []
        # the blank behind word k of the normalised text tells which word ends there
        ends = np.cumsum([len(w) + 1 for w in own])
        found: set[str] = set()
        spans = []
        for end, number in hits:
            last = int(np.searchsorted(ends, end)) + 1
            spans.append((last - self.widths[number], last))
            found.update(self.items[number])
        return len(own), united(spans), sorted(found)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word stands in the original text; lowering keeps every character's place."""
    return [m.span() for m in WORD.finditer(text.translate(_LOWERED))]


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that may overlap, as runs that do not."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


_PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
#: What a part adds to: words, hit runs of words, items; and with the last part the runs in characters.
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("_spans", _PAIRS), T.StructField("_items", T.ArrayType(T.StringType()))]
_PLACED = [*_FOUND, T.StructField("_chars", _PAIRS)]


def _scan_part(rows: DataFrame, keep: Sequence[str], windows: Sequence[tuple[str, list[str]]], last: bool) -> DataFrame:
    """Add a part's hits to each row's own: (keep, n_words, _spans, _items) and the text, or with the last part its hits in characters."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    before = "_spans" in rows.columns
    found = _PLACED if last else _FOUND
    carried = [*keep] if last else [*keep, "_text"]
    schema = T.StructType([*rows.select(*carried).schema.fields, *found])
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = {"n_words": pa.int64(), "_spans": pairs, "_items": pa.list_(pa.string()), "_chars": pairs}
    names = [f.name for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            earlier = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()) if before else None
            for value in batch.column("_text"):
                text = value.as_py()
                count, runs, items = matcher.scan(text)
                if earlier is not None:
                    spans, known = next(earlier)
                    runs = united([*runs, *((s["a"], s["b"]) for s in spans)])
                    items = sorted({*items, *known})
                out["n_words"].append(count)
                out["_spans"].append([{"a": a, "b": b} for a, b in runs])
                out["_items"].append(items)
                if last:
                    at = word_spans(text) if runs else []
                    out["_chars"].append([{"a": at[a][0], "b": at[b - 1][1]} for a, b in runs])
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(out[name], kinds[name]) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *names])

    return rows.mapInArrow(run, schema)


#: The windows last used by this worker and their automaton. The windows are held too: an address alone could come to be
#: another list's once a reused worker drops a broadcast.
_LATEST: list[tuple[Sequence[tuple[str, list[str]]], Matcher]] = []


def _matcher(shared) -> Matcher:
    """The worker's automaton for a broadcast; only the latest is held."""
    windows = shared.value
    if not _LATEST or _LATEST[0][0] is not windows:
        _LATEST.clear()
        _LATEST.append((windows, Matcher(windows)))
    return _LATEST[0][1]


def _parts(windows: DataFrame, most: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows in parts of at most about ``most`` bytes, chosen by hash; each is collected alone."""
    windows = written(windows, "windows")  # read once for every part
    weight = F.octet_length("window") + F.lit(16) * F.size("items")
    total = windows.agg(F.sum(weight)).first()[0] or 0
    count = -(-int(total) // most)
    for part in range(max(1, count)):
        chosen = windows if count <= 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == part)
        yield [(r["window"], r["items"]) for r in chosen.collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    width: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (sorted, found)
    and ``spans`` (start, end in characters of the original) to the columns in ``keep``.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    df = _scanned(rows, keep, benchmark_windows(benchmark, width=width), max_bytes)
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])
    spans = F.transform("_chars", lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end")))
    return df.select(*keep, "n_words", hit.alias("n_hit"), F.col("_items").alias("items"), spans.alias("spans"))


def _through(rows: DataFrame, parts: Iterator[list], step: Callable[[DataFrame, list, bool], DataFrame]) -> DataFrame:
    """Let rows pass part after part; ``step`` is told which one is the last. The rows are written before a task would
    hold automata over more than ``MAX_BYTES`` of windows, or many of them, at a time."""
    part, chained, held = next(parts), 0, 0
    for following in parts:
        rows, chained, held = step(rows, part, False), chained + 1, held + _weight(part)
        if chained == CHAINED or held + _weight(following) > MAX_BYTES:
            rows, chained, held = written(rows, "scanned"), 0, 0
        part = following
    return step(rows, part, True)


def _weight(part: list) -> int:
    return sum(len(window) + 16 for window, _ in part)


def _scanned(rows: DataFrame, keep: Sequence[str], windows: DataFrame, max_bytes: int) -> DataFrame:
    """(keep, n_words, _spans, _items, _chars) of rows of (keep, _text)."""
    return _through(rows, _parts(windows, max_bytes), lambda df, part, last: _scan_part(df, keep, part, last))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns; one part of the benchmark after the other
    drops what it finds."""
    parts = _parts(benchmark_windows(benchmark, width=width), max_bytes)
    return _through(docs, parts, lambda df, part, _: _drop_part(df, part, text))


def _drop_part(docs: DataFrame, windows: Sequence[tuple[str, list[str]]], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([not matcher.scan(v.as_py())[1] for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents with every hit passage cut out; other columns and clean texts stay as they are.

    Passages are found by all parts of the benchmark before any is cut.
    """

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for value, spans in zip(texts, found):
            parts, end = [], 0
            for span in spans:
                parts.append(value[end : span["a"]])
                end = span["b"]
            out.append("".join(parts) + value[end:] if len(spans) else value)
        return pd.Series(out, dtype=object)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = _scanned(rows, ["row"], benchmark_windows(benchmark, width=width), max_bytes)
    found = found.withColumn("_cut", cut(F.col(f"row.`{text}`").cast("string"), "_chars"))
    return found.select(*[F.col("_cut").cast(docs.schema[text].dataType).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), items AS (
  SELECT id AS item, len(w) AS width, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 9), lambda k: array_to_string(w[k + 1 : k + 10], ' ')) END) AS win
  FROM split WHERE kind = 'b'
), widths AS (
  SELECT DISTINCT least(width, 10) AS width FROM items
), spots AS (
  SELECT id, width, unnest(range(len(w) - width + 1)) AS spot, w
  FROM split, widths WHERE kind = 'd' AND len(w) >= width
), found AS (
  SELECT s.id, s.spot, s.width, i.item
  FROM (SELECT id, spot, width, array_to_string(w[spot + 1 : spot + width], ' ') AS win FROM spots) s JOIN items i USING (win)
), hit AS (
  SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(spot, spot + width)) AS place FROM found) GROUP BY id
), named AS (
  SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS names
  FROM found GROUP BY id
)
SELECT s.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit h ON s.id = h.id LEFT JOIN named n ON s.id = n.id
WHERE kind = 'd'
"""
