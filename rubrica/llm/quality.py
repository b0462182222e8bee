"""Quality rules with thresholds learnt from quantile sketches per language and source.

A fixed cutoff is wrong for some language or source: code has long words, German has longer ones
than English. Every document is measured; each measure is summarised per (language, source) cell
by a histogram of exponentially growing buckets, a quantile sketch that merges by adding counts,
does not depend on the order of rows and never misses a bucket boundary by more than 1/32 of the
value. A threshold is the cell's median plus ``SPREADS`` times its interquartile range. Quartiles are
shrunk: a cell's own count for their rows, those of its language for ``prior_rows`` more, and a
language's likewise towards those of all documents. So a small cell follows its language, a large one
itself, and no single row moves a threshold far.

Everything runs on built-in functions; the only shuffles carry bucket counts.

Null text counts as empty, NULL language or source is a value like any other, an empty table gives
no rows, repeated rows are judged like any others, long texts are measured whole. Extra columns,
whatever their names, stay out of the measures and are kept by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rubrica.llm.common import BLANK_RUN, BLANKS, UPPER, read, text_of, written
from rubrica.session import once

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Fixed rules: fewest words, and most words in repeated windows (per cent).
MIN_WORDS, MAX_REPEAT = 10, 20
#: Measures in thousandths, with the least interquartile range a cell is taken to have and whether
#: low values are suspicious too. The least range keeps uniform cells from rejecting ordinary text.
MEASURES = {
    "word_length": (500, True),
    "symbol_share": (20, False),
    "upper_share": (40, False),
    "dup_line_share": (70, False),
    "repeat_share": (30, False),
}
#: Interquartile ranges between the median and a threshold.
SPREADS = 6
#: Documents that the quartiles of a cell's language count for beside the cell's own.
PRIOR_ROWS = 200
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the array of window hashes."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        def at(row: Column, k: Column) -> Column:
            twin = (F.get(rows, k - 1)["h"] == row["h"]) | (F.get(rows, k + 1)["h"] == row["h"])
            return F.when(twin, row["i"])

        return F.filter(F.transform(rows, at), lambda i: i.isNotNull())

    starts = F.sort_array(F.get(F.transform(F.array(pairs), repeated), F.lit(0)))
    zero = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("end"))

    def cover(acc: Column, start: Column) -> Column:
        end = start + F.lit(WINDOW)
        return F.struct((acc["total"] + end - F.greatest(acc["end"], start)).alias("total"), end.alias("end"))

    return F.aggregate(starts, zero, cover, lambda acc: acc["total"])


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counts of ``BASE`` and the shares of ``MEASURES`` (thousandths) to the columns in ``keep``.

    Words are runs of anything but white space; a repeated word lies in a five-word window found
    twice or more in its text; a repeated line holds a word and equals an earlier line.
    """
    df = docs.select(*[F.col(c) for c in (keep or [])], text_of(text).alias("_text"))
    df = once(df, _trim=F.btrim(F.col("_text"), F.lit(BLANKS)))
    empty = F.array().cast("array<string>")
    df = once(df, _words=F.when(F.col("_trim") == "", empty).otherwise(F.split("_trim", BLANK_RUN)))
    size = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), size - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get("_words", i + F.lit(k)) for k in range(WINDOW)]),
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    df = once(
        df,
        _windows=F.when(size >= WINDOW, window).otherwise(F.array().cast("array<bigint>")),
        _lines=lines,
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = once(
        df,
        n_words=size.cast("bigint"),
        word_chars=F.length(_without(F.col("_text"), BLANKS)).cast("bigint"),
        n_symbols=(F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("bigint"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        n_repeat_words=F.when(repeats, _repeat_words(F.col("_windows"))).otherwise(0).cast("bigint"),
        _n_lines=F.size("_lines").cast("bigint"),
        _upper=(F.length("_text") - F.length(_without(F.col("_text"), UPPER))).cast("bigint"),
    )

    def share(part: str, whole: str) -> Column:
        return F.floor(F.lit(1000) * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("bigint")

    return df.select(
        *(keep or []),
        *BASE,
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "n_words").alias("symbol_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words")
    )


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: the value with all but its six highest bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - F.lit(6), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One mergeable sketch per (language, source, measure): rows of (bucket, n). Documents that
    the fixed rules reject tell nothing of what is usual and stay out."""
    each = F.array(
        *[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]
    )
    rows = measured.where(~base_failed()).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(each)
    )
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches of finer cells into those of ``by``."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows, lower quartile, median and upper quartile per cell and measure. A window holds the
    buckets of one cell, some hundreds at most."""
    keys = [*by, "measure"]
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    df = sketches.select(
        *keys,
        "bucket",
        F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
    )

    def quantile(quarter: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * quarter, F.col("bucket")))

    return df.groupBy(*keys).agg(
        F.max("total").alias("total"),
        quantile(1).alias("q1"),
        quantile(2).alias("q2"),
        quantile(3).alias("q3"),
    )


def thresholds(sketches: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Lowest and highest accepted value per (language, source) and measure: (lang, source,
    low_<measure>, high_<measure>), one row per cell."""
    cell = quartiles(sketches, ["lang", "source"])
    by_lang = quartiles(merge(sketches, ["lang"]), ["lang"])
    overall = quartiles(merge(sketches, []), [])
    stats = ["total", "q1", "q2", "q3"]
    lang_stats = by_lang.select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), *[F.col(s).alias(f"l_{s}") for s in stats])
    all_stats = overall.select(F.col("measure").alias("_a"), *[F.col(s).alias(f"a_{s}") for s in stats])
    df = cell.join(
        lang_stats, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m")), "left"
    ).join(all_stats, F.col("measure") == F.col("_a"), "left")

    def shrunk(own: Column, rows: Column, towards: Column) -> Column:
        return F.call_function("div", rows * own + F.lit(prior_rows) * towards, rows + F.lit(prior_rows))

    def pick(stat: str) -> Column:
        by_lang = shrunk(F.col(f"l_{stat}"), F.col("l_total"), F.col(f"a_{stat}"))
        return shrunk(F.col(stat), F.col("total"), by_lang)

    df = df.select("lang", "source", "measure", *[pick(s).alias(s) for s in ("q1", "q2", "q3")])
    fences = []
    for name, (least, both) in MEASURES.items():
        reach = F.lit(SPREADS) * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        own = F.col("measure") == name
        low = F.col("q2") - reach if both else F.lit(0).cast("bigint")
        fences += [
            F.max(F.when(own, low)).alias(f"low_{name}"),
            F.max(F.when(own, F.col("q2") + reach)).alias(f"high_{name}"),
        ]
    return df.groupBy("lang", "source").agg(*fences)


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join each document to its cell's thresholds and add ``base_failed``, ``failed`` (the measures
    outside their thresholds) and ``kept``. The thresholds are one row per cell, so the adaptive
    skew join splits a source that holds much of the table."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    outside = [
        F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in MEASURES
    ]
    df = measured.join(limits, same, "left").drop("_lang", "_source")
    df = df.withColumns({"base_failed": base_failed(), "failed": F.concat_ws(",", *outside)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Thresholds of a whole table of documents."""
    measured = measure(docs.select(F.col(text).alias("_t"), F.col(lang).alias("_l"), F.col(source).alias("_s")), "_t", ["_l", "_s"])
    return written(thresholds(sketch(measured, "_l", "_s")), "thresholds")


def filter_documents(docs: DataFrame, limits: DataFrame | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass the fixed rules and their cell's thresholds, with all their columns.

    ``limits`` are thresholds learnt before. By default they are those of ``docs`` itself: the rows that
    pass the fixed rules are then written once with their measures, which both steps read back.
    """
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(text).alias("_t"), F.col(lang).alias("_l"), F.col(source).alias("_s")
    )
    measured = measure(rows, "_t", ["_row", "_l", "_s"])
    if limits is None:
        measured = written(measured.where(~base_failed()), "measured")
        limits = written(thresholds(sketch(measured, "_l", "_s")), "thresholds")
    return judge(measured, limits, "_l", "_s").where("kept").select("_row.*")


def judged_documents(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document; the measures are written once, as both the sketches
    and the verdict need them."""
    measured = written(measure(docs, "text", ["doc_id", "lang", "source"]), "measures")
    limits = written(thresholds(sketch(measured)), "thresholds")
    return judge(measured, limits)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_documents(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "failed")


_SQL_MEASURES = ", ".join(f"('{m}', {least}, {str(both).lower()})" for m, (least, both) in MEASURES.items())

OP9_SQL = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS spot, w FROM texts WHERE len(w) >= 5
), repeated AS (
  SELECT doc_id, unnest(range(spot, spot + 5)) AS place
  FROM (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, array_to_string(w[spot + 1 : spot + 5], ' ')) AS times FROM windows)
  WHERE times > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), base AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, len(lines) AS n_lines
  FROM texts t LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), long AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {{'m': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1)}},
    {{'m': 'symbol_share', 'v': 1000 * n_symbols // greatest(n_words, 1)}},
    {{'m': 'upper_share', 'v': 1000 * n_upper // greatest(word_chars, 1)}},
    {{'m': 'dup_line_share', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}},
    {{'m': 'repeat_share', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}}], recursive := true)
  FROM judged
), buckets AS (
  SELECT *, (v >> greatest(length(bin(v)) - 6, 0)::INT) << greatest(length(bin(v)) - 6, 0)::INT AS b FROM long
), cells AS (
  SELECT m, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s, b FROM buckets WHERE NOT base_failed
  UNION ALL SELECT m, coalesce(lang, chr(0)), NULL, b FROM buckets WHERE NOT base_failed
  UNION ALL SELECT m, NULL, NULL, b FROM buckets WHERE NOT base_failed
), counted AS (
  SELECT m, l, s, b, sum(count(*)) OVER (PARTITION BY m, l, s ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY m, l, s) AS total
  FROM cells GROUP BY m, l, s, b
), quarters AS (
  SELECT m, l, s, any_value(total) AS total, min(b) FILTER (upto * 4 >= total) AS q1,
    min(b) FILTER (upto * 4 >= total * 2) AS q2, min(b) FILTER (upto * 4 >= total * 3) AS q3
  FROM counted GROUP BY m, l, s
), chosen AS (
  SELECT c.m, c.l, c.s,
    (c.total * c.q1 + {PRIOR_ROWS} * ((g.total * g.q1 + {PRIOR_ROWS} * a.q1) // (g.total + {PRIOR_ROWS}))) // (c.total + {PRIOR_ROWS}) AS q1,
    (c.total * c.q2 + {PRIOR_ROWS} * ((g.total * g.q2 + {PRIOR_ROWS} * a.q2) // (g.total + {PRIOR_ROWS}))) // (c.total + {PRIOR_ROWS}) AS q2,
    (c.total * c.q3 + {PRIOR_ROWS} * ((g.total * g.q3 + {PRIOR_ROWS} * a.q3) // (g.total + {PRIOR_ROWS}))) // (c.total + {PRIOR_ROWS}) AS q3
  FROM quarters c JOIN quarters g ON g.m = c.m AND g.l = c.l AND g.s IS NULL
  JOIN quarters a ON a.m = c.m AND a.l IS NULL WHERE c.s IS NOT NULL
), fences AS (
  SELECT c.m, l, s, CASE WHEN two_sided THEN q2 - {SPREADS} * greatest(q3 - q1, spread) ELSE 0 END AS low,
    q2 + {SPREADS} * greatest(q3 - q1, spread) AS high
  FROM chosen c JOIN (VALUES {_SQL_MEASURES}) x(m, spread, two_sided) USING (m)
), failures AS (
  SELECT doc_id, string_agg(b.m, ',' ORDER BY list_position({list(MEASURES)}, b.m)) AS failed
  FROM buckets b JOIN fences f ON f.m = b.m AND f.l = coalesce(lang, chr(0)) AND f.s = coalesce(source, chr(0))
  WHERE v < low OR v > high GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM judged LEFT JOIN failures USING (doc_id)
"""
