"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.session import fresh_path

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Characters that end a word of letters and digits: all of ASCII but digits, a-z (and A-Z before lowering).
NO_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage, lets two branches read the same rows, and tells the planner the real size.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Cut texts into runs of about ``most`` characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


_BLANK = re.compile(r"[\x20\x09-\x0D]")


def cut_text(text: str, most: int) -> Iterator[str]:
    """Cut a long text into pieces of about ``most`` characters, at white space."""
    start = 0
    while len(text) - start > most:
        found = _BLANK.search(text, start + most)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end
    yield text[start:]
