"""JSON arrays read by many tasks: one file is cut into blocks, whatever stands on a block's edge.

Spark's JSON reader takes an array file whole. Here the text reader cuts the file, with ``}`` as its
separator, so a block is a run of pieces that end in a closing brace. What a brace or quote means
depends on the state in which a block is entered: inside a string or not, and how deep. The escape
state is always clear there, as the character before is a brace.

1. Every block is scanned once for both entry states: does it flip the string state, and how much
   deeper or higher does it end. That is one small row per block.
2. The rows are composed along each file, which gives each block's true entry state.
3. Every block is scanned again from that state. Elements that lie in it whole come out as they are;
   what precedes its first end and what follows its last one are pieces, which are put together per
   file, a few per block.

Rows equal those of the one-task read, for arrays of objects and files of one object, in any order. What
is no JSON object where an element is due, or a file that ends inside an element, raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

QUOTE, BACKSLASH = ord('"'), ord("\\")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
_BLOCK = ["file", "block"]


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped, that is, behind an even number of backslashes."""
    at = np.flatnonzero(data == QUOTE)
    behind = at[(at > 0) & (data[at - 1] == BACKSLASH)]
    if not len(behind):
        return at
    plain = np.flatnonzero(data != BACKSLASH)
    before = np.searchsorted(plain, behind) - 1  # the last other character before the backslashes
    run = behind - 1 - np.where(before >= 0, plain[np.maximum(before, 0)], -1)
    return np.setdiff1d(at, behind[run % 2 == 1], assume_unique=True)


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, whether an odd number of quotes precedes each, and the number of quotes."""
    quotes = _quotes(data)
    at = np.flatnonzero(_DEPTH[data])
    return at, np.searchsorted(quotes, at) % 2 == 1, len(quotes)


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, bytes]]:
    """Runs of pieces of one block, each with its closing brace again."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        values, start = batch.column("value").to_pylist(), 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                yield keys[start], b"".join(v + b"}" for v in values[start:k])
                start = k


def _block_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: quotes, depth gained if entered outside a string, and inside one, bytes, first character."""
    found: dict[tuple, list] = {}
    for key, chunk in _chunks(batches, ("file", "block", "size")):
        data = np.frombuffer(chunk, np.uint8)
        at, odd, quotes = _brackets(data)
        gain = _DEPTH[data[at]].astype(np.int64)
        own = found.setdefault(key, [0, 0, 0, 0, None])
        inside = odd ^ bool(own[0] % 2)  # if the block is entered outside a string
        own[1] += int(gain[~inside].sum())
        own[2] += int(gain[inside].sum())
        own[0] += quotes
        own[3] += len(chunk)
        if own[4] is None:
            own[4] = chunk.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") or None
    names = ["file", "block", "size", "quotes", "outside", "inside", "bytes", "first"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
    rows = [(*key, *own) for key, own in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)


class _Cutter:
    """Cuts one block into elements, from the state in which it is entered."""

    def __init__(self, in_string: bool, depth: int, level: int):
        self.in_string, self.depth, self.level = in_string, depth, level
        self.head: bytes | None = None  # up to the first end, if there is one
        self.rest: list[bytes] = []

    def feed(self, chunk: bytes) -> list[bytes]:
        data = np.frombuffer(chunk, np.uint8)
        at, odd, quotes = _brackets(data)
        at = at[~(odd ^ self.in_string)]
        depth = self.depth + np.cumsum(_DEPTH[data[at]].astype(np.int64))
        # an element ends where a brace closes down to the level of the array
        ends = at[(depth == self.level) & (data[at] == ord("}"))] + 1
        self.in_string ^= quotes % 2 == 1
        self.depth = int(depth[-1]) if len(depth) else self.depth
        out, start = [], 0
        for end in ends.tolist():
            text = b"".join([*self.rest, chunk[start:end]])
            self.rest, start = [], end
            if self.head is None:
                self.head = text
            else:
                out.append(text)
        self.rest.append(chunk[start:])
        return out


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size of the file, value, row): the pieces between braces, ``row`` ascending within a block."""
    pieces = spark.read.option("lineSep", "}").text(path)
    names = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    where = [F.col(f"_metadata.{c}").alias(name) for name, c in names.items()]
    return pieces.select(*where, F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("row"))


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, level) with which each block is entered; ``level`` is the depth of the elements' array."""
    numbers = "size bigint, quotes bigint, outside bigint, inside bigint, bytes bigint"
    schema = f"file string, block bigint, {numbers}, first string"
    effects = pieces.select("file", "block", "size", "value").mapInArrow(_block_effects, schema)
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)) == 1
    known = effects.withColumn("in_string", in_string)
    known = known.withColumn("_gain", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("_gain").over(before), F.lit(0))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("first", ignorenulls=True).over(whole)
    # the last piece of a file gets a brace too, though it need not have one
    more = F.sum("bytes").over(whole) - F.col("size")  # a byte order mark of three bytes is left out by the reader
    gain = F.sum("_gain").over(whole)
    added = F.when(more.isin(0, -3), 0).when(more.isin(1, -2), 1)  # unknown for a compressed file
    closed = F.when(added.isNull(), gain.isin(0, -1)).otherwise(gain + added == 0)
    ended = closed & (F.sum("quotes").over(whole) % 2 == 0)
    broken = F.raise_error(F.concat(F.lit("JSON ends within an element: "), "file")).cast("int")
    level = F.when(~ended & first.isNotNull(), broken).when(first == "[", 1).otherwise(0)
    return known.select(*_BLOCK, "in_string", depth.alias("depth"), level.alias("level"))


_CUT = "file string, block bigint, part int, closed boolean, text binary"


def _cut(whole: bool):
    """Elements that lie in a block whole, or else the pieces at its edges: part 0 up to its first end, 1 behind its last."""

    def rows(key: tuple, cutter: _Cutter, texts: list[bytes]) -> list[tuple]:
        if whole:
            return [(*key, 0, True, t) for t in texts]
        edges = [(*key, 0, True, cutter.head)] if cutter.head is not None else []
        return [*edges, (*key, 1, False, b"".join(cutter.rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["file", "block", "part", "closed", "text"]

        def frame(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate(kinds)], names=names)

        key, cutter = None, None
        for state, chunk in _chunks(batches, ("file", "block", "in_string", "depth", "level")):
            if state[:2] != key:
                if cutter is not None and not whole:
                    yield frame(rows(key, cutter, []))
                key, cutter = state[:2], _Cutter(state[2], state[3], state[4])
            texts = cutter.feed(chunk)
            if whole:
                if cutter.head is None:
                    cutter.rest = []  # belongs to a piece at the edge
                yield frame(rows(key, cutter, texts))
        if cutter is not None and not whole:
            yield frame(rows(key, cutter, []))

    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the text of every element of the JSON arrays, or single objects, at ``path``."""
    pieces = _blocks(spark, path)
    entered = pieces.join(_entries(pieces), _BLOCK).sortWithinPartitions(*_BLOCK, "row").drop("row", "size")
    inner = entered.mapInArrow(_cut(True), _CUT).select("file", "text")
    edges = entered.mapInArrow(_cut(False), _CUT)
    along = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = edges.withColumn("_element", F.coalesce(F.sum(F.col("closed").cast("int")).over(along), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("block", "part", "text")))
    joined = numbered.groupBy("file", "_element").agg(F.max("closed").alias("closed"), parts.alias("parts"))
    # behind the last element only the array's end may stand
    text = F.decode(F.aggregate("parts", F.unhex(F.lit("")), lambda whole, p: F.concat(whole, p["text"])), "UTF-8")
    left = F.regexp_replace(text, r"^\x{FEFF}?[\s\[\]},]*", "")
    bad = F.raise_error(F.concat(F.lit("no whole JSON element at the end of "), "file")).cast("string")
    edge = joined.select("file", F.when(F.col("closed"), text).when(left != "", bad).alias("text")).where("text IS NOT NULL")
    both = inner.select("file", F.decode("text", "UTF-8").alias("text")).unionAll(edge)
    return both.select("file", F.regexp_replace("text", r"^\x{FEFF}?[\s\[,]+", "").alias("value"))


def read_arrays(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The elements as rows; without a schema, one more pass infers it."""
    elements = array_elements(spark, path).select("value")
    if schema is None:
        schema = spark.read.json(elements.rdd.map(lambda r: r[0])).schema
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")
    return elements.select(parsed).select("row.*")


def longest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the longest file; only names and sizes are looked up."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
