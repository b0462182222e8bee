"""Hierarchical packing of documents into training sequences of several context sizes.

A document's ids end with an end id. Whole windows of the largest size are cut off first; what is
left is routed to the smallest tier (context size) that holds it. Tiers are packed from the longest
down: the longest piece opens a window, the gap takes the longest pieces of shorter tiers that fit,
and the rest of the gap is filled by cutting the next longer piece, so every window is full. What
remains at the end of a partition becomes windows of falling powers of two, so nothing is padded.
Full windows of one tier are dealt into step groups of ``STEP_TOKENS`` tokens, longest attention
cost first and back and forth, so that the groups of a tier cost about the same.

Each partition of the table is packed by its own task, ``BUFFER`` ids at a time; nothing is shuffled,
no group can grow, and a lost task is simply run again: sequence numbers follow from the partition's
number and the order of its rows.

Null text is an empty document (its end id alone); repeated rows are packed each; an empty table gives
no rows; a document longer than a window fills several. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm.common import read
from rubrica.llm.tokens import default_vocabulary, encoder

#: Context sizes, all powers of two.
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Ids held by a task before it packs them.
BUFFER = 1 << 20
#: Tokens of a training step.
STEP_TOKENS = 1 << 16


@dataclass(frozen=True)
class Piece:
    """``length`` ids of a document from ``start``; ``ids`` are the whole document's."""

    doc: object
    ids: np.ndarray
    start: int
    length: int

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.ids, self.start, size),
            Piece(self.doc, self.ids, self.start + size, self.length - size),
        )


class _Shelf:
    """Pieces of one tier by length."""

    def __init__(self):
        self.lengths: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.added = 0

    def add(self, piece: Piece) -> None:
        self.added += 1
        self.pieces[self.added] = piece
        insort(self.lengths, (piece.length, self.added))

    def _take(self, k: int) -> Piece:
        return self.pieces.pop(self.lengths.pop(k)[1])

    def longest(self) -> Piece:
        return self._take(-1)

    def fitting(self, size: int) -> Piece | None:
        """The longest piece of at most ``size``."""
        k = bisect_right(self.lengths, (size, self.added + 1)) - 1
        return self._take(k) if k >= 0 else None

    def above(self, size: int) -> Piece | None:
        """The shortest piece longer than ``size``."""
        k = bisect_right(self.lengths, (size, self.added + 1))
        return self._take(k) if k < len(self.lengths) else None

    def __len__(self) -> int:
        return len(self.lengths)


def pack_pieces(pieces: Sequence[Piece], tiers: Sequence[int] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces), and the pieces left over, fewer ids than the largest tier holds."""
    tiers = sorted(tiers)
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    shelves = {t: _Shelf() for t in tiers}

    def route(piece: Piece) -> None:
        while piece.length >= top:
            full, piece = piece.cut(top)
            windows.append((top, [full]))
        if piece.length:
            shelves[next(t for t in tiers if t >= piece.length)].add(piece)

    for piece in pieces:
        route(piece)
    for at in range(len(tiers) - 1, -1, -1):
        size = tiers[at]
        below = [shelves[t] for t in reversed(tiers[: at + 1])]
        while shelves[size]:
            window = [shelves[size].longest()]
            gap = size - window[0].length
            while gap:
                found = next((p for shelf in below if (p := shelf.fitting(gap))), None)
                if found is None:
                    longer = next((p for shelf in reversed(below) if (p := shelf.above(gap))), None)
                    if longer is None:
                        return windows, window
                    found, rest = longer.cut(gap)
                    route(rest)
                window.append(found)
                gap -= found.length
            windows.append((size, window))
    return windows, []


def tail_windows(pieces: Sequence[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows of falling powers of two that hold the pieces without padding."""
    todo = list(reversed(pieces))
    left = sum(p.length for p in pieces)
    windows = []
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            piece = todo.pop()
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                todo.append(rest)
            window.append(piece)
            gap -= piece.length
        windows.append((size, window))
        left -= size
    return windows


def step_groups(windows: Sequence[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number per window: groups hold windows of one tier, ``step_tokens`` in all, and share
    out the tier's attention cost evenly."""
    groups = [0] * len(windows)
    first = 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda k: -sum(p.length * p.length for p in windows[k][1]))
        count = -(-len(own) * tier // step_tokens)
        for rank, k in enumerate(own):
            lap, place = divmod(rank, count)
            groups[k] = first + (place if lap % 2 == 0 else count - 1 - place)
        first += count
    return groups


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    tiers: Sequence[int] = TIERS,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: document, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier
    (ids in the sequence), step (its group) and, with ``with_ids``, the ids themselves."""
    path, tiers = vocabulary or default_vocabulary(), tuple(tiers)
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context sizes must be powers of two")
    source = docs.select(F.col(id_column).alias("_doc"), F.col(text).cast("string").alias("_text"))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    schema = f"`{id_column}` {source.schema['_doc'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in numbers)
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        base = TaskContext.get().partitionId() << 33
        sequence = step = base
        pieces: list[Piece] = []
        held, kind = 0, None

        def rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal sequence, step
            out: list[list] = [[] for _ in range(9)]
            ids: list[np.ndarray] = []
            groups = step_groups(windows)
            for (tier, window), group in zip(windows, groups):
                offset = 0
                for p in window:
                    own = p.ids[p.start : p.start + p.length]
                    crc = zlib.crc32(own.astype("<u4").tobytes())
                    row = (p.doc, p.start, p.length, crc, len(p.ids), sequence, offset, tier, step + group)
                    for column, value in zip(out, row):
                        column.append(value)
                    ids.append(own)
                    offset += p.length
                sequence += 1
            step += max(groups, default=-1) + 1
            columns = [pa.array(out[0], kind), *[pa.array(c, pa.int64()) for c in out[1:]]]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[id_column, *numbers, *(["ids"] if with_ids else [])])

        for batch in batches:
            kind = batch.schema.field("_doc").type
            names = batch.column("_doc").to_pylist()
            texts = (v.as_py() for v in batch.column("_text"))
            for doc, ids in zip(names, words.encode_all(texts)):
                ids = np.append(ids, np.uint32(end_id))
                pieces.append(Piece(doc, ids, 0, len(ids)))
                held += len(ids)
                if held >= BUFFER:
                    windows, pieces = pack_pieces(pieces, tiers)
                    held = sum(p.length for p in pieces)
                    yield rows(windows)
        windows, left = pack_pieces(pieces, tiers)
        if windows or left:
            yield rows(windows + tail_windows(left))

    return source.mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
