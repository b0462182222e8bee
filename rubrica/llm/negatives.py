"""Hard-negative mining by the threshold algorithm.

Vectors become integers, ``floor(256 * x)`` per component. A task holds its rows in blocks; per block and
dimension there is a list of the rows sorted by that component. For an anchor the lists are read from
their high end where its component is positive, from their low end where it is negative (*sorted
access*); a row first met in any list is scored in full (*random access*). The components last read,
times the anchor's, add up to the threshold: no row still unread can score more. Reading stops once the
threshold falls strictly below the ``k``-th score of every window, or below the window itself, or all
rows are read. The ``k``-th scores are carried from block to block. Depths double from round to round.

There are two rounds over the rows: the first finds an anchor's positives, reading the lists of its own
label, the second the best rows of other labels in each positive's window of scores. Anchors are
taken in parts of ``ANCHOR_BYTES``, which is what the driver collects and broadcasts; each task
returns at most ``k`` rows per window, and these are ranked in two steps. Work grows as anchors times
rows, as every anchor asks for all rows; parts and blocks bound the memory.

Rows with a NULL vec_id, label or vector, or with a NULL, NaN or infinite component take no part. Rows
that share a vec_id count as one, the one with the smallest label, then vector; so repeated rows change
nothing. Rows with vectors of another length than the anchor's are not its candidates; vectors of length
0 score 0. A positive below 0 has an empty window. Equal scores go by ascending vec_id. Empty tables
give an empty result; extra columns play no part. Components whose scores could exceed 62 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rubrica.llm.common import read, written
from rubrica.llm.topk import best_per_key

POSITIVES, NEGATIVES = 5, 10
#: Window of negatives, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows of a block.
BLOCK = 8192
#: Most bytes of anchor vectors and windows taken at once.
ANCHOR_BYTES = 16 << 20
#: Depth to which lists are read in the first round.
DEPTH = 16


# --- one block ---------------------------------------------------------------------------------------------------


class Lists:
    """Rows with their per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        largest = int(np.abs(vectors).max(initial=0))
        self.largest = largest
        # sums below 2**53 are exact in doubles, which multiply faster
        self.exact_doubles = largest * largest * max(1, vectors.shape[1]) < 1 << 53
        self.vectors = vectors.astype(np.float64) if self.exact_doubles else vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32).copy()  # a line per dimension
        self.sorted = np.sort(vectors, axis=0).T.copy()

    def rounds(self, anchor: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows met first, their scores, threshold) of each round of sorted access, until all rows are read."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        wide = self.vectors.dtype if self.exact_doubles and int(np.abs(anchor).max(initial=0)) <= self.largest else np.int64
        if not len(up) and not len(down):  # no list tells rows apart
            yield np.arange(n), np.zeros(n, np.int64), 0
            return
        start = 0
        while start < n:
            end = min(n, max(depth, 2 * start))
            met = np.zeros(n, bool)
            met[self.order[up, n - end : n - start]] = True
            met[self.order[down, start:end]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            scores = (self.vectors[fresh].astype(wide, copy=False) @ anchor.astype(wide)).astype(np.int64)
            last = int(anchor[up] @ self.sorted[up, n - end]) + int(anchor[down] @ self.sorted[down, end - 1])
            yield fresh, scores, last
            if seen.all():
                return
            start = end


class Window:
    """The best ``k`` rows with a score between ``low`` and ``high``, so far."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.ones(len(scores), bool)
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            inside &= scores >= self.scores[-1]
        if not inside.any():
            return
        scores, ids = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]

    def closed(self, threshold: int) -> bool:
        """No row that scores at most ``threshold`` can enter."""
        if self.low is not None and (threshold < self.low or self.low > self.high):
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]


def fill(lists: Lists, anchor: np.ndarray, windows: Sequence[Window], skip_id: int | None = None, skip_label: int | None = None) -> int:
    """Read the lists until every window is closed; returns how many rows were scored."""
    count = 0
    for rows, scores, threshold in lists.rounds(anchor):
        count += len(rows)
        taken = np.ones(len(rows), bool)
        if skip_id is not None:
            taken &= lists.ids[rows] != skip_id
        if skip_label is not None:
            taken &= lists.labels[rows] != skip_label
        own, ids = scores[taken], lists.ids[rows[taken]]
        for window in windows:
            window.add(own, ids)
        if all(window.closed(threshold) for window in windows):
            break
    return count


# --- rows --------------------------------------------------------------------------------------------------------


def integer_vectors(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, vec): the rows that take part, components as integers, one row per id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    vec = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    value = F.struct(F.col(label).cast("bigint").alias("label"), vec.alias("vec"))
    one = own.select(F.col(key).cast("bigint").alias("id"), value.alias("value")).groupBy("id").agg(F.min("value").alias("value"))
    return one.select("id", "value.label", "value.vec")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most about ``most`` rows with vectors of one length."""
    open_: dict[int, list[tuple]] = {}

    def block(rows: list[tuple], length: int):
        vectors = np.array([r[2] for r in rows], np.int64).reshape(len(rows), length)
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), vectors

    for batch in batches:
        vecs = batch.column("vec")
        for k, (key, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist())):
            vec = vecs[k].values.to_numpy(zero_copy_only=False)
            rows = open_.setdefault(len(vec), [])
            rows.append((key, label, vec))
            if len(rows) >= most:
                yield block(open_.pop(len(vec)), len(vec))
    for length, rows in open_.items():
        yield block(rows, length)


def _check(lists: Lists, anchors: Sequence[tuple]) -> None:
    most = max((int(np.abs(a[2]).max(initial=0)) for a in anchors), default=0)
    if most * lists.largest * max(1, lists.vectors.shape[1]) >= 1 << 62:
        raise ValueError("components too large for 64-bit scores")


def _frame(rows: Sequence[tuple], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(names))], names=list(names))


def nearest_of_label(rows: DataFrame, anchors: Sequence[Row], k: int = POSITIVES, block: int = BLOCK) -> DataFrame:
    """(anchor_id, id, score, rank): the ``k`` best other rows of each anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast([(a["id"], a["label"], list(a["vec"])) for a in anchors])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(key, label, np.array(vec, np.int64)) for key, label, vec in shared.value]
        best = [Window(k) for _ in own]
        for ids, labels, vectors in _blocks(batches, block):
            for label in np.unique(labels):
                asked = [at for at, a in enumerate(own) if a[1] == label and len(a[2]) == vectors.shape[1]]
                if not asked:
                    continue
                same = labels == label
                lists = Lists(ids[same], labels[same], vectors[same])
                _check(lists, [own[at] for at in asked])
                for at in asked:
                    fill(lists, own[at][2], [best[at]], skip_id=own[at][0])
        found = [(own[at][0], int(key), int(score)) for at, w in enumerate(best) for key, score in zip(w.ids, w.scores)]
        yield _frame(found, ("anchor_id", "id", "score"))

    found = rows.mapInArrow(run, "anchor_id bigint, id bigint, score bigint")
    return best_per_key(found, ["anchor_id"], [F.desc("score"), F.asc("id")], "id", k, "rank")


def best_in_windows(rows: DataFrame, asked: Sequence[tuple], k: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score, rank): the ``k`` best rows of other labels in each window.

    ``asked``: anchor id, label, vector, and its windows (positive id, positive score, least score, greatest score).
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(key, label, np.array(vec, np.int64), windows) for key, label, vec, windows in shared.value]
        best = [[Window(k, low, high) for _, _, low, high in a[3]] for a in own]
        for ids, labels, vectors in _blocks(batches, block):
            lists = Lists(ids, labels, vectors)
            asked = [at for at, a in enumerate(own) if len(a[2]) == vectors.shape[1]]
            _check(lists, [own[at] for at in asked])
            for at in asked:
                fill(lists, own[at][2], best[at], skip_label=own[at][1])
        found = [
            (own[at][0], positive, score, int(key), int(value))
            for at, windows in enumerate(best)
            for (positive, score, _, _), w in zip(own[at][3], windows)
            for key, value in zip(w.ids, w.scores)
        ]
        yield _frame(found, ("anchor_id", "positive_id", "positive_score", "id", "score"))

    found = rows.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")
    return best_per_key(found, ["anchor_id", "positive_id"], [F.desc("score"), F.asc("id")], "id", k, "rank")


def _parts(anchors: DataFrame, most: int) -> Iterator[list[Row]]:
    """Anchors in runs of about ``most`` bytes, read one partition at a time; one empty run if there are none."""
    part: list[Row] = []
    size, any_yet = 0, False
    for row in anchors.toLocalIterator():
        part.append(row)
        size += 8 * len(row["vec"]) + 400
        if size >= most:
            yield part
            part, size, any_yet = [], 0, True
    if part or not any_yet:
        yield part


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of ``anchors``.

    ``rows`` and ``anchors`` are as ``integer_vectors`` gives them; a window reaches from ``low`` to
    ``high`` hundredths of the positive's score, both included.
    """
    found = []
    for part in _parts(anchors, anchor_bytes):
        windows: dict[int, list[tuple]] = {}
        for r in nearest_of_label(rows, part, positives, block).collect():  # a few rows for each anchor of the part
            score = r["score"]
            windows.setdefault(r["anchor_id"], []).append((r["id"], score, -(-low * score // 100), high * score // 100))
        asked = [(a["id"], a["label"], list(a["vec"]), windows[a["id"]]) for a in part if a["id"] in windows]
        found.append(best_in_windows(rows, asked, negatives, block))
    names = ["anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    return reduce(DataFrame.unionAll, found).select(*names)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = written(integer_vectors(table.withColumn("label", label)), "vectors")
    return mine(rows, rows.where("id % 100 = 0"))


OP11_SQL = """
WITH valid AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM valid
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
  FROM parts a JOIN parts b ON a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
