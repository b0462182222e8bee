"""Ranked lexical search over document FP-trees.

Documents are reduced to their *restricted term vectors*: the terms that occur in some item, each with
its count, the most frequent term first. Documents that begin with the same terms share a path of a
trie. A task holds its documents in tries of at most ``ENTRIES`` vector entries, sorted by vector; a
branch is then a run of neighbours, and the length of their common prefix is its depth. For branches it
keeps the largest count of every term below (``tf``) and the smallest length measure (``m``): as a
score rises with ``tf`` and falls with ``m``, they bound the score of every document of the branch. All
items go down the trie together, depth first, each with a bound of its own: an item leaves a branch as
soon as its bound falls below its tenth score so far, or equals it where only greater ids are left. Tenth
scores are carried from trie to trie. At a leaf the score is exact. Bounds are made for branches of at
most half the size of the last one bounded, so an entry takes part in few of them.

The text is read once per part of the items: vectors are written to the shared folder, where their
counts (documents, terms, documents per term) are summed before the scan. Items are taken in parts of
``ITEM_BYTES`` of text, so any number of them can be ranked; a part is what driver and broadcasts hold.
Every task returns its ten best per item, and these are ranked in two steps.

A score is ``sum(w * ((10**9 * tf) div (1000 * tf + 8 * m)))`` over an item's terms, repeats included, in
64-bit integers. NULL or empty texts have no terms: such documents are in no count and no result, such
items have no result. Repeated rows, of documents and of items alike, count and are ranked each. Equal
scores go by ascending doc_id, a NULL doc_id last. Empty tables give an empty result. Texts are read
whole, piece by piece. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rubrica.llm.common import read, written
from rubrica.llm.topk import best_per_key

BEST = 10
#: Most vector entries of one trie.
ENTRIES = 300_000
#: Most bytes of item text taken at once.
ITEM_BYTES = 8 << 20
#: Bytes of text cut into terms at once.
PIECE = 1 << 20
#: Stands for a NULL doc_id.
LAST = (1 << 63) - 1
#: Digits, letters and everything beyond ASCII stay, A-Z lowered; the rest of ASCII separates terms.
TERMS = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
VECTOR = "doc bigint, n bigint, ids array<int>, tfs array<bigint>"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece of the text at a time."""
    clean, start = (text or b"").translate(TERMS), 0
    while start < len(clean):
        end = clean.find(b" ", start + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def length_measure(n: int, documents: int, total: int, b: int = 75) -> int:
    """How long a document of ``n`` terms is: 100 at the average length."""
    return 100 - b + (b * n * documents) // total


def contributions(weights: np.ndarray, tfs: np.ndarray, m: int) -> np.ndarray:
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


# --- vectors -----------------------------------------------------------------------------------------------------


def term_vectors(docs: DataFrame, vocabulary: Sequence[bytes], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, ids, tfs): every document with a term, and its counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(shared.value)}.get
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column("doc"), batch.column("text")):
                counts: Counter = Counter()
                n = 0
                for piece in terms(value.as_py()):
                    n += len(piece)
                    counts.update(map(number, piece))
                if n:
                    counts.pop(None, None)
                    rows.append((key.as_py(), n, list(counts), list(counts.values())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc", "n", "ids", "tfs"],
            )

    key = F.coalesce(F.col(doc).cast("bigint"), F.lit(LAST)).alias("doc")
    return docs.select(key, F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, VECTOR)


def corpus_counts(vectors: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all, and documents per vocabulary term: summed per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, held = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            documents += batch.num_rows
            total += int(np.sum(batch.column("n").to_numpy(zero_copy_only=False)))
            held += np.bincount(batch.column("ids").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        ids = np.concatenate([[-2, -1], some]).astype(np.int32)
        values = np.concatenate([[documents, total], held[some]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values)], names=["id", "value"])

    sums = vectors.select("n", "ids").mapInArrow(run, "id int, value bigint").groupBy("id").agg(F.sum("value").alias("value"))
    found = {r["id"]: r["value"] for r in sums.collect()}  # at most one row per vocabulary term
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(size)], np.int64)


# --- search ------------------------------------------------------------------------------------------------------


class Items:
    """The items of a part: which hold a term and how often, terms numbered by descending frequency."""

    def __init__(self, counts: Sequence[dict[int, int]], held: np.ndarray, documents: int, total: int):
        self.size, self.documents, self.total = len(counts), documents, total
        order = np.argsort(-held, kind="stable")
        self.place = np.empty(len(held), np.int64)
        self.place[order] = np.arange(len(held))
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held[order]]
        self.weights = np.array(weights, np.int64)
        pairs = sorted((int(self.place[t]), i, c) for i, own in enumerate(counts) for t, c in own.items())
        self.items = np.array([p[1] for p in pairs], np.int64)
        self.times = np.array([p[2] for p in pairs], np.int64)
        self.starts = np.searchsorted([p[0] for p in pairs], np.arange(len(held) + 1))

    def scores(self, places: np.ndarray, tfs: np.ndarray, m: int) -> np.ndarray:
        """Every item's score for these terms: exact for a document, a bound for a branch's maxima and minimum."""
        value = contributions(self.weights[places], tfs, m)
        first = self.starts[places]
        count = self.starts[places + 1] - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        sums = np.zeros(self.size, np.int64)
        np.add.at(sums, self.items[at], self.times[at] * np.repeat(value, count))
        return sums


class Best:
    """The best documents of every item so far."""

    def __init__(self, size: int, k: int):
        self.k, self.rows = k, [[] for _ in range(size)]
        self.least = np.zeros(size, np.int64)  # the kth score; 0 while there are fewer
        self.last = np.full(size, np.iinfo(np.int64).min)  # the id that holds it

    def open(self, scores: np.ndarray, doc: int) -> np.ndarray:
        """Items for which such a score, with this id or a greater one, would still count."""
        return (scores > self.least) | ((scores == self.least) & (doc < self.last))

    def add(self, item: int, score: int, doc: int) -> None:
        rows = self.rows[item]
        insort(rows, (-score, doc))
        if len(rows) > self.k:
            rows.pop()
        if len(rows) == self.k:
            self.least[item], self.last[item] = -rows[-1][0], rows[-1][1]


class Trie:
    """Documents of a block, sorted by their vectors; a branch is a run of them."""

    def __init__(self, docs: Sequence[tuple[int, int, np.ndarray, np.ndarray]]):
        """docs: id, m, places ascending, counts."""
        docs = sorted(docs, key=lambda d: d[2].astype(">u4").tobytes())
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.m = [d[1] for d in docs]
        self.starts = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
        self.places = np.concatenate([d[2] for d in docs])
        self.tfs = np.concatenate([d[3] for d in docs])
        self.shared = np.zeros(len(docs), np.int64)  # terms shared with the document before
        for k in range(1, len(docs)):
            a, b = docs[k - 1][2], docs[k][2]
            most = min(len(a), len(b))
            differ = np.flatnonzero(a[:most] != b[:most])
            self.shared[k] = differ[0] if len(differ) else most

    def maxima(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The branch's terms and the largest count of each."""
        places, tfs = (x[self.starts[lo] : self.starts[hi]] for x in (self.places, self.tfs))
        order = np.argsort(places, kind="stable")
        places = places[order]
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        return places[first], np.maximum.reduceat(tfs[order], first)

    def branches(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The branches below the common prefix of a run; those that end with the prefix make one, cut in halves."""
        shared = self.shared[lo + 1 : hi]
        depth = int(shared.min())
        ended = lo + int(np.count_nonzero(self.starts[lo + 1 : hi + 1] - self.starts[lo:hi] == depth))
        if ended == hi:
            return [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        cuts = [lo, *(at for at in (np.flatnonzero(shared == depth) + lo + 1).tolist() if at >= ended), hi]
        return list(zip(cuts[:-1], cuts[1:]))

    def search(self, items: Items, best: Best) -> None:
        """Depth first, rare terms first; ``bounded`` is the size of the last branch above that was bounded."""
        stack = [(0, len(self.ids), np.ones(items.size, bool), 2 * len(self.ids))]
        while stack:
            lo, hi, active, bounded = stack.pop()
            if hi - lo == 1:
                own = slice(self.starts[lo], self.starts[hi])
                scores, doc = items.scores(self.places[own], self.tfs[own], self.m[lo]), int(self.ids[lo])
                for item in np.flatnonzero(active & best.open(scores, doc)):
                    best.add(int(item), int(scores[item]), doc)
                continue
            if 2 * (hi - lo) <= bounded:
                scores = items.scores(*self.maxima(lo, hi), min(self.m[lo:hi]))
                active = active & best.open(scores, int(self.ids[lo:hi].min()))
                bounded = hi - lo
                if not active.any():
                    continue
            stack += [(a, b, active, bounded) for a, b in self.branches(lo, hi)]


def _blocks(batches: Iterator[pa.RecordBatch], items: Items, most: int) -> Iterator[list[tuple]]:
    """Documents that hold a vocabulary term, in blocks of about ``most`` vector entries."""
    block: list[tuple] = []
    size = 0
    for batch in batches:
        docs, lengths = (batch.column(c).to_pylist() for c in ("doc", "n"))
        ids, tfs = batch.column("ids"), batch.column("tfs")
        for k, (doc, n) in enumerate(zip(docs, lengths)):
            places = items.place[ids[k].values.to_numpy(zero_copy_only=False)]
            if not len(places):
                continue
            order = np.argsort(places)
            block.append((doc, length_measure(n, items.documents, items.total), places[order], tfs[k].values.to_numpy(zero_copy_only=False)[order]))
            size += len(places)
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _search_part(docs: DataFrame, texts: Sequence[bytes], doc: str, text: str, k: int, entries: int) -> DataFrame:
    """(item, doc, score): the ``k`` best of every task for every text, by its place in ``texts``."""
    counts = [Counter(term for piece in terms(t) for term in piece) for t in texts]
    vocabulary = sorted(set().union(*counts))
    number = {term: at for at, term in enumerate(vocabulary)}
    vectors = written(term_vectors(docs, vocabulary, doc, text), "term-vectors")
    documents, total, held = corpus_counts(vectors, len(vocabulary))
    items = Items([{number[t]: c for t, c in own.items()} for own in counts], held, documents, total)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own.size, k)
        for block in _blocks(batches, own, entries):
            Trie(block).search(own, best)
        rows = [(item, d, -s) for item, found in enumerate(best.rows) for s, d in found]
        kinds = (("item", pa.int32()), ("doc", pa.int64()), ("score", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    found = vectors.mapInArrow(run, "item int, doc bigint, score bigint")
    return best_per_key(found, ["item"], [F.desc("score"), F.asc("doc")], "doc", k, "rank")


def _parts(asked: DataFrame, most: int) -> Iterator[list[Row]]:
    """The items in runs of about ``most`` bytes of text, read one partition at a time; one empty run if there are none."""
    part: list[Row] = []
    size, any_yet = 0, False
    for row in asked.toLocalIterator():
        part.append(row)
        size += len(row["_text"]) + 64
        if size >= most:
            yield part
            part, size, any_yet = [], 0, True
    if part or not any_yet:
        yield part


def search(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    item_bytes: int = ITEM_BYTES,
    entries: int = ENTRIES,
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents with the highest scores above 0 of every row of ``items``."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias(item), F.col(item_text).cast("string").alias("_text")).where("_text IS NOT NULL")
    found = []
    for rows in _parts(asked, item_bytes):
        ranked = _search_part(docs, [r["_text"].encode() for r in rows], doc, text, k, entries)
        names = spark.createDataFrame([(at, r[item]) for at, r in enumerate(rows)], f"item int, _name {items.schema[item].dataType.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "item"))
    key = F.when(F.col("doc") < LAST, F.col("doc")).alias(doc)
    return reduce(DataFrame.unionAll, found).select(F.col("_name").alias(item), "rank", key, "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark
), terms AS (
  SELECT kind, id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM split
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM split WHERE kind = 'd' AND len(w) > 0
), sizes AS (
  SELECT id, (100 - 75 + (75 * len(w)::BIGINT * docs) // words)::BIGINT AS m FROM split, total WHERE kind = 'd' AND len(w) > 0
), tf AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs
), asked AS (
  SELECT id AS item_id, term, count(*)::BIGINT AS times FROM terms WHERE kind = 'b' GROUP BY ALL
), scored AS (
  SELECT item_id, tf.id AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes ON sizes.id = tf.id GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
