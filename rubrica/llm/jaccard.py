"""Exact Jaccard join of documents on word shingles, by set relations.

Every document is the set of its distinct shingles (64-bit hashes). Documents with equal sets are
one node. Two nodes link at a Jaccard similarity of ``SHARE`` per cent or more; the result is each
document's connected component.

*Order.* Shingles are ordered by (common or not, hash), common meaning more than ``COMMON``
occurrences. A set's prefix in that order, ``n - ceil(0.85 n) + 1`` shingles, meets the prefix of
every set it can link with. The low quarter of the hash range is counted over all documents; only
documents whose prefix reaches beyond it (most of their text is common) have the rest counted too.

*Index-level skipping.* An index list holds the sets with a shingle in their prefix. The shingle's
position bounds the overlap still possible, and so the largest partner an entry can have. Lists are
laid out in blocks of sets of similar size; a probe visits only the blocks between its own size and
that bound, and skips the others unread.

*Answer-level skipping.* In each block, entries are first compared with one set only, the pivot. A set
linked to its pivot takes over the pivot's answers: both are in one component, and no pair within
a component is compared again. For a pair of sets of different components the answers of a common
pivot still decide: Jaccard distance is a metric, so sets whose distances to the pivot differ by more
than the threshold cannot link. Only what remains is compared, all of it: no partner is dropped.

So a group of near copies costs about one comparison per copy. Index entries are 8-byte hashes with sizes,
texts travel only for documents that are compared, large lists and large pivot groups are spread by
a salt, and the driver sees only counts and the common shingles, whose number is bounded: the
mark for common is doubled until ``MOST_COMMON`` hold.

The texts of a batch are hashed together, from the column's bytes. Counts and index entries are grouped by
shingle as blocks of numpy rows, one block for each batch and part of the hashes.

Null or wordless texts have an empty set and link with nothing; fewer than four words make one shingle;
repeated rows are one node; a NULL id takes part through a row with an equal set only; an empty table
gives no rows; long texts are hashed whole, piece by piece. Extra columns are ignored whatever their
names, and ``keep_representatives`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.llm.common import cut_text, read, written

WIDTH = 4
SHARE = 85
COMMON = 8
#: Most common shingles told to every task (8 bytes each).
MOST_COMMON = 2_000_000
#: Hashes below are counted over all documents.
LOW = 1 << 62
#: Most document ids broadcast to pick the texts to compare; beyond it, a shuffle join does.
MOST_IDS = 2_000_000
#: Remaining pairs per document up to which all are compared at once.
FEW = 2
#: Members of a pivot group compared by one task.
GROUP = 4096
PIECE = 1 << 20
#: Rows that are grouped by shingle travel in blocks, one for each of so many parts of the hashes.
PARTS = 1 << 14
#: Bytes of text hashed at once; a longer text is hashed by itself.
BLOCK = 1 << 16

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random number per byte value, and powers of a multiplier per place in a word.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_PLACES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1023, _ODD[1])]), dtype=np.uint64)
_IN_WORD = np.ones(256, np.int8)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0
#: For blocks: the same numbers with A-Z taken as a-z, the multiplier's powers and those of its inverse.
_FOLDED = _BYTES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_UP, _DOWN = (
    np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, m, np.uint64)]), dtype=np.uint64)
    for m in (_ODD[1], np.uint64(pow(int(_ODD[1]), -1, 1 << 64)))
)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered, between ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    chars = data[inside[1:-1].view(bool)]
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    value = _BYTES[chars] * _PLACES[place & 1023]
    hashed = _mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64) * _ODD[2])
    for k in np.flatnonzero(sizes > len(_PLACES)):  # places repeat in such a word
        hashed[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return hashed


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = np.concatenate([word_hashes(piece) for piece in cut_text(text or "", PIECE)])
    return _distinct(_folded(words, min(width, len(words)))) if len(words) else words


def _folded(words: np.ndarray, span: int) -> np.ndarray:
    """Hash of each run of ``span`` words."""
    total = np.full(max(len(words) - span + 1, 0), span, np.uint64)
    for k in range(span):
        total = total * _ODD[3] + words[k : k + len(total)]
    return _mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """``shingles`` of every text of a column, from its bytes, many texts at a time."""
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    bounds = np.zeros(1, np.int64)
    if len(texts):
        bounds = np.frombuffer(ends, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1
        if to > at:
            yield from _block_sets(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        else:
            to = at + 1
            yield shingles(texts[at].as_py())
        at = to


def _block_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that ``bounds`` cut ``data`` into, as ``word_hashes`` has them, and
    the place of each text's first word. A word's sum is the difference of two running sums, scaled to its start."""
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    opens[first], closes[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sizes = ends - starts
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED.take(data) * _UP[: len(data)], out=sums[1:])
    hashed = _mixed((sums[ends] - sums[starts]) * _DOWN[starts] + sizes.astype(np.uint64) * _ODD[2])
    for k in np.flatnonzero(sizes > len(_PLACES)):
        hashed[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return hashed, np.searchsorted(starts, bounds)


def _block_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    words, at = _block_words(data, bounds)
    counts = np.diff(at)
    hashed = _folded(words, width)
    # a run that begins in a text's last words reaches into the next text
    over = (at[1:][counts > 0][:, None] - np.arange(1, width)).ravel()
    whole = np.ones(len(words), bool)
    whole[over[over >= 0]] = False
    hashed = hashed[whole[: len(hashed)]]
    cuts = np.concatenate([[0], np.cumsum(np.maximum(counts - width + 1, 0))])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        hashed[a:b].sort()
    first = np.ones(len(hashed), bool)
    np.not_equal(hashed[1:], hashed[:-1], out=first[1:])
    first[cuts[:-1][cuts[:-1] < cuts[1:]]] = True
    cuts = np.concatenate([[0], np.cumsum(first)])[cuts].tolist()
    hashed = hashed[first]
    for k, n in enumerate(counts.tolist()):
        yield _folded(words[at[k] : at[k + 1]], n) if 0 < n < width else hashed[cuts[k] : cuts[k + 1]]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def digest(own: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def least_overlap(n: int) -> int:
    """Fewest shingles a set of ``n`` shares with any set it links with."""
    return -(-SHARE * n // 100)


def links(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared, len(a) + len(b) - shared


def _marked(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return common[at] == own


def prefix(own: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order (common, hash), and which of them are common."""
    size = len(own) - least_overlap(len(own)) + 1
    marked = _marked(own[: 2 * size], common)
    if len(marked) - np.count_nonzero(marked) < size:
        marked = _marked(own, common)
    else:  # the rest doesn't matter
        own = own[: 2 * size]
    rare = own[~marked][:size]
    more = own[marked][: size - len(rare)]
    return np.concatenate([rare, more]), np.arange(size) >= len(rare)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _over_texts(docs: DataFrame, each: Callable[[Iterable[tuple[int | None, np.ndarray]]], dict[str, np.ndarray]], schema: dict[str, pa.DataType]) -> DataFrame:
    """Run ``each`` over (id, shingle set) of every Arrow batch of (_doc, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_doc").to_pylist()
            out = each(zip(ids, shingle_sets(batch.column("_text"))))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in schema.items()], names=list(schema))

    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
    return docs.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in schema.items()))


def memberships(docs: DataFrame) -> DataFrame:
    """(doc, node, n) of every row of (_doc, _text); node is NULL for an empty set."""

    def each(rows):
        doc, node, n = [], [], []
        for d, own in rows:
            doc.append(d)
            node.append(digest(own) if len(own) else None)
            n.append(len(own))
        return {"doc": doc, "node": node, "n": n}

    return _over_texts(docs, each, {"doc": pa.int64(), "node": pa.int64(), "n": pa.int64()})


def _gathered(docs: DataFrame, each: Callable, kind: list[tuple[str, type]], close: Callable[[np.ndarray], np.ndarray], schema: str) -> DataFrame:
    """Run ``close`` over all the rows of a part together. ``each`` makes the parts and the rows, of numpy's
    type ``kind``, of an Arrow batch of texts; a batch's rows of one part are shuffled as one block of bytes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rows = each(zip(batch.column("_doc").to_pylist(), shingle_sets(batch.column("_text"))))
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(len(part), 1), bool), part[1:] != part[:-1]]))
            blocks = [x.tobytes() for x in np.split(rows, at[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(blocks, pa.binary())], names=["part", "rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            rows = close(np.frombuffer(b"".join(held), kind))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in names], names=names)

        held, last = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                if held and part != last:
                    yield closed()
                    held = []
                last = part
                held.append(block)
        if held:
            yield closed()

    blocks = docs.mapInArrow(deal, "part int, rows binary")
    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(gather, schema)


def _firsts(rows: np.ndarray, names: list[str]) -> np.ndarray:
    """Which of sorted rows differ from the row before."""
    first = np.zeros(len(rows), bool)
    first[:1] = True
    for c in names:
        first[1:] |= rows[c][1:] != rows[c][:-1]
    return first


def _part(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int32)


def _counted(docs: DataFrame, choose: Callable[[np.ndarray], np.ndarray], least: int) -> DataFrame:
    """(h, times) of the shingles that ``choose`` takes from each distinct set of a batch, where more than ``least``."""
    kind = [("h", np.int64), ("times", np.int64)]

    def each(rows):
        seen, parts = set(), [np.zeros(0, np.uint64)]
        for _, own in rows:
            if len(own) and (name := digest(own)) not in seen:
                seen.add(name)
                parts.append(choose(own))
        h, times = np.unique(np.concatenate(parts), return_counts=True)
        out = np.empty(len(h), kind)
        out["h"], out["times"] = _signed(h), times
        return _part(h), out

    def close(rows):
        rows = rows[np.argsort(rows["h"])]
        at = np.flatnonzero(_firsts(rows, ["h"]))
        out = rows[at]
        out["times"] = np.add.reduceat(rows["times"], at)
        return out[out["times"] > least]

    return _gathered(docs, each, kind, close, "h bigint, times bigint")


def common_shingles(docs: DataFrame, least: int = COMMON, most: int = MOST_COMMON) -> np.ndarray:
    """Sorted hashes that occur more than ``least`` times; ``least`` doubles while they are more than ``most``."""
    spark = docs.sparkSession
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def collect(counted: DataFrame, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, times) of what was collected before and of ``counted``, under one mark for both."""
        nonlocal least
        often = written(counted, "common")
        while np.count_nonzero(before[1] > least) + often.where(F.col("times") > least).count() > most:
            least *= 2
        rows = often.where(F.col("times") > least).select("h", "times").toArrow()
        h, times = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "times"))
        kept = before[1] > least
        return np.concatenate([before[0][kept], h.view(np.uint64)]), np.concatenate([before[1][kept], times])

    found = collect(_counted(docs, lambda own: own[own < LOW], least), none)
    shared = spark.sparkContext.broadcast(np.sort(found[0]))

    def beyond(own: np.ndarray) -> np.ndarray:
        low = own[own < LOW]
        rare = len(low) - np.count_nonzero(_marked(low, shared.value))
        enough = rare >= len(own) - least_overlap(len(own)) + 1
        return own[:0] if enough else own[own >= LOW]

    return np.sort(collect(_counted(docs, beyond, least), found)[0])


def block_of(n: Column) -> Column:
    """Sizes are cut into blocks that grow like the sizes that can link."""
    return F.floor(F.log(n.cast("double")) / F.lit(log(100 / SHARE))).cast("int")


def index_entries(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """The index lists that can yield a pair: (h, node, doc, n, pos, most), ``most`` being the largest
    partner that the entry's position allows. A node's entries are made once however many copies it has."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    # a common shingle's list is spread over all partitions, by node so that copies still meet
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = [("h", np.int64), ("node", np.int64), ("doc", np.int64), ("n", np.int32), ("pos", np.int32), ("most", np.int32), ("salt", np.int32)]

    def each(rows):
        seen: dict[int, int] = {}
        parts: list[tuple] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5, np.zeros(0, bool))]
        for d, own in rows:
            if not len(own) or d is None:
                continue
            name, n = digest(own), len(own)
            if seen.get(name, d + 1) <= d:
                continue
            seen[name] = d
            h, hot = prefix(own, shared.value)
            left = n - np.arange(len(h))
            most = np.minimum(n * 100 // SHARE, left * (100 + SHARE) // SHARE - n)
            use = most >= least_overlap(n)
            k = int(np.count_nonzero(use))
            parts.append((h[use], np.full(k, name), np.full(k, d), np.full(k, n), np.flatnonzero(use), most[use], hot[use]))
        h, node, doc, n, pos, most, hot = (np.concatenate(c) for c in zip(*parts))
        salt = np.where(hot, node % salts, -1)
        out = np.empty(len(h), kind)
        for c, values in zip(out.dtype.names, (_signed(h), node, doc, n, pos, most, salt)):
            out[c] = values
        return _part(np.where(hot, _mixed(h + (salt + 1).astype(np.uint64) * _ODD[0]), h)), out

    def close(rows):
        rows = rows[np.argsort(rows["h"])]
        first = _firsts(rows, ["h"])
        rows = rows[~(first & np.append(first[1:], True)) | (rows["salt"] >= 0)]
        # of a node's equal entries, the one of the least id
        own = ["h", "salt", "node", "n", "pos", "most"]
        rows = rows[np.lexsort([rows[c] for c in ["doc", *own[::-1]]])]
        rows = rows[_firsts(rows, own)]
        of = np.cumsum(_firsts(rows, ["h", "salt"])) - 1
        return rows[(np.bincount(of)[of] > 1) | (rows["salt"] >= 0)]

    rows = _gathered(docs, each, kind, close, "h bigint, node bigint, doc bigint, n int, pos int, most int")
    return rows.withColumn("block", block_of(F.col("n")))


def pivot_pairs(entries: DataFrame) -> DataFrame:
    """(a, a_doc, b, b_doc): each node with one pivot. A block's pivot is the set in which the block's shingle
    stands first: it has the fewest rare shingles of its own, so most of the block lies close to it.
    Of several pivots a node takes the one that most lists propose."""
    first = F.min(F.struct("pos", "doc", "node", "n", "most"))
    pivots = entries.groupBy("h", "block").agg(first.alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pivots = pivots.select(F.col("h").alias("_h"), F.col("block").alias("_block"), "p.doc", "p.node", "p.n", "p.most")
    pivots = pivots.withColumnsRenamed({"doc": "a_doc", "node": "a", "n": "a_n", "most": "a_most"})
    near = entries.join(pivots, (F.col("h") == F.col("_h")) & (F.col("block") == F.col("_block")))
    near = near.where((F.col("node") != F.col("a")) & (F.col("n") <= F.col("a_most")) & (F.col("a_n") <= F.col("most")))
    votes = near.groupBy(F.col("node").alias("b"), F.col("doc").alias("b_doc"), "a", "a_doc").agg(F.count(F.lit(1)).alias("votes"))
    return _favourite(votes)


def _favourite(votes: DataFrame) -> DataFrame:
    """For each b the a with the most votes, then the least id."""
    best = F.max(F.struct("votes", (-F.col("a_doc")).alias("least"), "a", "a_doc")).alias("best")
    return votes.groupBy("b", "b_doc").agg(best).select("best.a", "best.a_doc", "b", "b_doc")


def hub_pairs(pairs: DataFrame) -> DataFrame:
    """Of many pairs, one for each b: with the a that most pairs share."""
    hubs = pairs.groupBy(F.col("a").alias("_a")).agg(F.count(F.lit(1)).alias("votes"))
    return _favourite(pairs.join(hubs, F.col("a") == F.col("_a")))


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Intersection and union of each pair (a, a_doc, b, b_doc): (a, a_doc, b, b_doc, shared, total).

    A pivot's text meets those of its partners; a pivot with many is sent to several tasks, which
    share its partners.
    """
    sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("bigint").alias("_k"))
    cut = pairs.join(sizes, F.col("a") == F.col("_a")).select("a", "a_doc", "b", "b_doc", F.pmod("b", F.col("_k")).alias("salt"))
    heads = cut.select("a", "a_doc", F.col("a").alias("node"), F.col("a_doc").alias("doc"), "salt", F.lit(0).alias("role")).distinct()
    members = cut.select("a", "a_doc", F.col("b").alias("node"), F.col("b_doc").alias("doc"), "salt", F.lit(1).alias("role"))
    wanted = written(heads.unionByName(members), "wanted")
    if wanted.count() <= MOST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("_doc") == F.col("doc")).select("a", "a_doc", "salt", "role", "node", "doc", "_text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pivot, last = None, None, None
        names = ["a", "a_doc", "b", "b_doc", "shared", "total"]
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            columns = [batch.column(c).to_pylist() for c in ("a", "a_doc", "salt", "role", "node", "doc")]
            for a, a_doc, salt, role, node, doc, own in zip(*columns, shingle_sets(batch.column("_text"))):
                if (role, a, salt, node) == last:  # repeated rows of one document
                    continue
                if digest(own) != node:  # another row with the same id
                    continue
                last = (role, a, salt, node)
                if role == 0:
                    head, pivot = (a, salt), own
                elif head == (a, salt):
                    shared, total = links(pivot, own)
                    for column, value in zip(out, (a, a_doc, node, doc, shared, total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return rows.mapInArrow(run, "a bigint, a_doc bigint, b bigint, b_doc bigint, shared bigint, total bigint")


def _edges(compared: DataFrame) -> DataFrame:
    return compared.where(linked()).select(F.col("a_doc").alias("u"), F.col("b_doc").alias("v"))


def linked() -> Column:
    return F.col("shared") * 100 >= F.col("total") * SHARE


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of every end of an edge (u, v): the least id that can be reached.

    Alternates large and small stars: each round hangs neighbours on the least one they know, until
    every node hangs on its component's least. Rounds are written to the shared folder.
    """
    edges = written(edges.where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every edge now points from a larger id to a smaller one
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u")).select("u", F.col("v"), "m")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == state:
            break
        state = now
    rows = edges.groupBy("u").agg(F.min("v").alias("m"))
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("m"))
    return rows.unionByName(roots).groupBy(F.col("u").alias("doc")).agg(F.min("m").alias("component"))


def remaining_pairs(entries: DataFrame, known: DataFrame, compared: DataFrame) -> DataFrame:
    """All pairs that share a list, may link by size and position, lie in different components and are
    not settled by answers computed before."""
    rows = entries.join(_bounded(known.withColumnsRenamed({"doc": "_doc"})), F.col("doc") == F.col("_doc"), "left")
    rows = rows.select("h", "node", "doc", "n", "most", "block", F.coalesce("component", "doc").alias("component"))
    mixed = rows.groupBy(F.col("h").alias("_h")).agg(F.min("component").alias("x"), F.max("component").alias("y"))
    # lists and pairs are used several times below
    rows = written(rows.join(mixed.where("x < y").select("_h"), F.col("h") == F.col("_h"), "left_semi"), "lists")
    probe = rows.select(*[F.col(c).alias(f"x_{c}") for c in ("h", "node", "doc", "n", "most", "component", "block")])
    last = block_of(F.greatest(F.col("x_most"), F.col("x_n")))
    probe = probe.where("x_most >= x_n").withColumn("x_block", F.explode(F.sequence("x_block", last)))
    met = probe.join(rows, (F.col("x_h") == F.col("h")) & (F.col("x_block") == F.col("block"))
        & (F.col("n") >= F.col("x_n")) & (F.col("n") <= F.col("x_most")) & (F.col("x_n") <= F.col("most"))
        & ((F.col("n") > F.col("x_n")) | (F.col("doc") > F.col("x_doc")))
        & (F.col("component") != F.col("x_component")))
    pairs = met.select(F.col("x_node").alias("a"), F.col("x_doc").alias("a_doc"), F.col("node").alias("b"), F.col("doc").alias("b_doc"))
    pairs = written(pairs.distinct(), "pairs")
    # compared before
    done = compared.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"))
    pairs = pairs.join(done, (F.least("a", "b") == F.col("_x")) & (F.greatest("a", "b") == F.col("_y")), "left_anti")
    # told apart by their distances to one pivot; a hair over the threshold, so that rounding settles nothing
    far = 1 - F.col("shared") / F.col("total")
    of_a = compared.select(F.col("b").alias("_xb"), F.col("a").alias("_xa"), far.alias("_xd"))
    of_b = compared.select(F.col("b").alias("_yb"), F.col("a").alias("_ya"), far.alias("_yd"))
    apart = F.abs(F.col("_xd") - F.col("_yd")) > 1 - SHARE / 100 + 1e-9
    told = pairs.join(of_a, F.col("a") == F.col("_xb")).join(of_b, (F.col("b") == F.col("_yb")) & (F.col("_xa") == F.col("_ya")))
    told = told.where(apart).select(F.col("a").alias("_ta"), F.col("b").alias("_tb"))
    return pairs.join(told, (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, component) of every row: size of its set and the least id of its component."""
    source = docs.select(F.col(id_column).cast("bigint").alias("_doc"), F.col(text).cast("string").alias("_text"))
    members = written(memberships(source), "members")
    entries = written(index_entries(source, common_shingles(source)), "entries")
    compared = written(compare(source, pivot_pairs(entries)), "compared")
    known = written(components(_edges(compared)), "components")
    nodes = members.count()
    while not (rest := written(remaining_pairs(entries, known, compared), "remaining")).isEmpty():
        # many pairs left: compare with the hubs first, which settles most; few, or nothing gained: compare them all
        whole = rest.count() <= FEW * nodes
        more = written(compare(source, rest if whole else hub_pairs(rest)), "compared")
        gained = written(_edges(more), "links")
        if gained.isEmpty() and not whole:
            whole, more = True, written(compare(source, rest), "compared")
            gained = written(_edges(more), "links")
        stars = known.select(F.col("doc").alias("u"), F.col("component").alias("v"))
        known = written(components(stars.unionByName(gained)), "components")
        if whole:
            break
        compared = compared.unionByName(more)
    # of a node, the least id stands for all
    classes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"))
    classes = classes.join(known, F.col("least") == F.col("doc"), "left")
    classes = classes.select(F.col("node").alias("_node"), F.coalesce("component", "least").alias("component"))
    rows = members.join(classes, F.col("node") == F.col("_node"), "left")
    return rows.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def keep_representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of least id, with all its columns.

    Rows of one id are one document and repeated rows of it stay once; rows with a NULL id all stay.
    """
    found = similar_documents(docs, id_column, text).where("doc IS NOT NULL")
    gone = written(found.where("component <> doc").select(F.col("doc").alias("_gone")).distinct(), "gone")
    twice = written(found.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("_twice")), "repeated")
    key = F.col(id_column).cast("bigint")
    rows = docs.join(_bounded(gone), key == F.col("_gone"), "left_anti")
    if twice.isEmpty():
        return rows
    repeated = rows.join(_bounded(twice), key == F.col("_twice"), "left_semi").dropDuplicates([id_column, text])
    return rows.join(_bounded(twice), key == F.col("_twice"), "left_anti").unionByName(repeated)


def _bounded(ids: DataFrame) -> DataFrame:
    """Ids marked for broadcast while they are few; a shuffle join takes more."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 3), lambda k: array_to_string(w[k + 1 : k + 4], ' ')) END) AS s
  FROM texts
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
