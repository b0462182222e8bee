import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import ascii_lower
from pyspark.sql import functions as F

from rubrica.llm import jaccard


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def shingle_set(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[k : k + 4]) for k in range(len(w) - 3)])


def brute(rows):
    """component per id, of all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, n, edits, length):
    """Copies of one text, each with up to ``edits`` words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [None, "", " \n", "One", "one", "ONE two", "one\ttwo"]
    for _ in range(6):
        texts += family(rng, rng.randint(2, 12), rng.choice([1, 3, 6, 9]), rng.choice([30, 90, 200]))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 9, 14, 40]))) for _ in range(30)]
    # a chain: each like the next, the ends unlike
    chain = [f"c{k}" for k in range(160)]
    texts += [" ".join(chain[k : k + 120]) for k in range(0, 40, 4)]
    rng.shuffle(texts)
    return texts + texts[:5]


@pytest.mark.parametrize("seed, common", [(1, 8), (2, 1), (3, 8), (4, 10**6)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, common):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    found = jaccard.common_shingles
    monkeypatch.setattr(jaccard, "common_shingles", lambda docs: found(docs, common))
    rows = list(enumerate(corpus(seed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc: (r.n, r.component) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute(rows)


def test_blocks_of_texts_hash_like_single_texts(monkeypatch):
    """Texts of a batch are hashed together, long ones alone; words and shingles never cross texts."""
    single, alone = jaccard.shingles, []
    monkeypatch.setattr(jaccard, "BLOCK", 4096)
    monkeypatch.setattr(jaccard, "shingles", lambda text: alone.append(text) or single(text))
    rng = random.Random(3)
    bits = ["a", "B", "é", "Ä", "\u3000", "\xa0", " ", " ", "\n", "\x0b", "\t", "\x1c", "one ", "TWO\x0c", "four\r", "x" * 1025 + " ", "y" * 1024, "😀"]
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(rng.randint(0, 25))]
        texts += rng.choice([[], ["long word " * 1000, "one", None]])
        for kind in (pa.string(), pa.large_string()):
            got = list(jaccard.shingle_sets(pa.array([*texts[:1], *texts], kind)[len(texts[:1]) :]))
            assert [g.tolist() for g in got] == [single(t).tolist() for t in texts]
    assert alone and all(len(t.encode()) > 4096 for t in alone)


def test_remaining_pairs_read_the_lists_once(spark, monkeypatch):
    """The joins that settle pairs start from the few lists and pairs left, not from all entries anew."""
    rng = random.Random(8)
    texts = [t for _ in range(6) for t in family(rng, 9, 9, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_doc bigint, _text string").repartition(4)
    entries = jaccard.written(jaccard.index_entries(docs, jaccard.common_shingles(docs)), "entries")
    compared = jaccard.written(jaccard.compare(docs, jaccard.pivot_pairs(entries)), "compared")
    known = jaccard.written(jaccard.components(jaccard._edges(compared)), "components")
    plans, real = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, label: plans.append(df) or real(df, label))
    plans.append(jaccard.remaining_pairs(entries, known, compared))
    scans = [p._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for p in plans]
    assert len(scans) == 3 and all(0 < n <= 6 for n in scans)


def test_marks_double_until_few_shingles_are_common(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h") for k in range(20)], "_doc bigint, _text string").repartition(20)
    assert len(jaccard.common_shingles(docs, least=1, most=2)) == 0
    assert len(jaccard.common_shingles(docs, least=1)) == 5


def test_both_collections_keep_one_mark(spark, monkeypatch):
    """Whatever the hashes, no more than ``most`` are held in all, and those are the most frequent."""
    rows = [(k, " ".join(f"w{j}" for j in range(4 + k % 7))) for k in range(70)]
    docs = spark.createDataFrame(rows, "_doc bigint, _text string").repartition(70)
    times = Counter(int(h) for _, text in rows for h in jaccard.shingles(text))
    for low in (0, 1 << 61, 1 << 62, 1 << 63, (1 << 64) - 1):
        monkeypatch.setattr(jaccard, "LOW", low)
        mark = 1
        while sum(n > mark for n in times.values()) > 4:
            mark *= 2
        got = jaccard.common_shingles(docs, least=1, most=4)
        assert set(got.tolist()) <= {h for h, n in times.items() if n > mark} and len(got) <= 4


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        common = np.sort(rng.choice(a, len(a) // 2, replace=False))
        if not len(b):
            continue
        shared, total = jaccard.links(a, b)
        if 100 * shared >= 85 * total:
            x, y = jaccard.prefix(a, common)[0], jaccard.prefix(b, common)[0]
            met = np.intersect1d(x, y)
            assert len(met)
            first = min(met, key=lambda h: (h in common, h))
            for own, other, p in ((a, b, x), (b, a, y)):
                left = len(own) - int(np.flatnonzero(p == first)[0])
                assert len(other) <= min(len(own) * 100 // 85, left * 185 // 85 - len(own))


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 300), (300, 400), (7, 7)]
    got = {r.doc: r.component for r in jaccard.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 300: 300, 400: 300, 500: 300}


def test_awkward_rows(spark, awkward, nothing):
    rows = jaccard.similar_documents(awkward).collect()
    assert len(rows) == awkward.count()
    assert [r.component for r in rows if r.doc == 3] == [3, 3]
    kept = jaccard.keep_representatives(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({**{k: 1 for k in range(1, 11)}, None: 1})
    assert jaccard.similar_documents(nothing).count() == 0
    assert jaccard.keep_representatives(nothing).count() == 0


def test_pairs_do_not_grow_with_the_square_of_a_group(spark):
    rng = random.Random(6)
    rows = list(enumerate(family(rng, 300, 2, 150)))
    docs = spark.createDataFrame(rows, "_doc bigint, _text string").repartition(8)
    entries = jaccard.written(jaccard.index_entries(docs, jaccard.common_shingles(docs)), "entries")
    pairs = jaccard.pivot_pairs(entries)
    assert pairs.count() < 300
    compared = jaccard.written(jaccard.compare(docs, pairs), "compared")
    edges = compared.where(jaccard.linked()).select(F.col("a_doc").alias("u"), F.col("b_doc").alias("v"))
    rest = jaccard.remaining_pairs(entries, jaccard.components(edges), compared)
    assert rest.count() < 3000
