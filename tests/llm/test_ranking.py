import math
import re
from collections import Counter

from plain import ascii_lower

from rubrica.llm import ranking
from rubrica.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    vectors = [(d, Counter(WORD.findall(ascii_lower(t)))) for d, t in docs]
    vectors = [(d, c) for d, c in vectors if c]
    count, total = len(vectors), sum(sum(c.values()) for _, c in vectors)
    held = Counter(t for _, c in vectors for t in c)
    out = []
    for item, text in items:
        asked = WORD.findall(ascii_lower(text))
        found = []
        for d, c in vectors:
            m = 100 - 75 + (75 * sum(c.values()) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k])]
    return out


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(n=300):
    vocabulary = ["the", "of", "and", "Größe", "日本", *(f"w{k}" for k in range(60))]
    texts = []
    for d in range(n):
        words = [vocabulary[(d * d * 7 + j * (d % 11 + 1) * 13 + j * j) % (5 + d % 60)] for j in range(1 + d % 37)]
        texts.append((d, " ".join(words) + ("." if d % 3 else "-The_END")))
    # copies, ties, NULLs, nothing but separators, a repeated row, a long text
    return [*texts, *[(1000 - d, "copied w3 w17 w40 and the end") for d in range(80)], (2000, None), (2001, ""), (2002, "-- _ !"), (5, texts[5][1]), (None, "w3 w17"), (3000, "w9 the " * 40000)]


ITEMS = [(1, "the W3 w17 w3"), (2, "and of THE größe 日本 w59 unknown"), (3, None), (4, ""), (5, "nowhere to be found"), (6, "w3 w17"), (6, "w3 w17"), (None, "w40-w41 w9"), (7, "copied")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n int").repartition(3)
    return d, spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc string")


def test_matches_plain(spark, tables):
    docs, items = corpus(), ITEMS
    d, i = frames(spark, docs, items)
    want = sorted(plain_search(docs, items), key=repr)
    got = QUERIES["op12_ranked_search"](spark, tables(documents=d, benchmark=i))
    assert rows_of(got) == want


def test_parts_and_small_tries_change_nothing(spark):
    docs, items = corpus(120), ITEMS
    d, i = frames(spark, docs, items)
    want = sorted(plain_search(docs, items, 3), key=repr)
    assert rows_of(ranking.search(d, i, k=3, item_bytes=150, entries=50)) == want


def test_empty(spark, nothing):
    d, i = frames(spark, corpus(10), ITEMS)
    assert ranking.search(nothing, i).count() == 0
    assert ranking.search(d, i.limit(0)).count() == 0
    assert ranking.search(nothing, i.limit(0)).count() == 0


def test_branches_are_left(monkeypatch):
    """Most documents of a corpus with a few good ones are never scored."""
    import numpy as np

    held = np.array([2000, 30])
    items = ranking.Items([{1: 1}], held, 2000, 20000)
    scored = []
    real = ranking.Items.scores
    monkeypatch.setattr(ranking.Items, "scores", lambda self, p, t, m: scored.append(1) or real(self, p, t, m))
    docs = [(d, 100, np.array([0]), np.array([1 + d % 5])) for d in range(1970)]
    docs += [(5000 + d, 100, np.array([0, 1]), np.array([1, 1 + d])) for d in range(30)]
    best = ranking.Best(1, 10)
    ranking.Trie(docs).search(items, best)
    assert [d for _, d in best.rows[0]] == [5029 - k for k in range(10)]
    assert len(scored) < 100


def test_terms_in_pieces(monkeypatch):
    text = "Ab-c ä1_x " * 50
    whole = [t for piece in ranking.terms(text.encode()) for t in piece]
    monkeypatch.setattr(ranking, "PIECE", 7)
    assert [t for piece in ranking.terms(text.encode()) for t in piece] == whole == [t.encode() for t in WORD.findall(ascii_lower(text))]
