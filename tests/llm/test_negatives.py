import math

import numpy as np
import pytest

from rubrica.llm import negatives
from rubrica.llm.queries import QUERIES


def plain_mine(rows):
    own = {}
    for key, label, vec in rows:
        if key is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        value = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vec])
        own[key] = min(own.get(key, value), value)
    out = []
    for a, (label, vec) in own.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(vec, v)), key, lab) for key, (lab, v) in own.items() if key != a and len(v) == len(vec)]
        for ps, p, _ in sorted(s for s in scores if s[2] == label)[:5]:
            hits = sorted(s for s in scores if s[2] != label and -30 * ps <= -100 * s[0] <= -90 * ps)[:10]
            out += [(a, p, rank + 1, n, -ps, -s) for rank, (s, n, _) in enumerate(hits)]
    return sorted(out)


def vectors(n=700, d=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(k, int(rng.integers(0, 5)), (centres[k % 5] * 0.3 + rng.normal(size=d) * 0.2).round(1).tolist()) for k in range(n)]
    return rows


AWKWARD = [
    (None, 1, [0.1] * 6),
    (10000, None, [0.1] * 6),
    (10001, 1, None),
    (10100, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]),
    (10200, 1, [0.1, float("nan"), 0.1, 0.1, 0.1, 0.1]),
    (10300, 1, [0.1, float("inf"), 0.1, 0.1, 0.1, 0.1]),
    (10400, 2, [0.0] * 6),
    (10500, 2, []),
    (10501, 2, []),
    (10502, 3, []),
    (10600, 2, [0.5, 0.25]),
    (10601, 2, [0.5, 0.25]),
    (10602, 4, [0.25, 0.25]),
    (10600, 2, [0.5, 0.25]),
    (10602, 3, [0.25, 0.125]),
    (-100, 1, [0.3] * 6),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id bigint, label int, embedding array<double>, score double").repartition(3)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_matches_plain(spark, tables):
    rows = [*vectors(), *AWKWARD, *[(20000 + k, k % 3, [0.2, 0.1, 0.2, 0.1, 0.2, 0.1]) for k in range(150)]]  # many copies
    got = QUERIES["op11_hard_negatives"](spark, tables(embeddings=frame(spark, rows)))
    assert rows_of(got) == plain_mine(rows)


def test_blocks_and_parts_change_nothing(spark):
    rows = vectors(400)
    own = negatives.integer_vectors(frame(spark, [(k, (lab + 1) % 10 if k % 7 == 0 else lab, v) for k, lab, v in rows]))
    got = negatives.mine(own, own.where("id % 100 = 0"), block=17, anchor_bytes=500)
    assert rows_of(got) == plain_mine(rows)


def test_empty(spark):
    own = negatives.integer_vectors(frame(spark, vectors(5)).limit(0))
    assert negatives.mine(own, own).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    vecs = rng.integers(-100, 100, (5000, 2))
    lists = negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), vecs)
    for anchor in (np.array([3, -70]), np.array([0, 5]), np.array([90, 90])):
        scores = vecs @ anchor
        top, middle = negatives.Window(10), negatives.Window(10, 0, int(scores.max()) // 2)
        assert negatives.fill(lists, anchor, [top]) < 1500
        want = np.lexsort((np.arange(5000), -scores))
        assert top.ids.tolist() == want[:10].tolist()
        negatives.fill(lists, anchor, [middle])
        inside = [k for k in want if 0 <= scores[k] <= scores.max() // 2]
        assert middle.ids.tolist() == inside[:10]


def test_large_components():
    big = np.array([[1 << 40, 1], [1, 1 << 40]])
    lists = negatives.Lists(np.arange(2), np.zeros(2, np.int64), big)
    with pytest.raises(ValueError):
        negatives._check(lists, [(0, 0, big[0])])
    wide = np.array([[1 << 28, 3], [5, 1 << 28]])  # beyond what doubles hold exactly
    lists = negatives.Lists(np.arange(2), np.zeros(2, np.int64), wide)
    window = negatives.Window(2)
    negatives.fill(lists, wide[0], [window])
    assert window.scores.tolist() == [(1 << 56) + 9, (5 << 28) + (3 << 28)]
