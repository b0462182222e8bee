import random
import re

from rubrica.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", ".", "_", "1", "22", "255", "300", " ", "-", "+1", "(5)", "555-0100", "4111111111111111", "%", "\n", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_address_parts_of_any_length():
    zeros = "0" * 5000
    for text, found in ((f"{zeros}1.0.{zeros}.255", True), (f"1.0.0.{zeros}256", False), (f"1.0.0.1{zeros}", False)):
        assert pii.base_spans(text) == ([(0, 1, len(text))] if found else [])


def test_linear_on_long_runs():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1.2." * 50_000):
        pii.base_spans(text)


def fitted():
    texts = [
        f"word other +1 (9{k % 10}8) 555-2{k:03d} more words v{k}.0 and {k} items, mail u{k}.x@mail.example.com, 10.0.0.{k}"
        for k in range(200)
    ]
    counts = pii.Counter()
    for t in texts:
        pii._counts_of(t, counts)
    return pii.fit_factors({k: float(n) for k, n in counts.items()})


def test_repeats_take_the_label_of_the_first():
    text = "Call +1 (988) 555-2485 now. Later dial (988) 555-2485 or 555-2485. There are 7 items in v3.0 of it."
    base, added = pii.Labeller(fitted()).spans([text])[0]
    assert [text[s:e] for s, _, e in base] == ["+1 (988) 555-2485"]
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added] == [("phone", "(988) 555-2485"), ("phone", "555-2485")]


def test_skip_messages_change_beliefs():
    factors = fitted()
    shape = pii.shape_of("u7.x", 0)
    lone = pii.Node(0, 4, 50, shape, "@u7.x", 0)
    email = pii.Node(0, 9, 0, pii.shape_of("u7.x@m.org", 0), "@u7.x", 1)
    runs = factors.runs()
    alone = pii.beliefs([[lone]], factors, runs)[0]
    paired = pii.beliefs([[email, lone]], factors, runs)[1]
    assert paired[1] > 2 * alone[1]


def test_runs_of_plain_words_are_summed_out_exactly():
    factors = fitted()
    runs = factors.runs()
    import numpy as np

    step, over = np.exp(factors.chain), np.exp(factors.plain)
    want = step @ np.diag(over) @ step @ np.diag(over) @ step
    got = np.exp(runs[2])
    assert np.allclose(got / got.max(), want / want.max())


def test_awkward_rows(spark, awkward, nothing, tables):
    folder = tables(documents=awkward)
    rows = pii.op1_personal_data(spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        spans = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
    masked = pii.mask_documents(awkward, pii.train(awkward))
    assert masked.columns == awkward.columns
    assert "[EMAIL]" in masked.where("doc_id = 5").first().text
    assert pii.find_personal_data(nothing, pii.train(nothing), ["doc_id"]).count() == 0


def test_long_tokens_are_read_whole():
    start = "col,1," * 60
    texts = [f"{start}a", f"{start}b", f"{start}5551234567", f"{start}c@d.org", f"{start}a"]
    nodes = pii.nodes_of(" ".join(texts), [])
    keys = [n.key for n in nodes]
    assert len(set(keys)) == 4 and keys[0] == keys[4]
    assert pii.skip_edges(nodes) == [(0, 4)]
    assert nodes[3].shape != nodes[0].shape
    assert pii.nodes_of("x" * 300 + "7", [])[0].shape == pii.shape_of("x" * 300 + "7", 0)
