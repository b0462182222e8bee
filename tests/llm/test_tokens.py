"""Word encoding, packing and token files."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rubrica.llm import packing, tokenfiles, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "The", "don't", "it's.", "word.", "e\u0301", "É", "ſ", "İ", "Σας", "12", "3.4", "...", "a.", "b!?", ".", ",", "'s", "<|endoftext|>", "<|EndOfText|>", "日本語。", "\U0001f600",
             " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "\u2003", "\u0301", "x\u0301.", "-", "--", "ß.", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_cached_words_equal_the_tokenizer(tokenizer):
    words = tokens.WordEncoder(tokens.default_vocabulary(), cache_words=200)
    texts = random_texts(1, 4000)
    for text, ids in zip(texts, words.encode_all(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_letters_equal_the_tokenizer(tokenizer):
    rng = random.Random(9)
    letters = "etaoinshrdlu" * 3 + "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))) + "ÀÉİſΣ'"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", "?!"]) for _ in range(200)) for _ in range(20)]
    words = tokens.WordEncoder(tokens.default_vocabulary())
    for text, ids in zip(texts, words.encode_all(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_ids(tokenizer):
    words = tokens.WordEncoder(tokens.default_vocabulary())
    texts = random_texts(2, 500)
    counts = np.zeros(tokenizer.get_vocab_size(), np.int64)
    words.count_all(texts, counts)
    want = np.bincount([i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids], minlength=len(counts))
    assert (counts == want).all()


def test_long_texts_are_cut_at_blanks(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 50)
    texts = ["short", "some longer words, and more of them. " * 30, "x" * 300, "end"]
    for text, ids in zip(texts, tokens.WordEncoder(tokens.default_vocabulary()).encode_all(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def pieces(*lengths):
    return [packing.Piece(k, np.arange(n, dtype=np.uint32), 0, n) for k, n in enumerate(lengths)]


def test_windows_are_full_and_nothing_is_lost():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.choice([1, 3, 5, 8, 13, 40, 100]) for _ in range(rng.randint(0, 30))]
        windows, left = packing.pack_pieces(pieces(*lengths), (8, 16, 32))
        assert sum(p.length for p in left) < 32
        windows += packing.tail_windows(left)
        seen = defaultdict(list)
        for size, window in windows:
            assert sum(p.length for p in window) == size and size & (size - 1) == 0
            for p in window:
                seen[p.doc] += range(p.start, p.start + p.length)
        assert {k: list(range(n)) for k, n in enumerate(lengths)} == {k: sorted(v) for k, v in seen.items()}


def test_step_groups_share_the_cost():
    windows = [(64, pieces(*[8] * 8)) for _ in range(8)] + [(64, pieces(64)) for _ in range(8)]
    groups = packing.step_groups(windows, 4 * 64)
    cost = defaultdict(int)
    for (_, window), g in zip(windows, groups):
        cost[g] += sum(p.length**2 for p in window)
    assert len(cost) == 4 and len(set(cost.values())) == 1


def check_packed(rows, texts, tokenizer):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for k, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing_on_awkward_rows(spark, awkward, nothing, tokenizer):
    docs = awkward.dropDuplicates(["doc_id"])
    rows = packing.pack(docs).collect()
    check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(nothing).count() == 0
    twice = packing.pack(awkward.where("doc_id = 3"), with_ids=False).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_bytes_round_trip():
    rng = np.random.default_rng(4)
    edges = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    for n in (0, 1, 2, 3, 4, 5, 7, 1000):
        values = np.concatenate([edges, rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 300, n, dtype=np.uint32)])[: n + 9]
        control, data = tokenfiles.encode(values)
        assert (tokenfiles.decode(control, data, len(values)) == values).all()


def test_token_files(spark, awkward, nothing, tokenizer, tmp_path):
    encoded = tokenfiles.encoded(awkward)
    by_rank = tokenfiles.ranked_ids(encoded)
    manifest = tokenfiles.write_files(encoded, f"file://{tmp_path}/t", by_rank, file_ids=50)
    rows = tokenfiles.read_files(manifest, f"file://{tmp_path}/t", by_rank).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert manifest.count() >= 3 and [r.doc_id for r in rows] == [d for d, _ in docs]
    at = 0
    for r, (_, text) in zip(rows, docs):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    frequent = np.bincount([i for _, t in docs for i in tokenizer.encode(t, add_special_tokens=False).ids])
    assert by_rank[0] == frequent.argmax()
    empty = tokenfiles.encoded(nothing)
    none = tokenfiles.write_files(empty, f"file://{tmp_path}/n", tokenfiles.ranked_ids(empty))
    assert tokenfiles.read_files(none, f"file://{tmp_path}/n", by_rank).count() == 0
