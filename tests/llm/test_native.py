"""URL filter, licence scan and quality rules."""

import dataclasses
import random
import re
from collections import Counter

import pytest
from check import compare, connect
from plain import ascii_lower

from rubrica.llm import licenses, quality, queries, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_twin(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert ok, note


def test_no_python_in_native_plans(spark):
    for name in ("op2_url_filter", "op3_license_scan", "op9_quality_rules"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.com/de/", "x://example.com/de", "ftp://org/fr/1",
        "http://b.org?q=/fr/", "http://u@h.co.uk:80/7.html", "http://1.2.3.4/5/", "a://b://c/d", "http://x.net", "http://x.net/de/9"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "v", 1.0) for k, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, verdict string, _host double")
    labels = spark.createDataFrame([(7, 0, 0), (7, 0, 1), (9, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    rows = pages.select("page_id", "url")
    got = {r.page_id: r for r in urls.judge(rows, urls.labelled_outcomes(rows, labels)).collect()}
    assert len(got) == len(URLS) * 2
    for k, u in enumerate(URLS * 2):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = ascii_lower(host)
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[k]._host, got[k]._path) == (host, path)
        assert got[k]._rule == (best[1] + best[2] if best else None)
        if best:
            assert got[k]._verdict == best[0]
    assert got[9]._n == 4  # two labels of document 7, on two rows
    kept = urls.filter_pages(pages, urls.labelled_outcomes(pages, labels))
    assert kept.columns == pages.columns and 0 < kept.count() < pages.count()
    none = pages.limit(0)
    assert urls.filter_pages(none, urls.labelled_outcomes(none, labels)).count() == 0


def test_bad_hosts_are_blocked_with_evidence_only(spark):
    rows = [("bad.example.com", 0)] * 40 + [("few.example.com", 0)] * 1 + [(f"h{k}.example.com", 1) for k in range(60) for _ in range(5)]
    found = {r.host: r for r in urls.host_reputations(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert found["bad.example.com"].high < urls.MIN_GOOD < found["few.example.com"].high


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        for k in range(len(words) - len(own) + 1):
            if words[k : k + len(own)] == own:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences(spark, awkward, nothing):
    rng = random.Random(2)
    parts = ["mit", "MIT", "license", "License", "apache", "general", "public", "the", "-", ". ", "é", "mit license", "general public license"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [r.text for r in awkward.collect()]
    texts += [f"Some words. {notice.title()}! More words." for _, notice, _ in licenses.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = licenses.build_index(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, index, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(t), t
        assert 0 <= r.score <= 1
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[len(texts) - len(licenses.TEMPLATES) + k].labels.split(",")
    assert licenses.scan(nothing, licenses.build_index(nothing), ["doc_id"]).count() == 0
    assert licenses.scan(awkward, index, ["doc_id"]).count() == awkward.count()


def test_every_file_with_all_key_phrases_has_the_licence(spark):
    """Whatever else of the notice a file lacks, and wherever its rarer words stand."""
    rng = random.Random(3)
    words = sorted({w for _, notice, _ in licenses.TEMPLATES for w in notice.split()})
    texts = ["Redistribution and use in source and binary forms"]
    for _, notice, phrases in licenses.TEMPLATES:
        assert all(p in notice for p in phrases)
        for _ in range(4):
            parts = [*phrases, *rng.sample(words, rng.randint(0, len(words)))]
            rng.shuffle(parts)
            texts.append("\n".join(parts))
    for corpus in (texts[:1], texts):
        docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
        for r in licenses.scan(docs, licenses.build_index(docs), ["doc_id"]).collect():
            padded = f" {' '.join(ascii_lower(corpus[r.doc_id]).split())} "
            want = {label for label, _, phrases in licenses.TEMPLATES if all(f" {p} " in padded for p in phrases)}
            assert {label for label in r.labels.split(",")} - set(r.base_labels.split(",")) == want
            assert 0 < r.score <= 1


def brute_candidates(text, index, lookups):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    looked_up = {*[w for w in index.ranked if w in words][:lookups], *index.keys}
    votes = Counter((t, place - k) for place, w in enumerate(words) if w in looked_up for t, k in index.postings.get(w, []))
    return {(index.templates[t][0], at) for (t, at), n in votes.items() if n >= licenses.AGREE}


@pytest.mark.parametrize("lookups", [0, 3, licenses.LOOKUPS])
def test_licence_candidates_come_from_the_postings(spark, lookups):
    rng = random.Random(9)
    texts = [None, "", "cc"]
    for _ in range(60):
        words = [w for _, notice, _ in rng.sample(licenses.TEMPLATES, 2) for w in notice.split()]
        cut = rng.randint(0, len(words))
        texts.append(" ".join([*words[cut:], "x", *rng.sample(words, min(9, len(words))), *words[:cut]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = licenses.build_index(docs)
    rows = [(r.doc_id, r.label, r["at"]) for r in licenses.candidates(docs, index, ["doc_id"], lookups=lookups).collect()]
    assert sorted(rows) == sorted((k, *c) for k, t in enumerate(texts) for c in brute_candidates(t or "", index, lookups))
    assert len(rows) > 60


def test_no_licence_without_postings_or_in_another_place(spark):
    """Labels come through the index alone, and a phrase counts where a candidate puts it."""
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(notices)), "doc_id bigint, text string")
    index = licenses.build_index(docs)
    bare = dataclasses.replace(index, postings={})
    assert all(r.labels == r.base_labels for r in licenses.scan(docs, bare, ["doc_id"]).collect())
    moved = dataclasses.replace(index, postings={w: [(t, k + 1 + i % 2) for i, (t, k) in enumerate(p)] for w, p in index.postings.items()})
    assert all(r.labels == r.base_labels for r in licenses.scan(docs, moved, ["doc_id"]).collect())
    with pytest.raises(ValueError):
        licenses.build_index(docs, [("x", "some words", ["words"])])


def test_licence_score_is_the_share_of_the_whole_notice(spark):
    _, notice, (phrase,) = next(t for t in licenses.TEMPLATES if t[0] == "bsd")
    docs = spark.createDataFrame([(1, f"x {notice} y"), (2, f"{notice.split()[-1]} {phrase}")], "doc_id bigint, text string")
    index = licenses.build_index(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, index, ["doc_id"]).collect()}
    places = dict(index.templates)["bsd"]
    assert [w for w, _, _ in places] == notice.split()
    assert got[1].score == 1
    assert got[2].score == pytest.approx(sum(x for _, _, x in places[: len(phrase.split())]), abs=1e-6)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {p for k, w in enumerate(windows) if times[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, awkward, nothing):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "\n", "#", "A\t", "é "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    docs = docs.unionByName(awkward.select("doc_id", "text", "lang", "source").where("doc_id is not null").withColumn("doc_id", awkward.doc_id + 1000))
    for r in quality.judged_documents(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        want = brute_quality(r.text)
        assert tuple(r[c] for c in quality.BASE) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    kept = quality.filter_documents(awkward)
    assert kept.columns == awkward.columns
    assert quality.filter_documents(nothing).count() == 0


def test_each_measure_rejects_what_the_fixed_rules_keep(spark):
    rng = random.Random(6)

    def prose(n):
        return [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n)]

    odd = {
        "word_length": " ".join("y" * (20 + k) for k in range(40)),
        "symbol_share": " ".join(f"{w}#*" for w in prose(100)),
        "upper_share": " ".join(prose(100)).upper(),
        "dup_line_share": "\n--\n".join(" ".join(prose(9)) for _ in range(12)),
    }
    again = prose(9)
    odd["repeat_share"] = " ".join([*again, *prose(38), *again, *prose(38)])
    texts = [" ".join(prose(100)) for _ in range(400)] + list(odd.values())
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality.judged_documents(docs).collect()}
    assert all(rows[k].kept for k in range(400))
    for k, name in enumerate(odd, 400):
        assert not rows[k].base_failed and rows[k].failed == name and not rows[k].kept
    assert {r.text for r in quality.filter_documents(docs).collect()} == set(texts[:400])


def test_small_cells_lean_on_their_language(spark):
    """Thresholds move little by little with the rows of a cell, not at one row."""
    rows = [("en", "big", "word_length", 5000, 10_000), ("en", "small", "word_length", 9000, 0)]
    highs = []
    for n in (1, 199, 200, 201, 20_000):
        cells = [(*r[:4], r[4] or n) for r in rows]
        df = spark.createDataFrame(cells, "lang string, source string, measure string, bucket bigint, n bigint")
        found = {r.source: r.high_word_length for r in quality.thresholds(df).collect()}
        assert abs(found["big"] - 8000) < 100
        highs.append(found["small"])
    assert highs == sorted(highs) and highs[3] - highs[1] < 30
    assert highs[0] < 8100 and highs[2] == pytest.approx(10_000, abs=60) and highs[4] > 11_900


def test_sketches_merge_and_stay_close(spark):
    rng = random.Random(4)
    values = [int(rng.lognormvariate(7, 1)) for _ in range(5000)]
    rows = [(v, "en" if k % 2 else "de") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v bigint, lang string").select(quality.bucket(quality.F.col("v")).alias("bucket"), "lang")
    cells = df.groupBy("lang", "bucket").agg(quality.F.count("*").alias("n")).withColumn("measure", quality.F.lit("m"))
    row = quality.quartiles(quality.merge(cells, []), []).first()
    ordered = sorted(values)
    for got, share in ((row.q1, 0.25), (row.q2, 0.5), (row.q3, 0.75)):
        exact = ordered[int(share * len(ordered)) - 1]
        assert abs(got - exact) <= exact / 32 + 1
