"""Secret scan and benchmark decontamination."""

import random
import re
import time
from types import SimpleNamespace

import pytest
from plain import ascii_lower

from rubrica.llm import decontaminate, secrets

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["PassWord", "passwd", "api_key", "apikey", "Token", "ſecret", "toKen", "=", ": ", "'", '"', "abcdef012345", "AKIA", "ABCDEFGH12345678", "deadbeef", " ", "\n", "é", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    found = secrets.Scanner().scan(texts)
    for text, spans in zip(texts, found):
        assert [s for s in spans if s[1] < 3] == plain(text), text


@pytest.mark.parametrize(
    "pattern, query",
    [
        ("abc", b"abc"),
        ("abcd", ("and", (b"abc", b"bcd"))),
        ("ab[cd]", ("or", (b"abc", b"abd"))),
        ("(?:abc|x)y", None),
        ("abc|xyz", ("or", (b"abc", b"xyz"))),
        ("ab?c.*xyz", b"xyz"),
        ("[0-9]+", None),
        ("(?:abc)+", b"abc"),
        ("(?:abc)*", None),
    ],
)
def test_trigram_queries(pattern, query):
    assert secrets.trigram_query(pattern) == query


def test_every_match_satisfies_its_query():
    samples = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890ab", "AIza" + "x" * 35, "sk_live_" + "9" * 20,
               "https://user:secretpw@host/x", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12]
    found = secrets.Scanner().scan(samples)
    assert all(any(number >= 3 for _, number, _ in spans) for spans in found)


def test_web_tokens_equal_the_plain_pattern():
    rng = random.Random(8)
    plain_token = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    parts = ["eyJ", "eyJ", ".", ".", "abcdefghij", "k-_", "0123456789", " ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 40))) for _ in range(30000)]
    number = next(k for k, r in enumerate(secrets.RULES) if r.kind == "web_token")
    some = 0
    for text, spans in zip(texts, secrets.Scanner().scan(texts)):
        want = [m.span() for m in plain_token.finditer(text)]
        assert [(a, b) for a, k, b in spans if k == number] == want, text
        some += len(want)
    assert some > 100


LONG = ["eyJ", "eyJaaaaaaaaaa.", "eyJ.eyJ", "://a:", "://", "password ", "token=", "api_key", "AKIA", "ghp_", "xoxb-", "AIza", "sk_live_", "deadbeef ",
        "-----BEGIN ", "-----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\\n \t", "A ", "MIICabcd\n", " ", "-", '"\\n'] + [f"-----BEGIN PRIVATE KEY----- {c}" for c in "a-\n"]


@pytest.mark.parametrize("part", LONG)
def test_every_rule_takes_linear_time(part):
    """A quadratic rule takes minutes on these."""
    tail = " ghp_ xoxb- AIza sk_live_ ://a:b@c AKIA .eyJ eyJa -----BEGIN PRIVATE KEY----- password"
    scanner = secrets.Scanner()
    for start in ("", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "password", "://"):
        begin = time.process_time()
        scanner.scan([start + part * (500_000 // len(part)) + tail])
        assert time.process_time() - begin < 5


KEY = ["MIIEowIBAAKCAQEAx" + "Zz0+/" * 9, "Qk" * 32, "+a/b" * 16, "c2hvcnQ="]


@pytest.mark.parametrize("kind", ["", "RSA ", "ENCRYPTED ", "OPENSSH ", "PGP "])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\\n", "\\r\\n", "\n> ", "\n    ", "\n# ", '\\n" +\n  "'])
@pytest.mark.parametrize("headers", [[], ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00", ""]])
@pytest.mark.parametrize("end", [True, False])
def test_a_private_key_is_masked_whole(kind, line, headers, end):
    name = f"{kind}PRIVATE KEY{' BLOCK' if kind == 'PGP ' else ''}"
    key = line.join([f"-----BEGIN {name}-----", *headers, *KEY, *([f"-----END {name}-----"] if end else [])])
    text = f'see "{key}"\nSome more words, and a -----BEGIN CERTIFICATE-----\nMIIC\n-----END CERTIFICATE-----'
    (spans,) = secrets.Scanner().scan([text])
    assert secrets._masked(text, spans, secrets.RULES) == text.replace(key, "[PRIVATE_KEY]")


def test_private_keys_side_by_side_and_cut_short():
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    flat = f"{begin} {' '.join(KEY[:3])}"
    texts = {
        f"{begin}\n{KEY[0]}\n{end}\n{begin}\n{KEY[1]}\n{end}\nwords": "[PRIVATE_KEY]\n[PRIVATE_KEY]\nwords",
        f"{begin}\n{KEY[0]}\n{begin}\n{KEY[1]}": "[PRIVATE_KEY]\n[PRIVATE_KEY]",
        f"{begin}\n{KEY[0]}\n\nThanks\n": "[PRIVATE_KEY]\n\nThanks\n",
        f"{flat} {end} x": "[PRIVATE_KEY] x",
        flat: "[PRIVATE_KEY]",
        f"a {begin} line starts a key": "a [PRIVATE_KEY] line starts a key",
        begin + "\n" + f"{KEY[1]}\n" * 50000 + end: "[PRIVATE_KEY]",
    }
    for text, spans in zip(texts, secrets.Scanner().scan(list(texts))):
        assert secrets._masked(text, spans, secrets.RULES) == texts[text]


@pytest.mark.parametrize("login", [":longenough", "user:" + "p" * 200, "u" * 100 + ":password"])
def test_url_passwords_of_any_length(login):
    text = f"redis://{login}@host/0"
    (spans,) = secrets.Scanner().scan([text])
    assert [(text[a:b], secrets.RULES[k].kind) for a, k, b in spans] == [(f"://{login}@h", "url_password")]


def test_secrets_on_awkward_rows(spark, awkward, nothing, tables):
    rows = secrets.op10_secret_scan(spark, tables(documents=awkward)).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in plain(texts[r.doc_id])) for k in range(3)]
    masked = secrets.mask_documents(awkward)
    assert masked.columns == awkward.columns
    assert masked.where("doc_id = 6").first().text == "[ASSIGN]' [ACCESS] [HEX]"
    assert masked.where("doc_id = 1").first().text is None
    assert secrets.find_secrets(nothing, ["doc_id"]).count() == 0


def brute(texts, items, width):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))

    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_decontamination(spark, max_bytes):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("A b c, d É".split()) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", " . "]
    items = [(k, " ".join(rng.choice("a B c d é".split()) for _ in range(rng.randint(0, 8)))) for k in range(30)] + [(30, None), (30, "a b"), (31, "b")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(texts, items, 4)
    got = {r.doc_id: r for r in decontaminate.scan(docs, bench, ["doc_id"], width=4, max_bytes=max_bytes).collect()}
    for k, w in enumerate(want):
        assert (got[k].n_words, got[k].n_hit, list(got[k]["items"])) == w
        for span in got[k].spans:
            assert texts[k][span.start : span.end].strip()
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, width=4, max_bytes=max_bytes).collect()}
    assert clean == {k for k, w in enumerate(want) if not w[1]}
    cut = decontaminate.cut_contaminated(docs, bench, width=4, max_bytes=max_bytes)
    assert cut.columns == docs.columns and cut.count() == len(texts)


def test_automaton_belongs_to_its_broadcast():
    def shared(number, value):
        value.append((f"w{number}", [str(number)]))
        return SimpleNamespace(value=value)

    first = shared(0, [])
    address = id(first.value)
    assert decontaminate._matcher(first).scan("a w0 b")[2] == ["0"]
    assert decontaminate._matcher(first) is decontaminate._matcher(first)
    held = []
    del first
    # of lists made after the first is dropped, the one at its address, if any
    while len(held) < 1000 and (not held or id(held[-1]) != address):
        held.append([])
    assert decontaminate._matcher(shared(1, held[-1])).scan("a w0 w1 b")[2] == ["1"]


def test_decontamination_on_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the cat sat"), (2, "no such text")], "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.scan(awkward, bench, ["doc_id"]).collect()}
    assert found[3].n_hit == 10 and found[1].n_words == 0
    empty = bench.limit(0)
    assert decontaminate.scan(awkward, empty, ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.scan(nothing, bench, ["doc_id"]).count() == 0
    assert decontaminate.drop_contaminated(awkward, bench).columns == awkward.columns


@pytest.mark.parametrize("max_bytes", [700, 32 << 20])
def test_parts_change_no_row(spark, max_bytes):
    """Repeated ids with other texts, repeated rows, items without an id, passages of items that overlap."""
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words[:20])), (2, " ".join(words[15:35])), (None, "x1 x2 x3 x4 x5"), (1, "short item"), (3, None), (3, ""), (4, "  --  ")]
    docs = [(1, "A " + " ".join(words) + " z"), (1, "nothing here"), (1, "A " + " ".join(words) + " z"), (2, "x1, X2 x3 x4 x5 x6; short ITEM."), (None, "short item"), (3, None)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id int, text string, `_text` string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.scan(d, bench, ["doc_id"], max_bytes=max_bytes).collect()), key=repr)
    long = (1, 42, 35, ["1", "2"], [(2, 2 + len(" ".join(words[:35])))])
    want = [long, long, (1, 2, 0, [], []), (2, 8, 7, ["1"], [(0, 15), (20, 30)]), (None, 2, 2, ["1"], [(0, 10)]), (3, 0, 0, [], [])]
    assert got == sorted(want, key=repr)
    cut = decontaminate.cut_contaminated(d, bench, max_bytes=max_bytes)
    rest = "A  " + " ".join(words[35:]) + " z"
    assert cut.columns == d.columns and sorted([r.text for r in cut.collect()], key=repr) == sorted([rest, rest, "nothing here", " x6; .", "", None], key=repr)
    clean = decontaminate.drop_contaminated(d, bench, max_bytes=max_bytes)
    assert sorted([r.text for r in clean.collect()], key=repr) == sorted(["nothing here", None], key=repr)


def test_windows_need_no_python(spark):
    plan = decontaminate.benchmark_windows(spark.createDataFrame([(1, "a b c")], "item_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
