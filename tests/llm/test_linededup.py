import hashlib

from plain import ascii_lower

from rubrica.llm import linededup
from rubrica.llm.queries import QUERIES

BLANKS = " \t\n\x0b\f\r"
LAST = 1 << 63


def plain_dedup(rows, least=10):
    """(doc, text) to (doc, n_lines, n_dropped, kept text)."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(BLANKS))
            if len(key) >= least:
                holders.setdefault(key, set()).add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = LAST if doc is None else doc
        gone = [len(holders.get(ascii_lower(x.strip(BLANKS)), ())) > 1 and min(holders[ascii_lower(x.strip(BLANKS))]) != own for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


HOT = "the same navigation line everywhere"
ROWS = [
    (1, f"alpha beta gamma\n{HOT}\n{HOT}\nshort"),
    (2, f"  ALPHA beta gamma \t\n\n{HOT}\nshort"),
    (2, f"  ALPHA beta gamma \t\n\n{HOT}\nshort"),
    (2, f"another text of the same document\n{HOT}\nGröße ÄÖÜ größe"),
    (3, None),
    (4, ""),
    (5, "\n\n"),
    (6, f"{HOT}\n{HOT}"),
    (7, "größe ÄÖÜ größe\nGRÖßE ÄÖÜ GRÖßE\ngrößE ÄÖÜ größe\n" + "long " * 3000),
    (None, f"only without id here\n{HOT}"),
    (None, "only without id here\nanother text of the same document"),
    (-8, "negative ids come first\nanother text of the same document\r"),
    *[(k, f"{HOT}\nown line of number {k}\ncopied text of many lines\nand its second line") for k in range(100, 140)],
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id bigint, text string, doc int, row string").repartition(5)


def key(row):
    return (row[0] is None, row[0] or 0, row[3] or "", row[1])


def test_matches_plain(spark):
    kept = linededup.drop_repeated_lines(table(spark))
    assert kept.columns == ["doc_id", "text", "doc", "row", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in kept.collect()]
    assert sorted(got, key=key) == sorted(plain_dedup(ROWS), key=key)


def test_batches_and_compaction_change_nothing(spark, tmp_path):
    want = sorted(plain_dedup(ROWS), key=key)
    for batches, fan_in in ((1, 2), (6, 2), (5, 3)):
        runs = linededup.LineRuns(spark, str(tmp_path / f"{batches}-{fan_in}"), buckets=3, fan_in=fan_in)
        kept = linededup.drop_repeated_lines(table(spark), batches=batches, runs=runs)
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in kept.collect()], key=key) == want
        levels = [level for level, _ in runs.runs]
        assert levels == sorted(levels, reverse=True) and all(levels.count(k) < fan_in for k in levels)


def test_runs_are_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    lines = lambda rows: linededup.line_hashes(table(spark, rows))
    first = linededup.LineRuns(spark, path, buckets=2)
    assert first.add(lines([(1, "a line to remember"), (2, "another line to keep")])).count() == 0
    again = linededup.LineRuns(spark, path, buckets=7)
    assert (again.buckets, again.runs) == (2, first.runs)
    contested = again.add(lines([(3, "A line to remember "), (4, "quite new to all of them"), (5, "quite new to all of them")]))
    assert sorted(r.owner for r in contested.collect()) == [1, 4]
    third = linededup.LineRuns(spark, path)
    assert third.add(lines([(9, "quite new to all of them")])).first().owner == 4


def test_runs_join_without_a_shuffle_of_theirs(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), buckets=4)
    lines = linededup.line_hashes(table(spark))
    runs.add(lines)
    own = lines.groupBy("h1", "h2").agg({"doc": "min"})
    plan = own.join(runs._read(runs.runs[0][1]).hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_awkward(spark, awkward, nothing, tables):
    kept = linededup.drop_repeated_lines(awkward)
    assert kept.count() == awkward.count()
    assert kept.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert linededup.drop_repeated_lines(nothing).count() == 0
    got = QUERIES["op13_line_dedup"](spark, tables(documents=table(spark)))
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain_dedup(ROWS)]
    assert sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=key) == sorted(want, key=key)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
