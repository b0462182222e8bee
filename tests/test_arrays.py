"""JSON arrays read in blocks against the reader that takes a file whole."""

import gzip
import json
import random

import pytest

from rubrica.sources import arrays, datasets

SCHEMA = "a bigint, t string, n array<struct<x: string>>"
BITS = ["{", "}", "[", "]", '"', "\\", '\\"', "a", "日志", "\n", ",", ":", "{}", "}]", " ", " "]


def objects(seed, count):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 60))) for _ in range(count)]
    return [{"a": k, "t": t, "n": [{"x": "}{"}] * rng.randint(0, 2)} for k, t in enumerate(texts)]


@pytest.fixture
def small_splits(spark):
    """Scans cut files into splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(((r.a, r.t, [x.x for x in r.n or []]) for r in df.collect()), key=repr)


def test_blocks_equal_the_whole_read(small_splits, tmp_path):
    spark, objs = small_splits, objects(1, 300)
    forms = {
        "compact": json.dumps(objs, separators=(",", ":"), ensure_ascii=False),
        "pretty": json.dumps(objs, indent=2),
        "single": json.dumps(objs[7]),
        "empty": "[]",
        "blank": " [ \n ] ",
        "mark": "﻿" + json.dumps(objs[:9]),
        "long": json.dumps([{"a": 1, "t": "}\\\"{" * 4000, "n": []}, *objs[:5]]),  # an element over many blocks
    }
    for name, text in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf8")
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 1 or len(text) < 700
        got = rows(arrays.read_arrays(spark, str(path), SCHEMA))
        whole = json.loads(text.removeprefix("﻿"))
        whole = whole if isinstance(whole, list) else [whole]
        assert got == sorted(((o["a"], o["t"], [x["x"] for x in o["n"]]) for o in whole), key=repr), name
        if name not in ("mark", "empty", "blank"):
            assert got == rows(datasets.read_json(spark, str(path), SCHEMA, split=False))
    with gzip.open(tmp_path / "packed.json.gz", "wt", encoding="utf8") as file:
        file.write(forms["pretty"])
    assert arrays.read_arrays(spark, str(tmp_path / "packed.json.gz"), SCHEMA).count() == 300
    both = arrays.read_arrays(spark, str(tmp_path / "[cp]*.json"), SCHEMA)  # several files at once
    assert both.count() == 600


def test_schema_is_inferred(small_splits, tmp_path):
    objs = objects(2, 50)
    (tmp_path / "x.json").write_text(json.dumps(objs))
    got = datasets.read_json(small_splits, str(tmp_path / "x.json"))  # longer than a split, so read in blocks
    assert got.schema == datasets.read_json(small_splits, str(tmp_path / "x.json"), split=False).schema
    assert rows(got) == sorted(((o["a"], o["t"], [x["x"] for x in o["n"]]) for o in objs), key=repr)


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, {"t": "open}', '[{"a": 1}, 5]', "[7]"])
def test_broken_files_raise(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        arrays.read_arrays(spark, str(tmp_path / "x.json"), SCHEMA).collect()


def test_quotes_behind_backslashes():
    import numpy as np

    for text in ('"a"', r'\"', r'\\"', r'\\\"x"', r'"\\\\"\"', '""'):
        data = np.frombuffer(text.encode(), np.uint8)
        want, escaped = [], False
        for k, c in enumerate(text):
            if c == '"' and not escaped:
                want.append(k)
            escaped = c == "\\" and not escaped
        assert arrays._quotes(data).tolist() == want
