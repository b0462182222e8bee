"""Queries over written files on rows of their own."""

import pytest

from rubrica.plans import file_queries


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_array_files_hold_every_element_between_their_brackets(spark, tmp_path, broadcast):
    ids = [0, 0, 1, 7, 49_999, 50_000, 50_000, 100_000, None]
    docs = [(k, None if n == 3 else f"text {n}", "en") for n, k in enumerate(ids)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = [tuple(r) for r in file_queries.json_array_blocks(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = [(k, t and t + file_queries._NOISE, lang) for k, t, lang in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
