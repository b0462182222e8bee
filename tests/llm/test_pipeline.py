import corpus_pipeline
from test_jaccard import brute as brute_components
from test_native import brute_quality
from test_text_scans import brute as brute_hits, plain as plain_secrets
from test_tokens import check_packed
from tokenizers import Tokenizer

from rubrica.llm import secrets, tokens
from rubrica.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    before = docs.collect()

    kept = written(stages[names[0]](spark, docs, SF), "q")
    rows = kept.collect()
    failed = {r.doc_id for r in before if (q := brute_quality(r.text))[0] < 10 or 100 * q[4] > 20 * q[0]}
    assert not failed & {r.doc_id for r in rows}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality == 1} - failed
    assert good <= {r.doc_id for r in rows}

    single = written(stages[names[1]](spark, kept, SF), "j")
    want = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in rows]).items() if d == c}
    rows = single.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)

    clean = written(stages[names[2]](spark, single, SF), "c")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([r.text for r in rows], items, 10)
    want = {r.doc_id for r, h in zip(rows, hits) if not h[1]}
    rows = clean.collect()
    assert {r.doc_id for r in rows} == want

    masked = written(stages[names[3]](spark, clean, SF), "s")
    texts = {r.doc_id: r.text for r in rows}
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not plain_secrets(r.text)
        if not secrets.Scanner().scan([texts[r.doc_id]])[0]:
            assert r.text == texts[r.doc_id]
    assert kept.columns == single.columns == clean.columns == masked.columns == columns

    packed = stages[names[4]](spark, masked, SF).collect()
    check_packed(packed, {r.doc_id: r.text for r in masked.collect()}, Tokenizer.from_file(tokens.default_vocabulary()))


def test_empty_and_awkward_tables(spark, awkward, nothing, tables):
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    folder = tables(documents=nothing, benchmark=bench)
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
    assert docs.count() > 0
