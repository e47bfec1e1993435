"""The pipeline's stages one after the other against brute force."""

import struct

import corpus_pipeline as cp
from grainmill.llm import op4_mix, op8_toxicity
from tests.llm.test_op1 import TRUE
from tests.llm.test_op2 import brute as near
from tests.llm.test_op9 import brute as private

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    start = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = {r.doc_id for r in kept["toxicity"]}
    assert sum(1 for d, t in labels.items() if not t and d in own) >= 0.97 * sum(1 for t in labels.values() if not t)
    assert sum(1 for d, t in labels.items() if t and d not in own) >= 0.6 * sum(labels.values())
    assert {r.doc_id for r in kept["jaccard"]} == {d for d, _, c, _ in near([(r.doc_id, r.text) for r in kept["toxicity"]]) if d == c}
    assert len(kept["jaccard"]) == len(kept["pii"]) == len({r.doc_id for r in kept["pii"]})
    for r in kept["pii"]:
        assert r.n_chars == len(r.text) and not private(r.text)
        assert private(start[r.doc_id].text) or r.text == start[r.doc_id].text or "[" in r.text
    size = lambda r: len(r.text.split())
    assert abs(sum(map(size, kept["mix"])) - 1.5 * sum(map(size, kept["pii"]))) <= sum(sorted(map(size, kept["pii"]))[-20:])
    texts = {r.doc_id: r.text for r in kept["pii"]}
    assert all(texts[r.doc_id] == r.text for r in kept["mix"])
    for r in kept["tokens"]:
        ids = TRUE.encode_ordinary(texts[r.doc_id])
        assert r.exact and r.n_tokens == len(ids) and bytes(r.ids_le) == struct.pack(f"<{len(ids)}I", *ids)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (2, "", "en", "s", 0, 7), (3, "a b c d e f", "en", None, 11, 7), (4, "A b c d e f", "en", "s", 11, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p_toxic int")
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out if name in ("toxicity", "jaccard", "pii") else docs
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3]
    assert op4_mix.mixed(docs).count() and op8_toxicity.THRESHOLD < 1
