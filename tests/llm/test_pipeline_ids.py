"""The pipeline's jaccard stage on rows that share a doc_id or have none."""

import corpus_pipeline as cp

A, B, C = ("one two three four five six seven", "red green blue black white pink grey", "un deux trois quatre cinq six sept")


def test_rows_that_share_a_doc_id(spark):
    rows = [(1, A), (1, B), (1, A), (2, B), (3, C), (None, A), (None, C), (None, "alpha beta gamma delta epsilon"), (None, ""), (None, None), (4, " "), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.jaccard(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, (r.text or "")) for r in got)) == sorted([(1, A), (1, B), (3, C), (0, "alpha beta gamma delta epsilon"), (0, ""), (4, " "), (4, "")])


def test_a_shared_doc_id_keeps_no_near_copy(spark):
    long = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, long), (5, long + " end"), (5, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in cp.jaccard(spark, docs, "").collect()) == [(1, long), (5, B)]


def test_nothing_but_the_result_is_left(spark):
    import os

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs}
    before = files()
    rows = cp.run(spark, "/root/testdata/sf0.001").count()
    assert rows
    left = {f.removeprefix(folder).split("/")[1] + "/" + f.removeprefix(folder).split("/")[2] for f in files() - before}
    assert len(left) == 1 and left.pop().endswith("/tokens")
