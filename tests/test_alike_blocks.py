"""What blocks write, and terms by their hashes."""

import random

from grainmill.operators import retrieval as R
from tests.test_alike import expected


def test_sets_are_written_once_whatever_the_number_of_blocks(spark, monkeypatch):
    """What tiles read isn't shuffled for them: more blocks don't write more."""
    r = random.Random(5)
    texts = spark.createDataFrame([(i, " ".join(r.sample([f"w{j}" for j in range(3000)], 40))) for i in range(400)], "doc_id long, text string")

    def written(weight):
        monkeypatch.setattr(R, "BLOCK_WEIGHT", weight)
        store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
        total = lambda: sum(store().apply(i).totalShuffleWrite() for i in range(store().size()))
        before = total()
        R.alike(texts).collect()
        return total() - before

    assert written(2000) < 1.5 * written(1 << 23)


def test_terms_of_one_hash_get_another_seed(spark, monkeypatch):
    """Hashes are used only under a seed that tells all terms apart."""
    own = R._hash
    monkeypatch.setattr(R, "_hash", lambda term, seed: own(term, seed) if seed else own(term, seed) * 0 + 7)
    texts = [(1, "red green blue"), (2, "cat dog bird"), (3, "red green blue sky")]
    assert {x.doc_id: x.other for x in R.alike(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == expected(texts)
