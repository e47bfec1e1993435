"""Arrays of objects over many tasks against a whole parse."""

import json
import random

import pytest

from grainmill.sources import json_parts


@pytest.fixture
def small_splits(spark):
    """Files of some KB are cut into many splits, whose ranges stay apart."""
    for k, v in (("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.openCostInBytes", "1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled"):
        spark.conf.unset(k)


def test_like_a_whole_parse(spark, tmp_path, small_splits):
    r = random.Random(1)
    odd = ["}", "{", '"', "\\", "\\\\\"}", "é", "], [", "\n", "x" * 30, "{}"]
    def value(depth):
        return "".join(r.choices(odd, k=r.randint(0, 6))) if depth == 0 or r.random() < 0.6 else {"k" + "".join(r.choices(odd, k=2)): value(depth - 1), "l": [value(depth - 1)]}
    for n, indent in (("a", None), ("b", 2), ("c", None)):
        items = [{"text": value(0), "more": value(3)} for _ in range(60)]
        (tmp_path / f"{n}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=n == "c"))
    (tmp_path / "d.json").write_text('{"text": "not a list"}')
    (tmp_path / "e.json").write_text(' [{"text": "one"}, 5, "a } b", {"text": "cut')
    (tmp_path / "f.json").write_text("")
    (tmp_path / "g.json").write_text("[]")
    parts = json_parts.json_array_objects(spark, str(tmp_path))
    got = {}
    for x in sorted(parts.collect()):
        got.setdefault(x.path.rpartition("/")[2], []).append(json.loads(x.text))
    want = {f"{n}.json": json.loads((tmp_path / f"{n}.json").read_text()) for n in "abc"} | {"e.json": [{"text": "one"}]}
    assert got == want
    texts = [x.text for x in json_parts.json_arrays(spark, str(tmp_path / "a.json")).collect()]
    assert sorted(texts) == sorted(t for x in want["a.json"] if (t := x["text"].strip(" ")))
