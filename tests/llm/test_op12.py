"""op12: the query against its SQL, archives read back, the merge against a sort, edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grainmill.llm import op12_warc as op
from tests.oracle import duck, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
LONG = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" + "é" * 600


def plain(pages, least=1000):
    rows, best = [], {}
    for i, _, html in pages:
        body = (html or "").encode()
        d = hashlib.sha1(body).hexdigest()
        rows.append((i, len(body), d))
        if len(body) >= least:
            best[d] = max(best.get(d, (False, 0)), (i is not None, i or 0))
    out = []
    for i, n, d in rows:
        first = best.get(d, (i is not None, i or 0))
        again = first != (i is not None, i or 0)
        out.append((i, n, d, "revisit" if again else "response", first[1] if again else None))
    return sorted(out, key=repr)


def archived(spark, pages, folder, crawl=op.Crawl()):
    op.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), str(folder), crawl)
    return op.read_archives(spark, str(folder)).cache()


def digest_rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_oracle(spark):
    rows = op.op12_warc(spark, SF)
    assert rows_of_spark(rows) == rows_of_duck(duck(SF), op.ORACLES["op12_warc"])
    order = [(r.url_key, r.captured, r.page_id) for r in rows.collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_copies(spark, tmp_path, monkeypatch, broadcast):
    """A third of all pages has one payload; pairs, short copies and ids without a number besides."""
    monkeypatch.setattr(op, "BROADCAST_ROWS", broadcast)
    pages = [(i, f"http://a.b/{i % 7}", LONG) for i in range(100)] + [(200 + i, "http://c/", "x" * (998 + i // 2)) for i in range(10)]
    pages += [(400 + i, "http://d.e", f"{i // 2} " * 600) for i in range(160)] + [(None, None, None), (None, "u", LONG), (500, "v", ""), (501, "v\r\nX: 1", "")]
    pages += [(None, "w", "only without id " * 90)] * 2
    index = archived(spark, pages, tmp_path / "w", op.Crawl(archive_bytes=20_000))
    assert digest_rows(index) == plain(pages) and index.select("archive").distinct().count() > 5
    assert digest_rows(op.histories(index, op.Crawl(range_rows=20))) == plain(pages)


def test_records_can_be_read_by_place(spark, tmp_path):
    pages = [(i, f"https://www.X.org:443/p?q={i}#f", f"page {i}" + LONG * (i % 2)) for i in range(30)]
    for r in archived(spark, pages, tmp_path / "w").collect():
        data = (tmp_path / "w" / r.archive).read_bytes()[r["at"] : r["at"] + r.length]
        ((fields, start, end, payload),) = op.parsed(data)
        assert (start, end) == (0, r.length) and fields[b"warc-record-id"] == b"<urn:page:%d>" % r.page_id and r.url_key == f"org,x)/p?q={r.page_id}"
        assert payload is None if r.record_type == "revisit" else bytes(payload).decode() == pages[r.page_id][2]


def test_order_over_many_ranges(spark, tmp_path):
    """One URL has most of the captures and times repeat; ranges follow one another."""
    r = random.Random(2)
    pages = [(i, "http://hot.org/" if i % 3 else f"http://{r.choice('abc')}.org/{r.randint(0, 9)}", "x") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    op.write_archives(df, str(tmp_path / "w"), captured=F.timestamp_seconds(F.lit(10) + F.col("page_id") % 50))
    got = op.histories(op.read_archives(spark, str(tmp_path / "w")).cache(), op.Crawl(range_rows=40))
    assert got.rdd.getNumPartitions() == 15
    order = [(x.url_key, x.captured, x.page_id) for x in got.collect()]
    assert order == sorted(order) and len(order) == 600


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted((r.randint(0, 40), i, j) for j in range(r.choice([0, 1, 9]))) for i in range(k)]
        assert list(op.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("pages", [[], [(None, None, None)], [(1, "u", None), (1, "u", None), (2**62, "http://é/ ü", LONG * 500), (-5, "", LONG * 500), (-5, "", LONG * 500)]])
def test_cases(spark, tmp_path, pages):
    index = archived(spark, pages, tmp_path / "w")
    assert digest_rows(op.histories(index)) == plain(pages)


def test_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "h", 2, 3, 4, 5)], "page_id long, url string, html string, of int, captured int, value int, payload_digest int")
    op.write_archives(df, str(tmp_path / "w"))
    assert digest_rows(op.read_archives(spark, str(tmp_path / "w"))) == plain([(1, "u", "h")])


def test_damage_is_found():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 37\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" % hashlib.sha1(b"x").hexdigest().encode()
    data = data.replace(b"Content-Length: 37", b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"))
    assert op._run_of("a", data).num_rows == 1
    for bad in (data.replace(b"\r\n\r\nx", b"\r\n\r\ny"), data[:-3], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            op._run_of("a", bad)
