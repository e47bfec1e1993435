"""WARC archives of pages, and their captures in one global order.

Pages become WARC records: of payloads that occur more than once, and are long enough, the one with the
largest page_id is a response and the others revisit it. Records are joined columns; Spark's text sink
writes them, each closed by the blank lines that WARC asks for, so that its committer and any store
that Spark knows will do. Archives are read back whole, one at a time, by the lengths that their
records state; digests of payloads are computed again and compared.

Each archive gives one run of captures, sorted by URL key and time. Runs are cut at common bounds,
ranges of about ``range_rows`` captures over all runs; a task merges the segments that fall into its
range with a loser tree, which costs one comparison a level for every capture. Ranges follow
one another, so the index as a whole is in order, and a URL with very many captures has several ranges.

Decisions are made on digests, without payloads. The responses of repeated payloads are broadcast where
they are few (``BROADCAST_ROWS``); beyond that they are joined by digest, and only digests with more than
two tasks' share of all copies, fewer than half as many as tasks, are broadcast.

Defined results: null html is an empty payload; a null url is an empty one; null page_ids come before
others, so they revisit if a copy has an id; rows that repeat the response's page_id and payload are
responses too; an empty table gives an empty index; pages without a time of capture are given one that
follows from page_id; blanks and line ends in a URL are percent-encoded; other columns aren't archived.
A record that is cut off, or whose payload doesn't match its digest, raises an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.checkpoints import checkpoint_dir, cut, delete
from grainmill.shipping import ship
from grainmill.tables import table


@dataclass(frozen=True)
class Crawl:
    """Payloads of ``least`` bytes are told apart; archives have about ``archive_bytes``, ranges ``range_rows`` captures."""

    least: int = 1000
    archive_bytes: int = 32 << 20
    range_rows: int = 50_000
    start: int = 1_704_067_200  # 2024-01-01 in seconds


#: Responses of repeated payloads, of some 200 bytes each, that are broadcast at most.
BROADCAST_ROWS = 50_000
_END = "\r\n"
_FIELDS = {
    "url_key": "string", "captured": "string", "page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string",
    "refers_to": "long", "archive": "string", "at": "long", "length": "long", "pos": "int",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_SCHEMA = ", ".join(f"{k} {t}" for k, t in _FIELDS.items())


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, _FIELDS.values(), strict=True)], names=list(_FIELDS))


def derived_time(crawl: Crawl = Crawl()) -> Column:
    """A time of capture for pages that have none: ``page_id`` seconds, modulo 10**9, after the start."""
    return F.timestamp_seconds(F.lit(crawl.start) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))


def captures(pages: DataFrame, crawl: Crawl = Crawl(), captured: Column | None = None) -> DataFrame:
    """(page_id, url, captured, html, payload_bytes, payload_digest), without nulls but in page_id."""
    at = F.to_utc_timestamp(derived_time(crawl) if captured is None else captured, F.current_timezone())
    url = F.coalesce("url", F.lit(""))
    for c, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(c), F.lit(code))
    rows = pages.select("page_id", url.alias("url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})


def decided(rows: DataFrame, slim: DataFrame, crawl: Crawl) -> DataFrame:
    """``rows`` with ``of``: the response that a revisit refers to, or null. ``slim`` has their columns but for html."""
    spark = rows.sparkSession
    first = F.max(F.struct("page_id", "url", "captured")).alias("of")
    repeated = cut(slim.filter(F.col("payload_bytes") >= crawl.least).groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1"))
    n, total = repeated.agg(F.count("*"), F.sum("n")).first()
    often = F.col("n") > (0 if n <= BROADCAST_ROWS else 2 * total / int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(repeated.filter(often).drop("n"))
    if n <= BROADCAST_ROWS:
        out = rows.join(hot, "payload_digest", "left")
    else:
        rest = rows.join(hot.select("payload_digest"), "payload_digest", "left_anti").join(repeated.filter(~often).drop("n"), "payload_digest", "left")
        out = rows.join(hot, "payload_digest").unionByName(rest)
    return out.withColumn("of", F.when(F.col("of").isNotNull() & ~F.col("of.page_id").eqNullSafe(F.col("page_id")), F.col("of")))


def record(of: Column) -> Column:
    """A WARC record but for the blank lines at its end; a revisit's has the head of its response and no payload."""
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(_END))
    again = of.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(_END))
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(of["page_id"])),
        line("WARC-Refers-To-Target-URI", of["url"]), line("WARC-Refers-To-Date", of["captured"]),
    )
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.col("captured")), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, revisit).otherwise(F.lit("")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")),
        F.lit(_END), http, F.when(again, F.lit("")).otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, folder: str, crawl: Crawl = Crawl(), captured: Column | None = None) -> None:
    """Writes the pages (page_id, url, html) as archives below ``folder``, each by one task, in the pages' order."""
    rows = captures(pages, crawl, captured)
    slim = cut(rows.drop("html"))
    n, size = slim.agg(F.count("*"), F.coalesce(F.sum(F.col("payload_bytes") + 600), F.lit(0))).first()
    most = max(1, crawl.archive_bytes * max(n, 1) // max(size, 1))
    records = decided(rows, slim, crawl).select(record(F.col("of")).alias("value"))
    records.write.option("lineSep", _END * 2).option("maxRecordsPerFile", most).text(folder)


_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)")


def url_key(url: str) -> str:
    """The host's labels from last to first, then path and query; without scheme, ``www``, usual ports and fragment."""
    host, path = _URL.match(url).groups()
    host = re.sub(r"^www\.|:(80|443)$", "", host.rpartition("@")[2].lower())
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def parsed(data: bytes) -> Iterator[tuple[dict[bytes, bytes], int, int, memoryview | None]]:
    """(fields, start, end, payload) of every record; a revisit has no payload."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(head, at)].split(b"\r\n")
        if head < 0 or not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        body = head + 4
        end = body + int(fields[b"content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        http = data.find(b"\r\n\r\n", body, end) + 4
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[body:http])
        fields[b"payload"] = length[1] if length else b"%d" % (end - http)
        yield fields, at, end + 4, None if fields[b"warc-type"] == b"revisit" else view[http:end]
        at = end + 4


def _number(name: bytes | None) -> int | None:
    digits = (name or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def _run_of(archive: str, data: bytes) -> pa.RecordBatch:
    """The captures of an archive, sorted."""
    rows = []
    for fields, at, end, payload in parsed(data):
        digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields[b"payload"])):
            raise ValueError(f"{archive}: the payload at byte {at} doesn't match its digest")
        page, key = _number(fields[b"warc-record-id"]), url_key(fields[b"warc-target-uri"].decode())
        rows.append((key, fields[b"warc-date"].decode(), page is not None, page or 0, at, page, int(fields[b"payload"]), digest, fields[b"warc-type"].decode(), _number(fields.get(b"warc-refers-to")), end - at))
    rows.sort()
    return _batch([[(r[0], r[1], r[5], r[6], r[7], r[8], r[9], archive, r[4], r[10], i)[c] for i, r in enumerate(rows)] for c in range(len(_FIELDS))])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: a run of sorted captures for each archive (``pos``), with the record's place in it."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _run_of(path.rpartition("/")[2], content.as_py())

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, _SCHEMA)


class LoserTree:
    """Merges sorted runs of tuples. Inner nodes keep the loser of the match below them, ``top`` is the winner of all."""

    OVER = (1,)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.loser, self.top = runs, [-1] * len(runs), 0
        self.heads = [self._next(r) for r in runs]
        for leaf in range(len(runs)):
            self._play(leaf)

    def _next(self, run: Iterator[tuple]) -> tuple:
        item = next(run, None)
        return self.OVER if item is None else (0, item)

    def _play(self, leaf: int) -> None:
        """Sends a leaf's head up; at a node that nobody has reached yet it waits."""
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = winner
                return
            if self.heads[other] < self.heads[winner]:
                self.loser[node], winner = winner, other
            node //= 2
        self.top = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.top] is not self.OVER:
            yield self.heads[self.top][1]
            self.heads[self.top] = self._next(self.runs[self.top])
            self._play(self.top)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the segments of all runs that fall into a range."""
    rows = pa.Table.from_batches(batches, pa.schema([(k, _ARROW[t]) for k, t in _FIELDS.items()]))
    rows = rows.sort_by([("archive", "ascending"), ("pos", "ascending")])
    segments: dict[str, list[int]] = {}
    for i, archive in enumerate(rows.column("archive").to_pylist()):
        segments.setdefault(archive, []).append(i)
    key, captured, page, archive, at = (rows.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "at"))
    cursor = lambda own: ((key[i], captured[i], page[i] is not None, page[i] or 0, archive[i], at[i], i) for i in own)
    order = [x[-1] for x in LoserTree([cursor(own) for own in segments.values()])]
    yield from rows.take(pa.array(order, pa.int64())).combine_chunks().to_batches()


def histories(index: DataFrame, crawl: Crawl = Crawl()) -> DataFrame:
    """The captures of all archives in the order of URL key, time and page_id. ``index`` is read three times: cut it first."""
    ship(index.sparkSession)
    n = max(1, -(-index.count() // crawl.range_rows))
    return index.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "at").mapInArrow(_merge, _SCHEMA)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are deleted once their index is cut."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    index = cut(read_archives(spark, folder))
    delete(spark, folder)
    return histories(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


_SQL = r"""
WITH payloads AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
largest AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads),
hosts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)', 1)), '^.*@', ''), '^www\.|:(80|443)$', '') AS host,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)', 2) AS path FROM largest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM hosts
"""

QUERIES = {"op12_warc": op12_warc}
ORACLES = {"op12_warc": _SQL}
