"""WARC archives with revisits, and a capture index merged from sorted runs (operator 6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_parts, left_by, marked, new_path, stored

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    #: Payloads shorter than this are never revisits.
    least_payload: int = 100
    #: Mean size of an archive, and how many times that it has at most (or one record); a reader holds one archive in memory.
    archive_bytes: int = 32 << 20
    most_times: int = 4
    #: Pages have no capture time: page n counts as captured n seconds after this moment, modulo a thousand million.
    first_capture: str = "2024-01-01 00:00:00"
    #: Captures of one range of the merged index, on average; a task holds one range.
    range_rows: int = 200_000


def records(pages: DataFrame, params: WarcParams) -> DataFrame:
    """One row a page: page_id, captured, and the record without its closing blank lines.

    Which payloads are shared is settled on digests alone (a grouped minimum,
    combined before the shuffle). Only pages that may be revisits, by a filter
    of fixed size, are shuffled to meet the decisions, by their unique ids, so a
    payload that very many pages share makes no large partition; the others are
    written where they were read.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    keyed = p.where((F.col("bytes") >= params.least_payload) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = stored(keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("many")).where("many > 1"), "payloads")
    revisit = stored(left_by(keyed, first, ["digest"], "many", keyed.count()).where("page_id <> refers_to").distinct(), "revisits")
    p = marked(p, filter_parts(revisit, "page_id"), "page_id")
    met = p.where("maybe__").drop("maybe__").join(revisit, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "bytes", "refers_to")
    p = p.where("NOT maybe__").select("page_id", "url", "html", "digest", "bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(met)
    captured = F.lit(params.first_capture).cast("timestamp_ntz") + F.make_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)).cast("decimal(18,6)"))
    is_revisit = F.col("refers_to").isNotNull()

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string")), F.concat(F.lit("<urn:uuid:"), F.uuid())), F.lit(">")),
        line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return p.withColumn("captured", captured).withColumn("block", block).select("page_id", F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, params: WarcParams | None = None) -> None:
    """Writes the pages as WARC files by Spark's text writer, whose row ends are a record's closing blank lines.

    Spark commits the files, so a task that runs twice leaves one copy, on any
    file system that Spark writes to. An archive has so few records that even if
    all were as long as the longest it would keep within its bytes.
    """
    params = params or WarcParams()
    length = F.octet_length(F.coalesce("html", F.lit(""))) + F.coalesce(F.octet_length("url"), F.lit(0)) + 600
    mean, longest = pages.agg(F.avg(length), F.max(length)).first()
    most = max(1, int(min(params.archive_bytes / (mean or 600), params.most_times * params.archive_bytes / (longest or 600))))
    records(pages, params).select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


def url_key(url: str | None) -> str | None:
    """Sortable form of a URL: host labels reversed, then path and query; no scheme, www, port or fragment."""
    if url is None:
        return None
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.split("#")[0].lower()
    host = re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower().rstrip(".")
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + ")" + (m[2] or "/").lower()


@dataclass
class Capture:
    key: str | None
    captured: str
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    offset: int
    length: int

    def order(self) -> tuple:
        return (self.key is not None, self.key or "", self.captured, self.page_id is not None, self.page_id or 0, self.offset)


def number(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def read_archive(content: bytes) -> Iterator[Capture]:
    """The records of one archive; lengths in the headers say where a record ends, so payloads may hold anything."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        block = content[start:stop]
        http, _, payload = block.partition(b"\r\n\r\n")
        said = head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if head["WARC-Type"] == "response":
            digest = hashlib.sha256(payload).hexdigest()
            if digest != said or size != len(payload):
                raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
        yield Capture(url_key(head.get("WARC-Target-URI")), head["WARC-Date"], number(head["WARC-Record-ID"]), size, said, head["WARC-Type"], number(head.get("WARC-Refers-To")), at, stop - at)
        at = stop + 4


SCHEMA = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in SCHEMA.split(", ")]


def as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives, each archive's sorted by URL key, time and id: a run named by its archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = sorted(read_archive(content.as_py()), key=Capture.order)
                file = name.as_py().rpartition("/")[2]
                yield as_batch([(c.key, c.captured, c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to, file, c.offset, c.length) for c in rows], COLUMNS, TYPES)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = spark.conf.get(key)
    spark.conf.set(key, "1")  # a row is a whole archive
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    try:
        return stored(files.mapInArrow(read, SCHEMA), "runs")
    finally:
        spark.conf.set(key, asked)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep losers, so each next row plays one match a level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        k = max(len(runs), 1)
        self.heads = [self.head(r) for r in range(len(runs))] or [None]
        winner = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.first = winner[1] if k > 1 else 0

    def head(self, r: int):
        return self.key(self.runs[r][self.at[r]]) if self.at[r] < len(self.runs[r]) else None

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        k = len(self.losers)
        while self.heads[self.first] is not None:
            r = self.first
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.heads[r] = self.head(r)
            node = (r + k) // 2
            while node:
                if self.before(self.losers[node], r):
                    r, self.losers[node] = self.losers[node], r
                node //= 2
            self.first = r


def natural_runs(rows: list[tuple], order) -> list[list[tuple]]:
    """rows cut wherever they descend, so that each piece is sorted."""
    cuts = [k for k in range(1, len(rows)) if order(rows[k - 1]) > order(rows[k])]
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if a < b]


def merged_index(runs: DataFrame, params: WarcParams | None = None) -> DataFrame:
    """All captures in global order of URL key, time and id.

    Spark deals the runs out by ranges of (key, time, id), so a URL with very
    many captures is still split, and there are so many ranges that each holds
    range_rows captures on average, whatever the corpus. Inside a range the
    pieces of the runs come as they were sorted and go through a loser tree;
    where a run was read in parts, each part is a piece of its own.
    """
    params = params or WarcParams()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, key, when, page, offset = (COLUMNS.index(c) for c in ("archive", "url_key", "captured", "page_id", "offset"))
        order = lambda r: (r[key] is not None, r[key] or "", r[when], r[page] is not None, r[page] or 0, r[offset])
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[run], []).append(row)
        out = []
        for row in LoserTree([x for name in sorted(pieces) for x in natural_runs(pieces[name], order)], order):
            out.append(row)
            if len(out) == 5000:
                yield as_batch(out, COLUMNS, TYPES)
                out = []
        yield as_batch(out, COLUMNS, TYPES)

    ranges = max(runs.count() // params.range_rows + 1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartitionByRange(ranges, F.col("url_key").asc_nulls_first(), "captured", "page_id").mapInArrow(merge, SCHEMA)


def archived(pages: DataFrame, params: WarcParams | None = None) -> DataFrame:
    """Writes the pages, reads the archives back and returns the merged capture index.

    A null html is an empty payload; a null url has no URL key and sorts first;
    a page without id is a response that nothing refers to; rows that repeat an
    id and its payload are captures of the same standing; no pages give no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, params)
    return merged_index(sorted_runs(spark, path), params)
