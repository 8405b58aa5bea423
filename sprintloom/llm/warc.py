"""WARC archives of pages, and their index by external merge.

Pages are written as WARC 1.1 records, each a gzip member of its own, in archives of bounded size. A
payload that several pages share is stored once; the others' records are revisits that refer to it.
Reading gives index lines in sorted runs. The runs are cut at the same places of the order (URL key, time), and
each slice of all runs is merged by a loser tree.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sprintloom.llm.common import join_groups
from sprintloom.session import shared_dir, written

# Payloads below this size are always stored.
LEAST_SHARED = 1000
# Bytes of an archive before the record that completes it.
ARCHIVE = 16 << 20
# Index lines of a merge task.
SLICE = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_EPOCH = dt.datetime(1970, 1, 1)


# ── deciding what is stored ─────────────────────────────────────────────────────────────────────


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages(page_id, url, html, at)`` with ``refers_to``: for all but the largest id among equal payloads of ``least``
    bytes or more, that largest id. Rows that repeat the largest id are stored each; a null id is smaller than any."""
    size = F.octet_length("html")
    digest = F.when(size >= least, F.concat(F.sha2("html", 256), F.lit(":"), size.cast("string")))
    named = pages.withColumn("_digest", digest)
    shared = named.filter("_digest is not null").groupBy("_digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("_last")).filter("n > 1")
    met = join_groups(named, written(shared, "payloads"), "_digest", F.struct("page_id", "url"))
    return met.select("page_id", "url", "html", "at", F.when(~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last")).alias("refers_to"))


# ── writing ─────────────────────────────────────────────────────────────────────────────────────


def _quoted(text: str) -> str:
    """Characters that a header line cannot hold as percent codes."""
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~-._")


def record(page_id: object, url: str | None, payload: bytes, at: dt.datetime, refers_to: object = None) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header of its payload and no payload."""
    revisit = refers_to is not None
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda x: f"<{_ID}{'' if x is None else quote(str(x), safe='')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
             f"WARC-Date: {at.isoformat(timespec='microseconds')}Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_quoted(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _archives(limit: int):
    """Rows ``page_id, url, html, at, refers_to`` to archives, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            whole = b"".join(members)
            members.clear()
            return pa.record_batch([pa.array([whole], pa.binary())], names=["archive"])

        for batch in batches:
            ids, urls, times, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, html, at, to in zip(ids, urls, batch.column(2), times, refers):
                plain = record(page_id, url, (html.as_py() or "").encode(), at or _EPOCH, to)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(packer.compress(plain) + packer.flush())
                size += len(members[-1])
                if size >= limit:
                    yield archive()
                    size = 0
        if members:
            yield archive()

    return run


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE, least: int = LEAST_SHARED) -> None:
    """Write ``pages(page_id, url, html, at)`` below ``folder``, an archive per file.

    An archive is closed by the record that brings it to ``limit`` bytes. Null html is the empty payload, a null
    time 1970-01-01. Spark's text writer puts the bytes down as they are and names the files.
    """
    rows = with_revisits(pages, least)
    archives = rows.mapInArrow(_archives(limit), "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)


# ── reading ─────────────────────────────────────────────────────────────────────────────────────


def members(archive: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member. Bytes between members are passed over."""
    at, size = 0, len(archive)
    while at < size:
        if bytes(archive[at:at + 2]) != b"\x1f\x8b":
            at += 1
            continue
        packer, parts, ahead = zlib.decompressobj(31), [], at
        while not packer.eof and ahead < size:
            step = archive[ahead:ahead + (1 << 16)]
            parts.append(packer.decompress(step))
            ahead += len(step)
        end = ahead - len(packer.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the block, whose end is where Content-Length says."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("a record ends early")
    return headers, rest[:length]


def _page_id(name: str | None) -> str | None:
    text = unquote_to_bytes((name or "").strip("<>").removeprefix(_ID)).decode()
    return text or None


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then the path and query: captures of a site stay together."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # not a URL: the text itself
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return (",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")"
            + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def index_line(content: bytes) -> tuple:
    """(URL key, time, id, URL, type, payload bytes, digest, refers to) of a record.

    A response's digest is computed from the payload read and compared with the header's; a
    revisit's size and digest are those of the payload it stands for.
    """
    headers, block = parsed(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, size = headers["warc-type"], len(payload)
    if kind == "revisit":
        fields = (line.partition(b":") for line in http.split(b"\r\n")[1:])
        size = next(int(v) for k, _, v in fields if k.strip().lower() == b"content-length")
    elif hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    at = dt.datetime.fromisoformat(headers["warc-date"].removesuffix("Z"))
    url = headers.get("warc-target-uri")
    return (url_key(url), at, _page_id(headers["warc-record-id"]), url, kind, size, stated,
            _page_id(headers.get("warc-refers-to")) if kind == "revisit" else None)


_LINE = "url_key string, at timestamp_ntz, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
_PLACE = "archive string, offset long, length long"
_ARROW = [pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
          pa.string(), pa.int64(), pa.int64()]
_NAMES = [f.split(" ")[0] for f in f"{_LINE}, {_PLACE}".split(", ")]
_ORDER = [_NAMES.index(n) for n in ("url_key", "at", "page_id", "archive", "offset")]


def _key(line: tuple) -> tuple:
    """The order of the index. Ids that are whole numbers sort as such, before others."""
    page_id = line[2] or ""
    number = page_id.removeprefix("-")
    whole = number.isdecimal() and number.isascii()
    return (line[0], line[1], not whole, int(page_id) if whole else 0, page_id, line[8], line[9])


def _batch(lines: list[tuple], more: list[tuple[str, list]]) -> pa.RecordBatch:
    columns = list(zip(*lines)) or [()] * len(_NAMES)
    arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW)] + [pa.array(c, pa.int64()) for _, c in more]
    return pa.record_batch(arrays, names=[*_NAMES, *(n for n, _ in more)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to index lines, sorted by archive: a run each."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            lines = [(*index_line(plain), path, offset, length)
                     for offset, length, plain in members(memoryview(content.as_buffer()))]
            if lines:
                yield _batch(sorted(lines, key=_key), [])


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index lines of every archive below ``folder``: sorted in each archive, and written."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return written(files.mapInArrow(_runs, f"{_LINE}, {_PLACE}"), "runs")


# ── merging ─────────────────────────────────────────────────────────────────────────────────────


class LoserTree:
    """Merges sorted sequences of (key, value): each inner node keeps the loser of its match, so the next
    value costs one match per level on the way up from the winner's leaf."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.count = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.count
        self.winner = -1
        for leaf in range(self.count):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses; of equal keys the earlier run wins."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.count) // 2, leaf
        while node:
            if self.losers[node] < 0:  # waits for the other side's first winner
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one slice, run by run in order, to one order."""
    part, runs = TaskContext.get().partitionId(), {}
    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(line[8], []).append((_key(line), line))
    merged = LoserTree([iter(run) for run in runs.values()])
    at, lines = 0, []
    for _, line in merged:
        lines.append(line)
        if len(lines) == 1 << 14:
            yield _batch(lines, [("part", [part] * len(lines)), ("position", list(range(at, at + len(lines))))])
            at, lines = at + len(lines), []
    yield _batch(lines, [("part", [part] * len(lines)), ("position", list(range(at, at + len(lines))))])


def merged_index(runs: DataFrame, slice_lines: int = SLICE) -> DataFrame:
    """All lines of sorted ``runs`` in order of URL key, time and id, with ``part`` and ``position`` in it.

    Ranges of the order hold about ``slice_lines`` lines. Spark finds their bounds from a sample of the keys; as the keys
    end in archive and offset, no two lines are equal, so a URL that is captured very often spreads over
    many ranges. A slice's lines arrive sorted by run and are merged in one task, which holds them.
    """
    number = F.expr("try_cast(page_id as decimal(38,0))")
    order: list[Column] = [F.col("url_key"), F.col("at"), number.isNull(), number, F.col("page_id"), F.col("archive"), F.col("offset")]
    slices = -(-runs.count() // slice_lines) or 1
    dealt = runs.repartitionByRange(slices, *order).sortWithinPartitions("archive", *order)
    return dealt.mapInArrow(_merge, f"{_LINE}, {_PLACE}, part long, position long")


def capture_index(pages: DataFrame, at: Column | None = None, folder: str | None = None, limit: int = ARCHIVE,
                  least: int = LEAST_SHARED, slice_lines: int = SLICE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their merged index, a row per page.

    ``url_key, at, page_id, url, record_type, payload_bytes, payload_digest, refers_to, archive, offset, length, part,
    position``: captures of a URL follow each other by time. ``at`` is the time of capture (default: the id as seconds since
    1970, for a table that has none). Null html is the empty payload, null urls have the empty key, null ids
    stay null, repeated rows are a record each. Ids are strings in the index; an id that is the empty
    text reads back as null. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    time = F.timestamp_seconds(F.expr(f"try_cast(`{page_id}` as bigint)")) if at is None else at
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
                        time.cast("timestamp_ntz").alias("at"))
    folder = folder or shared_dir(spark, "archives")
    write_archives(rows, folder, limit, least)
    return merged_index(sorted_runs(spark, folder), slice_lines)


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, html`` of every record below ``folder``; revisits get the payload they refer to by a join on the id."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for _, _, plain in members(memoryview(content)):
                    line, (_, block) = index_line(plain), parsed(plain)
                    stored = block.partition(b"\r\n\r\n")[2].decode() if line[4] != "revisit" else None
                    rows.append((line[2], line[3], stored, line[7]))
                yield pd.DataFrame(rows, columns=["page_id", "url", "html", "refers_to"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    records = written(files.mapInPandas(read, "page_id string, url string, html string, refers_to string"), "records")
    payloads = records.filter("refers_to is null").select(F.col("page_id").alias("refers_to"), F.col("html").alias("_html")).dropDuplicates(["refers_to"])
    return records.join(payloads, "refers_to", "left").select("page_id", "url", F.coalesce("html", "_html").alias("html"))
