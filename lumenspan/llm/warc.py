"""WARC archives: writing with revisit records, reading back, and an external merge of the capture index.

* ``write_archives`` writes a WARC/1.1 record per page, each a gzip member of its own, in archives of about
  ``ARCHIVE`` bytes of payload in the shared folder. Of pages with equal payloads of ``min_bytes`` or more, the one with
  the smallest id becomes a response, the others revisits without a payload. Each archive's index entries, sorted by
  URL key and time, are a run; runs are a Parquet table, so an archive that a lost task left behind is never read.
* ``capture_histories`` merges the runs: entries are dealt into ranges of (URL key, time, id), so that even one URL's
  captures can span ranges, and each range merges its slices of the k runs by a loser tree. Each entry gets its place in
  the order over all and the time of the capture before of its URL key. Ranges are of bounded size, so a task holds its
  slices in memory.
* ``read_archives`` reads archives by streaming, a member at a time, and checks payloads against their digests.

Defined results: a null html is an empty payload; a null url has the key ``-``; a page with a null id is always a
response and no one's original; rows that repeat the smallest id of a payload are all responses; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import estimated_bytes, partitions, pieces, run_dir, written

ARCHIVE = 32 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
INDEX = "run string, seq long, url_key string, capture_ts string, page_id long, file string, offset long, length long"
RECORD = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: captures of a site lie together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, when: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    body = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def capture_time(page_id: int | None) -> str:
    """The pages have no time of their own: a second for each id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y%m%d%H%M%S")


def write_archives(pages: DataFrame, at: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", when: Callable[[int | None], str] = capture_time) -> DataFrame:
    """Write all pages below ``at``; returns the runs of the index."""
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = page.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first != last")
    # Only revisits have a row here; pages are joined by id, so equal payloads don't meet in one task.
    revisits = page.select("page_id", "sha").join(first, "sha").where("page_id != first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    page = page.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    folder = f"{at}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        out, entries, size, place, name = None, [], 0, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            entries.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2]))
            key, ts, ids, offset, length = zip(*entries)
            n = len(entries)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(key), pa.array(ts), pa.array(ids, pa.int64()), pa.array([name] * n), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["run", "seq", "url_key", "capture_ts", "page_id", "file", "offset", "length"])

        for part in pieces(batches, 4 << 20, "html"):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, entries, size, place = files.open_output_stream(f"{root}/{name}", compression=None), [], 0, 0
                payload = html.encode()
                ts = when(page_id)
                raw = record(page_id, url, ts, payload, refers_to)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                entries.append((url_key(url), ts, page_id, place, len(raw)))
                place, size = place + len(raw), size + len(payload)
                if size >= ARCHIVE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(page.mapInArrow(run, INDEX), f"{at}/runs")


class LoserTree:
    """The smallest head of k sorted runs: each inner node holds the loser of its match, so a step plays log2 k matches."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, first=True)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0 and first:  # waits for its opponent
                self.tree[node] = winner
                return
            if not self._wins(winner, self.tree[node]):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            run = self.tree[0]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


MERGED = "url_key string, capture_ts string, page_id long, file string, offset long, length long, range int, seq long, previous_ts string"


def merged_ranges(runs: DataFrame) -> DataFrame:
    """The index of all runs, range by range: each range's number, an entry's place in it, and the time of the capture
    before of its URL key, as far as the range tells."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            at = 0
            for k in range(1, len(names) + 1):  # a run's entries arrive together, or in few stretches
                if k == len(names) or names[k] != names[at]:
                    slices.setdefault(names[at], []).append(batch.slice(at, k - at))
                    at = k

        def entries(own: list[pa.RecordBatch]) -> Iterator[tuple]:
            rows = pa.Table.from_batches(own).sort_by("seq")  # stretches may arrive in any order
            for part in rows.to_batches(4096):
                for row in zip(*(part.column(c).to_pylist() for c in ("url_key", "capture_ts", "page_id", "file", "offset", "length"))):
                    yield (row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4], row[5])

        number, seq, before, out = TaskContext.get().partitionId(), 0, (None, None), []
        for row in LoserTree([entries(s) for s in slices.values()]):
            out.append((*row, number, seq, before[1] if before[0] == row[0] else None))
            seq, before = seq + 1, row
            if len(out) == 8192:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        key, ts, ids, file, offset, length, number, seq, before = zip(*rows)
        columns = [pa.array(key), pa.array(ts), pa.array([None if i == -1 else i for i in ids], pa.int64()), pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(seq, pa.int64()), pa.array(before, pa.string())], [c.split()[0] for c in MERGED.split(", ")])

    n = partitions(runs.sparkSession, estimated_bytes(runs), 16 << 20)
    return runs.repartitionByRange(n, "url_key", "capture_ts", "page_id").mapInArrow(merge, MERGED)


def capture_histories(runs: DataFrame, at: str) -> DataFrame:
    """The index of all runs with each entry's place in the order of URL key, time and id (``history_no``, from 0), and
    the time of the capture before of its URL key (``previous_ts``)."""
    ranges = written(merged_ranges(runs), f"{at}/ranges")
    # A row for each range: what lies before it, and the entry before its first. As many rows as ranges, whatever they hold.
    last = ranges.groupBy("range").agg(F.count("*").alias("n"), F.max_by("url_key", "seq").alias("key"), F.max_by("capture_ts", "seq").alias("ts"))
    w = Window.orderBy("range")
    first = last.select("range", (F.sum("n").over(w) - F.col("n")).alias("before"), F.lag("key").over(w).alias("last_key"), F.lag("ts").over(w).alias("last_ts"))
    carried = F.when((F.col("seq") == 0) & (F.col("last_key") == F.col("url_key")), F.col("last_ts")).otherwise(F.col("previous_ts"))
    return ranges.join(F.broadcast(first), "range").select("url_key", "capture_ts", "page_id", "file", "offset", "length", (F.col("before") + F.col("seq")).alias("history_no"), carried.alias("previous_ts"))


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    held, start, ended = b"", 0, False
    while True:
        if not held:
            held = stream.read(block)
            if not held:
                return
        unpacker, out, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = stream.read(block)
                if not held:
                    raise EOFError("an archive ends inside a record")
            out.append(unpacker.decompress(held))
            used += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        yield start, b"".join(out)
        start += used


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return named, rest[: int(named["Content-Length"])]


def read_archives(runs: DataFrame, at: str) -> DataFrame:
    """A row per record of the archives that the runs name."""
    folder = f"{at}/archives"

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, raw in members(stream):
                        named, block = parsed(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        told = named["WARC-Payload-Digest"].removeprefix("sha1:")
                        if named["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != told):
                            raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                        rows.append((name, offset, number(named["WARC-Record-ID"]), size, told, named["WARC-Type"], number(named.get("WARC-Refers-To"))))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5]), pa.array(cols[6], pa.int64())], ["file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    names = runs.select("file").distinct()
    n = partitions(runs.sparkSession, 0)
    return names.repartition(max(n, 4 * runs.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(run, RECORD)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, merge the index and read the archives back: a row per page, with its place in the histories."""
    at = run_dir(pages.sparkSession, "warc")
    runs = write_archives(pages, at, min_bytes)
    history = capture_histories(runs, at).select("url_key", "capture_ts", "history_no", "previous_ts", "file", "offset", "length")
    return history.hint("merge").join(read_archives(runs, at), ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "history_no", "previous_ts", "file", "offset", "length")


def op4_warc_merge(spark, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives tells it."""
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("file", "offset", "length")
