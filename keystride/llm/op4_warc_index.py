"""WARC archives and their capture index: sorted runs, one per archive, merged by URL key and time.

Writing: records are dealt to archives of about `ARCHIVE_BYTES`; each is a gzip member of its own (so an offset reads one
record). Of equal payloads of `MIN_BYTES` or more, the record with the largest page_id is a response, the others are
revisits that name it; the group is found by a digest that is aggregated before it is shuffled. File names hold the task
attempt, and only the manifest of successful tasks is read again, so a lost executor leaves at most a file nobody reads.

Index: reading an archive gives its run, the captures in order of URL key (host reversed, then path), time and record id. A
range shuffle on that order brings each range's slices of all runs to one task, which merges them with a loser tree:
k slices, log2(k) comparisons a capture. Rows of one URL are many ranges if they are many.

Archives lie in the shared folder and are reached through Arrow's file systems by the folder's own scheme.

Null html is an empty payload; a null url stays null in the index and first in order. Rows with one page_id and one payload
are responses all, if it is the largest id. Payloads that only null ids hold are responses. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import staged, table, width

ARCHIVE_BYTES, MIN_BYTES = 16 << 20, 1000
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def _place(uri: str):
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def record(page_id, url, date: str, payload: bytes, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone."""
    digest = hashlib.sha1(payload).hexdigest()
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body) + (0 if revisit else len(payload))}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + (b"" if revisit else payload) + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write `page_id, url, html` as archives; the manifest `path, records, bytes`. Captures have made-up times: page_id seconds into 2024."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    big = F.octet_length("html") >= min_bytes
    groups = rows.where(big).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    rows = rows.withColumn("date", F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def write(batches):
        at, base = _place(folder)
        at.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, done, n, size, k = None, "", [], 0, 0, 0
        for b in batches:
            for page, url, html, refers, date in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "date"))):
                if out is None:
                    name, k = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz", k + 1
                    out, n, size = at.open_output_stream(name, compression=None), 0, 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url, date, html.encode(), refers)) + z.flush()
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return staged(rows.select("page_id", "url", "html", "refers_to", "date").mapInArrow(write, "path string, records long, bytes long"))


def members(stream):
    """Offset, stored length and content of each gzip member of a stream."""
    data, offset = b"", 0
    while True:
        z, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while not z.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    return
            out.write(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield offset, used, out.getvalue()
        offset += used


def url_key(url: str | None) -> str | None:
    """Host labels from the right, then the rest, in lower case: captures of a site sort together."""
    if url is None:
        return None
    host, sep, rest = re.sub(r"^[^:/?#]*://", "", url.lower()).partition("/")
    return ",".join(reversed(host.split("."))) + ")" + sep + rest


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record, each archive's in run order: `run, pos, url_key, ts, page_id, payload_bytes, payload_digest, record_type, refers_to, path, offset, length`."""
    folder = shared_folder(spark)

    def read(batches):
        at, _ = _place(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with at.open_input_stream(path, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        head, _, body = raw.partition(b"\r\n\r\n")
                        f = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(head)}
                        block = body[: int(f["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict((k.lower(), v) for k, v in _FIELD.findall(http))[b"content-length"])
                        named = f["warc-payload-digest"].removeprefix("sha1:")
                        revisit = f["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != named):
                            raise ValueError(f"{path} at {offset}: payload does not match its digest")
                        ident = lambda k: int(x) if (x := f.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023, E731
                        rows.append((url_key(f.get("warc-target-uri")), f["warc-date"], ident("warc-record-id"), size, named, f["warc-type"], ident("warc-refers-to"), path, offset, length))
                rows.sort(key=lambda r: (r[0] or "", r[1], r[2] if r[2] is not None else -1))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                run = re.sub(r"^.*/|\.warc\.gz$", "", path)
                cols = [pa.array([run] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))]
                yield pa.record_batch(cols, names=[x.split()[0] for x in RUN.split(", ")])

    return manifest.select("path").repartition(max(1, width(spark)), "path").mapInArrow(read, RUN)


RUN = "run string, pos long, url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"


class LoserTree:
    """Merge of sorted sequences: each inner node keeps the loser of its match, the overall winner stands at 0."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at:
            if self.node[at] == -1:  # while building: the first to come waits
                self.node[at] = i
                return
            if self._less(self.node[at], i):
                self.node[at], i = i, self.node[at]
            at //= 2
        self.node[0] = i

    def __iter__(self):
        while self.k and self.head[w := self.node[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def merged(runs: DataFrame) -> DataFrame:
    """The captures of all runs, `part, rank` giving the global order by URL key, time and record id."""
    key = (F.coalesce("url_key", F.lit("")), F.col("ts"), F.coalesce("page_id", F.lit(-1)))
    cols = [c for c in runs.columns if c not in ("run", "pos")]
    dealt = runs.repartitionByRange(width(runs.sparkSession), *key).sortWithinPartitions("run", "pos")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema if f.name in cols)

    def merge(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        run = t.column("run").to_pylist()
        order = list(zip((k or "" for k in t.column("url_key").to_pylist()), t.column("ts").to_pylist(), (-1 if p is None else p for p in t.column("page_id").to_pylist()), range(t.num_rows)))
        cuts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]] + [len(run)]
        seq = [x[-1] for x in LoserTree([order[a:z] for a, z in zip(cuts, cuts[1:])])]
        out = t.select(cols).take(pa.array(seq, pa.int64()))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(seq), pa.int32())).append_column("rank", pa.array(range(len(seq)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(merge, kinds + ", part int, rank long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    captures = merged(staged(read_archives(spark, manifest)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "part", "rank")

