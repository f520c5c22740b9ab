"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: one gzip member for each record, one file for each task in a folder that all machines see. A file counts only once its task's row
is in the manifest, so files of lost or repeated attempts are never read.

Reader: a task owns the records that start inside its byte range. It scans for the gzip magic, and takes a
candidate for a member only if that inflates to a WARC header, its check sum holds and the end of the file or another
magic follows. After a record it goes on at the record's end, so bytes inside members are never
looked at, except before the first record of a range. A range is read forwards in steps of a megabyte, each byte once, and a member is inflated once.

Nulls: a null payload is empty, a null URI becomes one made from the id, a null id is written as ``null`` and read back as null.
Repeated rows of the smallest id are all responses. A payload of any length is one record, held whole by its task. An empty table gives no
archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, new_path, text_bytes, written

MIN_REVISIT = 100
RANGE_BYTES = 16 << 20
MAGIC, RECORD = b"\x1f\x8b\x08", b"WARC/"
#: Bytes read at once, and bytes inflated at once.
STEP, CHUNK = 1 << 20, 1 << 16
_ID = "urn:page:"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop writes local paths as file:/x, which is no URI to Arrow."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A response, or for a null payload a revisit of ``refers_to``, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    name = "null" if page_id is None else page_id
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or f"{_ID}{name}"
    revisit = "" if payload is not None else f"WARC-Refers-To: <{_ID}{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head = f"WARC/1.1\r\nWARC-Type: {'response' if payload is not None else 'revisit'}\r\nWARC-Record-ID: <{_ID}{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{revisit}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, at = _open(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["payload_bytes"], row["refers_to"], date)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives now; returns their manifest: path, bytes, records.

    Of equal payloads of at least ``min_revisit`` bytes the smallest id is a response, and the others are revisits without a body.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = text_bytes(F.col(f"`{payload_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    # Ids only: the count of equal payloads shrinks before the shuffle.
    firsts = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # A table, so that the join can split a payload that very many pages share.
    firsts = written(firsts, "firsts")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "payload_bytes", F.when(again, F.col("first")).alias("refers_to"))
    return written(arrow_map(marked, _write(folder, date), "path string, bytes bigint, records bigint"), "manifest")


class Forward:
    """Bytes of a file by place, read forwards in large steps: no byte is read twice while places go up."""

    def __init__(self, handle, size: int, stop: int, step: int = STEP):
        self.handle, self.size, self.stop, self.step = handle, size, stop, step
        self.at, self.data = 0, bytearray()

    def forget(self, before: int) -> None:
        """Nothing below ``before`` is asked for again."""
        if before >= self.at + len(self.data):
            self.at, self.data = before, bytearray()
        elif before - self.at >= self.step:
            del self.data[: before - self.at]
            self.at = before

    def read(self, at: int, n: int) -> memoryview:
        n = min(n, self.size - at)
        while (end := self.at + len(self.data)) < at + n:
            self.handle.seek(end)
            # Behind the range only the rest of its last record is wanted.
            ahead = self.step if end < self.stop else max(CHUNK, at + n - end)
            new = self.handle.read(min(ahead, max(self.stop - end, CHUNK), self.size - end))
            if not new:
                raise OSError("the file is shorter than listed")
            self.data += new
        return memoryview(bytes(self.data[at - self.at : at - self.at + n]))

    def find(self, word: bytes, at: int, stop: int) -> int:
        """The first place of ``word`` that is at least ``at`` and below ``stop``, or -1."""
        while at < stop:
            self.read(at, CHUNK + len(word) - 1)
            k = self.data.find(word, at - self.at, min(self.at + len(self.data), stop + len(word) - 1) - self.at)
            if k >= 0:
                return self.at + k
            at = min(self.at + len(self.data) - len(word) + 1, stop) if self.at + len(self.data) < self.size else stop
            self.forget(at)
        return -1


def _member(source: Forward, start: int) -> tuple[bytes, int] | None:
    """The gzip member at ``start`` and where it ends, or None if it isn't a whole member that begins like a record. It is inflated once."""
    box, out, at, head = zlib.decompressobj(31), [], start, b""
    try:
        while at < source.size and not box.eof:
            data = source.read(at, CHUNK)
            out.append(box.decompress(data))
            at += len(data)
            if len(head) < len(RECORD):
                head += out[-1][: len(RECORD)]
                if not RECORD.startswith(head[: len(RECORD)]):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), at - len(box.unused_data)) if box.eof and head.startswith(RECORD) else None


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record's block is cut short")
    return fields, rest[:size]


def records_from(handle, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every record that starts in [start, stop)."""
    source, at = Forward(handle, size, stop), start
    source.forget(start)
    while (at := source.find(MAGIC, at, stop)) >= 0:
        source.forget(at)
        found = _member(source, at)
        # The end of the file or the next member's magic has to follow.
        if found is None or not (found[1] >= size or source.read(found[1], 2) == MAGIC[:2]):
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def number(name: str | None) -> int | None:
        tail = (name or "").strip("<>").removeprefix(_ID)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for job in batch.to_pylist():
            fs, path = _open(job["path"])
            rows, held = [], 0
            with fs.open_input_file(path) as handle:
                for _, data in records_from(handle, job["bytes"], job["start"], job["stop"]):
                    head, block = parse_record(data)
                    http, _, body = block.partition(b"\r\n\r\n")
                    said = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    if head["warc-type"] == "response":
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                        if said and said != digest:
                            raise ValueError(f"{job['path']}: a payload doesn't have its digest")
                    elif head["warc-type"] == "revisit":
                        size, digest, body = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), said, None
                    else:
                        continue
                    rows.append((number(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], number(head.get("warc-refers-to")), body, size, digest))
                    held += len(data)
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of the archives that a path or pattern names; the content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Responses and revisits of the archives (path, bytes), read by ranges of ``range_bytes``: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")).select("path", "bytes", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("stop"))
    spark = files.sparkSession
    dealt = ranges.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    return arrow_map(dealt, _read, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string")
