"""Operator 1, WARC: a normaliser of monolithic gzip files.

A WARC file compressed as one gzip stream can only be read from its start. The normaliser inflates such a stream once, in
chunks, writes every record as a gzip member of its own and beside the new file ``<name>.idx``, JSON lines with offset and
length of each member, by which a single record can be read. Files of several members are accepted too. A file is one task,
and memory holds a chunk and a record's header, never a record. Files are read and written through pyarrow's file systems
(file:, hdfs:, s3:), under a name of the attempt, and renamed when complete, so that a lost or repeated task does no harm.

Cases: header lines end in CRLF or LF, and a record may be followed by any number of line ends, also none at the end of a
file. A record whose header can't be read is passed over up to the next line that begins with 'WARC/'; the index tells where, in a row of status 'malformed'
with length 0. A record is also malformed if neither an empty line, a record nor the file's end follows its body, as where its Content-Length is wrong:
it keeps its member, and the search for the next one goes on from the first line within it that begins with 'WARC/' (the source is opened once more for
that, the only case in which it is inflated twice). If the stream breaks off or its gzip is damaged, whole records before that stay, and the index ends in a row of status
'truncated' or 'malformed' with length 0 (of a record of over 256 KB the new file then has a broken member at its end, which the index doesn't list).
An empty file has no records. Repeated records are members of their own. A new file takes the place of one of its name. For
tables of pages: a null url is an empty one, null html a record without a body, rows are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_dir, materialize, new_dir

CHUNK = 1 << 18
INDEX = "file string, seq bigint, offset bigint, length bigint, raw_length bigint, type string, uri string, record_id string, page_id bigint, status string"
FIELDS = [x.split()[0] for x in INDEX.split(", ")]
KINDS = {"string": pa.string(), "bigint": pa.int64()}
ARROW = pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    uid = hashlib.sha1(f"{page_id} {url}".encode() + body).hexdigest()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Record-ID: <urn:sha1:{uid}>", "Content-Type: text/html"]
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def inflate(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """Raw bytes of a gzip stream of one or more members; EOFError if it breaks off, zlib.error if it is broken."""
    z, fed = zlib.decompressobj(31), False
    while data := source.read(chunk):
        while data:
            fed = True
            yield z.decompress(data, CHUNK * 4)
            data = z.unconsumed_tail
            if z.eof:
                data, z, fed = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    if fed:
        raise EOFError


class Window:
    """The raw bytes of a stream, some of them at hand; ``at`` counts those that are past."""

    def __init__(self, open_, chunk: int):
        self.open, self.chunk = open_, chunk
        self.chunks, self.buffer, self.at = inflate(open_(), chunk), bytearray(), 0

    def more(self) -> bool:
        for c in self.chunks:
            if c:
                self.buffer.extend(c)
                return True
        return False

    def skip(self, n: int) -> bytes:
        taken = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += len(taken)
        return taken

    def have(self, n: int) -> bool:
        while len(self.buffer) < n:
            if not self.more():
                return False
        return True

    def back(self, to: int) -> None:
        """Go back to raw byte ``to``: the stream is opened again."""
        self.chunks, self.buffer, self.at = inflate(self.open(), self.chunk), bytearray(), 0
        while self.at < to:
            if not self.have(1):
                return
            self.skip(to - self.at)

    def seek_record(self) -> None:
        """Move to the next line that begins with WARC/, or to the end."""
        self.skip(1)
        while (i := self.buffer.find(b"\nWARC/")) < 0:
            self.skip(max(0, len(self.buffer) - 5))
            if not self.more():
                self.skip(len(self.buffer))
                return
        self.skip(i + 1)

    def header(self) -> bytes | None:
        """The lines up to the empty one, taken; None if there is no such line within HEADER bytes, and nothing is taken."""
        seen = 0
        while not (m := EMPTY_LINE.search(self.buffer, max(0, seen - 4))):
            seen = len(self.buffer)
            if seen > HEADER or not self.more():
                return None
        return self.skip(m.end())


HEADER = 1 << 20
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def rewrite(open_, sink, file: str, level: int = 6) -> Iterator[dict]:
    """Copy the records of the stream that ``open_()`` gives to ``sink``, each as a gzip member; yields an index row for each."""
    w, offset, seq = Window(open_, CHUNK), 0, 0

    def row(length: int, raw: int, fields: dict, status: str) -> dict:
        page = fields.get("warc-page-id", "")
        return dict(zip(FIELDS, (file, seq, offset, length, raw, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), int(page) if page.isdecimal() else None, status)))

    try:
        while True:
            while w.have(1) and w.buffer[:1] in (b"\r", b"\n"):
                w.skip(1)
            if not w.have(1):
                return
            head = w.header()
            if head is None and len(w.buffer) <= HEADER and w.buffer.startswith(b"WARC/") and w.buffer.find(b"\nWARC/") < 0:
                raise EOFError  # the file ends within a header
            lines = (head or b"").decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
            if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdecimal() or any(x.startswith("WARC/") for x in lines[1:]):
                yield row(0, 0, {}, "malformed")
                seq += 1
                inner = head.find(b"\nWARC/", 1) + 1 if head else 0
                if head:
                    w.buffer[:0], w.at = head[inner:], w.at - len(head) + inner
                if not inner:
                    w.seek_record()
                continue
            left, z, size, raw, parts, tail, inner = int(fields["content-length"]), zlib.compressobj(level, zlib.DEFLATED, 31), 0, len(head), [], b"", -1
            parts.append(z.compress(head))
            while left:
                if not w.have(1):
                    raise EOFError
                at = w.at
                take = w.skip(left)
                left, raw = left - len(take), raw + len(take)
                if inner < 0 and (i := (tail + take).find(b"\nWARC/")) >= 0:
                    inner = at - len(tail) + i + 1
                tail = (tail + take)[-5:]
                parts.append(z.compress(take))
                if sum(map(len, parts)) > CHUNK:  # until then nothing is written, so that a short record is whole or absent
                    size += sum(map(len, parts))
                    sink.write(b"".join(parts))
                    parts = []
            gap = b""
            while len(gap) < 4 and gap != b"\n\n" and w.have(1) and w.buffer[:1] in (b"\r", b"\n"):
                gap += w.skip(1)
            parts.append(z.compress(b"\r\n\r\n") + z.flush())
            sink.write(b"".join(parts))
            size += sum(map(len, parts))
            while w.have(1) and w.buffer[:1] in (b"\r", b"\n"):
                w.skip(1)
            sound = gap in (b"\r\n\r\n", b"\n\n") or not w.have(1) or (w.have(5) and w.buffer.startswith(b"WARC/"))
            yield row(size, raw + 4, fields, "ok" if sound else "malformed")
            offset, seq = offset + size, seq + 1
            if not sound:
                if inner >= 0:
                    w.back(inner)
                else:
                    w.seek_record()
    except (EOFError, zlib.error) as e:
        yield row(0, 0, {}, "truncated" if isinstance(e, EOFError) else "malformed")


def normalize_file(path: str, to: str, level: int = 6) -> Iterator[dict]:
    """Normalise one file into the folder ``to``; yields its index, which is also written beside the new file."""
    name = path.rstrip("/").rsplit("/", 1)[1]
    source_fs, source = _open(path)
    sink_fs, folder = _open(to)
    context = TaskContext.get()
    mine = f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"
    with sink_fs.open_output_stream(mine, compression=None) as b, sink_fs.open_output_stream(f"{mine}.idx", compression=None) as index:
        for row in rewrite(lambda: source_fs.open_input_stream(source, compression=None, buffer_size=CHUNK), b, name, level):
            index.write(json.dumps(row).encode() + b"\n")
            yield row
    for a, b in ((mine, f"{folder}/{name}"), (f"{mine}.idx", f"{folder}/{name}.idx")):
        if sink_fs.get_file_info(b).type != fs.FileType.NotFound:  # of an attempt before, which some file systems don't overwrite
            sink_fs.delete_file(b)
        sink_fs.move(a, b)


def normalize(paths: DataFrame, to: str, level: int = 6) -> DataFrame:
    """Index rows of all files of ``paths`` (path), normalised into the folder ``to``. A file is the unit of work."""
    sink_fs, folder = _open(to)
    sink_fs.create_dir(folder)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for row in normalize_file(path, to, level):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return paths.select("path").mapInArrow(run, INDEX)


def write_monolithic(pages: DataFrame, to: str, most: int = 32 << 20, level: int = 1) -> DataFrame:
    """Write pages as WARC files of about ``most`` raw bytes, each one gzip stream; their paths. Nothing is shuffled."""
    sink_fs, folder = _open(to)
    sink_fs.create_dir(folder)

    def run(batches):
        context, out, paths = TaskContext.get(), None, []

        def close():
            sink.write(out.flush())
            sink.close()
            sink_fs.move(mine, final)
            paths.append(f"{to}/{final.rsplit('/', 1)[1]}")

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    final = f"{folder}/part-{context.partitionId():06d}-{len(paths):04d}.warc.gz"
                    mine, out, size = f"{final}.{context.taskAttemptId()}", zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    sink = sink_fs.open_output_stream(mine, compression=None)
                raw = record(page_id, url, html)
                size += len(raw)
                sink.write(out.compress(raw))
                if size >= most:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string")


def normalized_pages(pages: DataFrame) -> DataFrame:
    """Index rows of the pages after they have gone through monolithic WARC files and the normaliser. Computed at once."""
    spark = pages.sparkSession
    raw, to = new_dir(spark, "warc-raw"), new_dir(spark, "warc")
    paths, at = materialize(write_monolithic(pages, raw), "warc-paths")
    n = paths.count()
    index, _ = materialize(normalize(paths.repartition(min(max(n, 1), 10_000), F.xxhash64("path")), to), "warc-index")
    drop_dir(spark, raw)
    drop_dir(spark, at)
    return index
