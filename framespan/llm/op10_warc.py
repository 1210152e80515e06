"""WARC archives: writing, normalising monolithic gzip files, and reading back through an offset index.

``write_monolithic`` writes each task's records into gzip files of one single stream, the form that offers no
random access. ``normalise`` inflates such a file once, from start to end, and writes every record as a
gzip member of its own together with a sidecar index of offsets; records that repeat an earlier payload
become revisit records on the way. ``read_indexed`` opens records by offset and checks their digests.

Payloads are written where their rows are, so no text is shuffled; what moves is a narrow table of digests.
A file is closed after ``FILE_BYTES`` of records and named after the task attempt; only files that a
finished task reports are used, so a lost executor leaves at most an unused file.

Defined results: a null html is an empty payload; a null url or page_id leaves out the header; among equal
payloads with the same largest page_id the first written is the response; a payload below ``MIN_REVISIT``
bytes is always a response; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespan.llm.common import cut, scratch
from framespan.operators.joins import attach

MIN_REVISIT = 1000
FILE_BYTES = 64_000_000
#: Tasks at most that archives are dealt to.
TASKS = 20_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Bytes read at once from an archive.
CHUNK = 1 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    return fs.makeQualified(where).toString()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit names its response and keeps only the payload's length and digest."""
    body = b"" if kind == "revisit" else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}:{kind}")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}\r\nPayload-Length: {len(payload)}")
    if refers_to is not None:
        head.append(f"Refers-To-Page-ID: {refers_to}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Type: text/html\r\nContent-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, a chunk at a time."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = engine.decompress(data)
            if out:
                yield out
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    rest = engine.flush()
    if rest:
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an inflated archive; holds one record and one chunk."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not need(looked + 1):
                raise ValueError("the archive ends inside a header")
        head = parse_head(bytes(held[:end]))
        size = int(head["Content-Length"])
        if not need(end + 4 + size + 4):
            raise ValueError("the archive ends inside a record")
        body = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]
        yield head, body


_WRITTEN = "file string, seq int, page_id long, payload_bytes long, digest string"


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task = TaskContext.get()
        number, out, engine, size, seq, rows = 0, None, None, 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.write(engine.flush())
                out.close()
                out = None

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                if out is None:
                    name = f"mono-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, engine, size, seq, number = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, number + 1
                digest = hashlib.sha1(payload).hexdigest()
                whole = record("response", page_id.as_py(), url.as_py(), payload, digest)
                out.write(engine.compress(whole))
                rows.append((name, seq, page_id.as_py(), len(payload), digest))
                seq, size = seq + 1, size + len(whole)
                if size >= file_bytes:
                    close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))] if rows else [pa.array([], k) for k in (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())], names=["file", "seq", "page_id", "payload_bytes", "digest"])
            rows = []
        close()

    return run


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; (file, seq, page_id, payload_bytes, digest) of each record."""
    plain = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return cut(plain.mapInArrow(_write(folder, file_bytes), _WRITTEN))


def per_file(files: DataFrame) -> DataFrame:
    """One task per archive, up to ``TASKS`` tasks: rows are names of a few bytes, from which Spark would otherwise make a single task."""
    return files.repartition(max(1, min(TASKS, files.count())))


def _normalise(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(source)
        out_fs, out_base = _open(target)
        for batch in batches:
            for name, seqs, refers in zip(*(batch.column(i) for i in range(3))):
                name = name.as_py()
                turned = dict(zip(seqs.as_py() or [], refers.as_py() or []))
                attempt = TaskContext.get().taskAttemptId()
                new, at, lines = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz", 0, []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as src, out_fs.open_output_stream(f"{out_base}/{new}", compression=None) as out:
                    for seq, (head, body) in enumerate(records(inflate(src))):
                        page = int(head["Page-ID"]) if "Page-ID" in head else None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = "revisit" if seq in turned else "response"
                        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = engine.compress(record(kind, page, head.get("WARC-Target-URI"), body, digest, turned.get(seq))) + engine.flush()
                        out.write(member)
                        lines.append(f"{at}\t{len(member)}\t{kind}\t{digest}\n")
                        at += len(member)
                with out_fs.open_output_stream(f"{out_base}/{new}.idx") as index:
                    index.write("".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([len(lines)], pa.int64())], names=["file", "n"])

    return run


def normalise(written: DataFrame, source: str, target: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rewrite the monolithic archives, one member per record, with sidecar indexes; (file, n) of each."""
    alike = written.where(F.col("payload_bytes") >= min_revisit).groupBy("digest", "payload_bytes")
    first = alike.agg(F.max(F.struct("page_id", (-F.col("seq")).alias("before"), "file")).alias("m"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "payload_bytes", F.col("m.page_id").alias("refers_to"), F.col("m.file").alias("_file"), (-F.col("m.before")).alias("_seq"))
    again = attach(written, first, ["digest", "payload_bytes"]).where("file <> _file or seq <> _seq")
    turned = again.groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("t"))
    files = written.select("file").distinct().join(turned, "file", "left")
    tasks = files.select("file", F.col("t.seq").alias("seqs"), F.col("t.refers_to").alias("refers"))
    return cut(per_file(tasks).mapInArrow(_normalise(source, target), "file string, n long"))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0):
                name = name.as_py()
                rows = []
                with fs.open_input_stream(f"{base}/{name}.idx") as index:
                    entries = [line.split("\t") for line in index.read().decode().splitlines()]
                with fs.open_input_file(f"{base}/{name}") as src:
                    for at, size, kind, digest in entries:
                        src.seek(int(at))
                        ((head, body),) = records(iter([zlib.decompress(src.read(int(size)), 31)]))
                        if head["WARC-Type"] != kind or (kind == "response" and hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{name} at {at}: the record does not match its index")
                        page = int(head["Page-ID"]) if "Page-ID" in head else None
                        refers = int(head["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in head else None
                        rows.append((page, int(head["Payload-Length"]), digest, kind, refers))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000]), kinds)], names=[x.split()[0] for x in _READ.split(", ")])

    return run


def read_indexed(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the normalised archives."""
    return per_file(files.select("file")).mapInArrow(_read(folder), _READ)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write, normalise and read back; the archives stay in ``folder``/normal."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    mono, normal = _qualified(spark, f"{folder}/mono"), _qualified(spark, f"{folder}/normal")
    written = write_monolithic(pages, mono, **columns)
    files = normalise(written, mono, normal)
    return read_indexed(files, normal)
