"""WARC archives as a Spark data source, and payload deduplication by revisit records.

Writing: one gzip member a record, so that any record can be read alone; beside each
``*.warc.gz`` a ``*.idx`` with the place of every member (u64 each, and the end).

Reading: runs of members are planned as partitions from the index (a file without one is
a partition of its own, and its members are found by inflating it once). Equality, IN and prefix filters on
header columns are pushed down. A member is inflated only as far as its headers; the rest is
inflated only if the record passes the filters and the payload is asked for (option
``payload``, true by default).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from panelmark.llm import files
from panelmark.llm.common import small_batches, staged

#: Bytes after which a writer begins a new file; compressed bytes of one read partition; level of gzip.
FILE_BYTES, READ_BYTES, LEVEL = 256 << 20, 4 << 20, 1
#: Payloads below this size are never revisited.
LEAST_SHARED = 100
#: Payload bytes after which a reader or writer passes on what it has.
CHUNK_BYTES = 8 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
COLUMNS = "record_type string, record_id string, page_id long, target_uri string, warc_date string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_HEADER_COLUMNS = {"record_type", "record_id", "page_id", "target_uri", "warc_date", "payload_digest", "refers_to"}


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


class _Member:
    """One gzip member, inflated step by step."""

    def __init__(self, data: bytes):
        self.engine, self.rest, self.seen = zlib.decompressobj(31), data, b""

    def until(self, mark: bytes, start: int = 0) -> int:
        """The place after ``mark``, or -1; inflates no further than needed."""
        while (at := self.seen.find(mark, start)) < 0:
            if self.engine.eof or not self.rest:
                return -1
            self.seen += self.engine.decompress(self.rest, 512)
            self.rest = self.engine.unconsumed_tail
        return at + len(mark)

    def upto(self, size: int) -> bytes:
        if len(self.seen) < size:
            self.seen += self.engine.decompress(self.rest, size - len(self.seen))
            self.rest = self.engine.unconsumed_tail
        return self.seen[:size]


def parse(data: bytes, wanted, payload: bool) -> tuple | None:
    """A row of COLUMNS from one member, or None if its headers fail ``wanted``."""
    member = _Member(data)
    body = member.until(b"\r\n\r\n")
    if body < 0 or not member.seen.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    head = _fields(member.seen[:body])
    digest = head.get("warc-payload-digest")
    row = {
        "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "page_id": _id_of(head.get("warc-record-id")),
        "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"),
        "payload_digest": digest.partition(":")[2] if digest else None, "refers_to": _id_of(head.get("warc-refers-to")),
    }
    if not wanted(row):
        return None
    inner, size, content = body, int(head.get("content-length", 0)), None
    if head.get("content-type", "").startswith("application/http"):
        at = member.until(b"\r\n\r\n", body)
        if at >= 0:
            inner, size = at, int(_fields(member.seen[body:at]).get("content-length", body + size - at))
    if payload and row["record_type"] != "revisit":
        content = member.upto(body + int(head.get("content-length", 0)))[inner:]
    return (*(row[c] for c in ("record_type", "record_id", "page_id", "target_uri", "warc_date", "payload_digest")), size, row["refers_to"], content)


def member_places(file) -> list[int]:
    """Where each gzip member begins, and the end, found by inflating the file once."""
    places, at, engine = [], 0, None
    data = file.read(1 << 20)
    while data:
        if engine is None:
            places.append(at)
            engine = zlib.decompressobj(31)
        engine.decompress(data)
        left = engine.unused_data
        at += len(data) - len(left)
        if engine.eof:
            engine, data = None, left or file.read(1 << 20)
        else:
            data = file.read(1 << 20)
    return [*places, at]


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = files.opened(self.folder)
        part, done, out, name, places = TaskContext.get().partitionId(), [], None, "", [0]

        def close():
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as file:
                file.write(np.array(places, "<u8").tobytes())
            done.append({"name": f"{name}.warc.gz", "records": len(places) - 1, "bytes": places[-1]})

        for batch in iterator:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "payload_bytes", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to = (c[k].as_py() for c in columns)
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}"
                    out, places = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None), [0]
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(page_id, url, (html or "").encode(), digest, size, refers_to)
                member = engine.compress(raw) + engine.flush()
                out.write(member)
                places.append(places[-1] + len(member))
                if places[-1] >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        files.write_manifest(self.folder, sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"]))

    def abort(self, messages) -> None:
        names = [f["name"] for m in messages if m for f in m.files]
        files.remove(self.folder, [*names, *(n.replace(".warc.gz", ".idx") for n in names)])


@dataclass
class Run(InputPartition):
    name: str
    first: int
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.equal: list[tuple[str, set]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in _HEADER_COLUMNS:
                self.equal.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and f.attribute[0] in _HEADER_COLUMNS:
                self.equal.append((f.attribute[0], set(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute[0] in _HEADER_COLUMNS:
                self.prefix.append((f.attribute[0], f.value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is not None and row[c] in values for c, values in self.equal) and all(
            row[c] is not None and row[c].startswith(p) for c, p in self.prefix
        )

    def partitions(self):
        found = files.read_manifest(self.folder)
        if found is None:  # archives of other writers
            store, root = files.opened(self.folder)
            infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            runs = [Run(x.base_name, 0, None) for x in infos if x.base_name.endswith(".warc.gz")]
        else:
            runs = []
            for f in found:
                step = max(1, f["records"] * READ_BYTES // max(1, f["bytes"]))
                runs += [Run(f["name"], k, min(k + step, f["records"])) for k in range(0, f["records"], step)]
        return runs or [Run("", 0, 0)]

    def read(self, run: Run):
        if run.last == run.first:
            return
        store, root = files.opened(self.folder)
        if run.last is None:
            with store.open_input_stream(f"{root}/{run.name}", compression=None) as file:
                places = member_places(file)
        else:
            with store.open_input_file(f"{root}/{run.name.replace('.warc.gz', '.idx')}") as file:
                file.seek(run.first * 8)
                places = np.frombuffer(file.read((run.last - run.first + 1) * 8), "<u8").tolist()
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        with store.open_input_file(f"{root}/{run.name}") as file:
            for start, end in zip(places, places[1:]):
                file.seek(start)
                row = parse(file.read(end - start), self._wanted, self.payload)
                if row is None:
                    continue
                rows.append(row)
                held += len(row[-1] or b"")
                if held >= CHUNK_BYTES or len(rows) >= 2000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, payload_bytes, refers_to): which page holds each payload.

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more, that with the smallest
    id keeps it (``refers_to`` null), the others refer to it. First ids are found with
    partial minima; a payload that very many pages share is a hot key only of the join
    back, which Spark splits. A null payload is empty. Rows without an id refer to the
    first id but are never referred to; where no copy has an id, or under a repeated
    first id, each row keeps its payload.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha2(F.encode(html, "utf-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    firsts = (
        rows.filter(F.col("payload_bytes") >= LEAST_SHARED)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and first_id is not null").drop("copies")
    )
    firsts = staged(firsts, "warc-firsts")  # a side read as it lies lets Spark split a hot payload of the other
    later = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", "payload_bytes", F.when(later, F.col("first_id")).alias("refers_to")
    )


def write_warc(rows: DataFrame, folder: str) -> None:
    """Write the rows of ``with_revisits`` as archives in ``folder``; no rows, no archive."""
    small_batches(rows.sparkSession)
    rows.sparkSession.dataSource.register(Warc)
    plain = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    plain.write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of all archives in ``folder``; filters on header columns reach the source."""
    small_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
