"""Token ids as length-delimited binary records, with an offset index beside them.

A file ``part-*.rec`` is a run of records

    length (u64) | masked checksum of the length (u32) | payload | masked checksum of the payload (u32)

all little-endian; the payload is document id (i64), flags (u8: 1 = the id is null,
2 = ids take four bytes), then the ids as u16, or as u32 where one needs it. Checksums
are CRC-32, rotated and offset so that a checksum over data holding checksums stays
meaningful. ``part-*.idx`` has for each record, and once more for the end, the place of
its first byte (u64) and the ids before it in its file (u64): with it a reader can take
any record, in any order, without reading the others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from panelmark.llm import files
from panelmark.llm.common import id_and_text, slices, small_batches
from panelmark.llm.tokens import default_path, encoder

#: Bytes after which a writer begins a new file, and that one read task takes at most (records are whole).
FILE_BYTES, READ_BYTES = 256 << 20, 8 << 20
#: Text bytes encoded together: the more, the fewer different fragments there are to look up.
ENCODE_BYTES = 4 << 20
#: Fixed value of the mask.
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def unframe(data: memoryview, at: int, verify: bool = True) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, place of the next record); a damaged record is an error."""
    length, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check or at + 16 + length > len(data):
        raise ValueError(f"damaged length of the record at byte {at}")
    payload = data[at + 12 : at + 12 + length]
    if verify and masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"damaged payload of the record at byte {at}")
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload[9:], "<u4" if flags & 2 else "<u2").astype("<u4"), at + 16 + length


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.tokenizer, self.end_id = options["path"], options["tokenizer"], options.get("end_id")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, model, done = TaskContext.get().partitionId(), encoder(self.tokenizer), []
        store, root = files.opened(self.folder)
        end = np.array([] if self.end_id is None else [int(self.end_id)], "<u4")
        out, name, index, place, tokens = None, "", [], 0, 0

        def close():
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as file:
                file.write(np.array([*index, (place, tokens)], "<u8").tobytes())
            done.append({"part": part, "turn": len(done), "name": name, "docs": len(index), "tokens": tokens, "bytes": place})

        for batch in iterator:
            keys = batch.column(0).to_pylist()
            for low, _high, data, offsets in slices(batch.column(1), ENCODE_BYTES):
                for k, raw in enumerate(model.encode(data, offsets), low):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}"
                        out, index, place, tokens = store.open_output_stream(f"{root}/{name}.rec"), [], 0, 0
                    ids = np.concatenate([np.frombuffer(raw, "<u4"), end])
                    record = frame(keys[k], ids)
                    out.write(record)
                    index.append((place, tokens))
                    place, tokens = place + len(record), tokens + len(ids)
                    if place >= FILE_BYTES:
                        close()
                        out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        found = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["part"], f["turn"]))
        start = 0
        for entry in found:
            entry["start"] = start
            start += entry["tokens"]
        files.write_manifest(self.folder, found)

    def abort(self, messages) -> None:
        files.remove(self.folder, [f["name"] + end for m in messages if m for f in m.files for end in (".rec", ".idx")])


@dataclass
class Run(InputPartition):
    name: str
    first: int
    last: int
    start: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        runs = []
        for f in files.read_manifest(self.folder) or []:
            step = max(1, f["docs"] * READ_BYTES // max(1, f["bytes"]))
            runs += [Run(f["name"], k, min(k + step, f["docs"]), f["start"]) for k in range(0, f["docs"], step)]
        return runs or [Run("", 0, 0, 0)]

    def read(self, run: Run):
        if run.first == run.last:
            return
        store, root = files.opened(self.folder)
        with store.open_input_file(f"{root}/{run.name}.idx") as file:
            file.seek(run.first * 16)
            index = np.frombuffer(file.read((run.last - run.first + 1) * 16), "<u8").reshape(-1, 2).astype(np.int64)
        with store.open_input_file(f"{root}/{run.name}.rec") as file:
            for low in range(0, len(index) - 1, 500):
                high = min(low + 500, len(index) - 1)
                file.seek(int(index[low, 0]))
                data, rows = memoryview(file.read(int(index[high, 0] - index[low, 0]))), []
                for k in range(low, high):
                    doc_id, ids, _ = unframe(data, int(index[k, 0] - index[low, 0]))
                    rows.append((doc_id, run.start + int(index[k, 1]), len(ids), ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """Reads (id, start, n_tokens, ids: little-endian u32); writes (id, text)."""

    @classmethod
    def name(cls):
        return "token_records"

    def schema(self):
        return "id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_records(df: DataFrame, id_col: str, text_col: str, folder: str, end_id: int | None = None, path: str | None = None) -> None:
    """Encode whole texts and write them in ascending id order.

    Rows are dealt out by ranges of (id, text hash), sorted in each task and written by
    it, so that files follow each other in order; rows with a null id come first, and
    rows repeated under one id stand in the order of their texts' hashes. A null text
    has no ids but the end id. Other columns are not read; no rows give no files.
    """
    spark = df.sparkSession
    small_batches(spark)
    spark.dataSource.register(TokenRecords)
    rows = id_and_text(df, id_col, text_col)
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format("token_records").mode("append")
    if end_id is not None:
        writer = writer.option("end_id", str(end_id))
    writer.option("tokenizer", path or default_path()).save(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    small_batches(spark)
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(folder)
