"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window.

A document's ids (with the end id) first fill whole windows of its own; what is left,
its tail, is packed with other tails. Document frequencies of all ids over all documents
are summed up first (at most one number for each id of the vocabulary). Tails are sorted by
their two ids of highest BM25 weight, so that tails sharing telling ids lie together, and
dealt out by ranges of that order. Each task walks its range in shards of bounded size,
builds an inverted index (id -> tails, BM25 weights) of the shard, and takes the first
unused tail as the seed: its unused neighbours, best score first, fill the window; the
last one taken is cut, and its rest stays unused. A window that a shard can't fill goes on
to the next shard; at the end of a range it is cut into sequences whose lengths are
powers of two, which need no padding. So no sequence is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import id_and_text, slices, small_batches, staged
from panelmark.llm.tokens import default_path, encoder

#: Ids of one shard, BM25's two parameters, and the most common share of documents an id may be in to count.
SHARD_IDS, K1, B, COMMON = 1 << 18, 1.2, 0.75, 0.5

_PIECES = "kind int, id long, start long, length long, crc long, doc_tokens long, sequence long, ids binary, terms array<int>, counts array<long>"
_PACKED = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_FULL, _TAIL, _COUNTS = 0, 1, 2


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as u16 where they fit, else as u32; an odd last byte says which."""
    small = not len(ids) or int(ids.max()) <= 0xFFFF
    return ids.astype("<u2" if small else "<u4").tobytes() + (b"" if small else b"\x00")


def _wide(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw[:-1], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2")).astype("<u4")


def _rows(names_types: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in names_types.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _cut_documents(df: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Full windows (with their sequence), tails (with their ids), and each task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        frequency, seen = np.zeros(len(model.pieces), np.int64), np.zeros(len(model.pieces), bool)
        sequence, documents, tails, tail_ids = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            keys = batch.column("id").to_pylist()
            for low, _high, data, offsets in slices(batch.column("text")):
                rows = []
                for k, raw in enumerate(model.encode(data, offsets), low):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                    seen[ids] = True
                    distinct = np.flatnonzero(seen)
                    frequency[distinct] += 1
                    seen[distinct] = False
                    documents += 1
                    at = 0
                    for at in range(window, len(ids) + 1, window):
                        part = ids[at - window : at]
                        rows.append((_FULL, keys[k], at - window, window, zlib.crc32(part), len(ids), 2 * sequence, part.tobytes() if with_ids else None, None, None))
                        sequence += 1
                    if at < len(ids):
                        rows.append((_TAIL, keys[k], at, len(ids) - at, None, len(ids), None, _narrow(ids[at:]), None, None))
                        tails, tail_ids = tails + 1, tail_ids + len(ids) - at
                yield _rows(_PIECES, rows)
        found = np.flatnonzero(frequency)
        yield _rows(_PIECES, [(_COUNTS, documents, tails, tail_ids, None, None, None, None, found.tolist(), frequency[found].tolist())])

    return df.mapInArrow(run, _PIECES)


class Weights:
    """Corpus statistics of BM25."""

    def __init__(self, size: int, terms, counts, documents: int, tails: int, tail_ids: int):
        frequency = np.zeros(size, np.float64)
        frequency[np.asarray(terms, np.int64)] = counts
        self.idf = np.log((documents - frequency + 0.5) / (frequency + 0.5))
        self.idf[frequency > COMMON * documents] = 0  # and below: such ids tell nothing
        self.idf = np.maximum(self.idf, 0).astype(np.float32)
        self.shared = frequency > 1
        self.mean = tail_ids / max(1, tails)

    def of(self, terms: np.ndarray, times: np.ndarray, lengths) -> np.ndarray:
        return self.idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / self.mean))


def _route(df: DataFrame, weights: Weights) -> DataFrame:
    """Adds the two ids of highest weight that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for raw in batch.column("ids"):
                terms, times = np.unique(_wide(raw.as_py()), return_counts=True)
                weight = weights.of(terms, times, times.sum()) * weights.shared[terms]
                best = np.argsort(-weight, kind="stable")[:2]
                first.append(int(terms[best[0]]))
                second.append(int(terms[best[-1]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], [*batch.schema.names, "first", "second"]
            )

    return df.mapInArrow(run, "id long, start long, doc_tokens long, ids binary, first int, second int")


class _Shard:
    """An inverted index over some tails, and what is left of each of them."""

    def __init__(self, tails: list[tuple], weights: Weights):
        self.tails, self.left = tails, np.array([len(t[3]) for t in tails], np.int64)
        self.taken = np.zeros(len(tails), np.int64)
        n = len(tails)
        unit = np.repeat(np.arange(n), self.left)
        pairs, times = np.unique(np.concatenate([t[3] for t in tails]).astype(np.int64) * n + unit, return_counts=True)
        terms, unit = np.divmod(pairs, n)
        weight = weights.of(terms, times, self.left[unit])
        told = weight > 0
        self.terms, self.unit, self.weight = terms[told], unit[told], weight[told]
        by_unit = np.argsort(self.unit, kind="stable")
        self.own = self.terms[by_unit]  # the terms of each tail in turn
        self.own_at = np.searchsorted(self.unit[by_unit], np.arange(n + 1))
        starts = np.flatnonzero(np.diff(self.terms, prepend=-1))
        self.at = dict(zip(self.terms[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(self.terms)])))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused tails by falling score for the seed's ids; those that share none come last, in the order of the range."""
        score = np.zeros(len(self.tails))
        places = [self.at[t] for t in self.own[self.own_at[seed] : self.own_at[seed + 1]].tolist()]
        if places:
            units = np.concatenate([self.unit[a:b] for a, b in places])
            score = np.bincount(units, np.concatenate([self.weight[a:b] for a, b in places]), len(self.tails))
        order = np.argsort(-score, kind="stable")
        return order[(self.left[order] > 0) & (order != seed)]

    def take(self, unit: int, room: int) -> tuple:
        """The next ``room`` ids of a tail, or all it has."""
        doc_id, start, tokens, ids = self.tails[unit]
        a = int(self.taken[unit])
        n = min(room, int(self.left[unit]))
        self.taken[unit] += n
        self.left[unit] -= n
        return doc_id, start + a, tokens, ids[a : a + n]

    def windows(self, size: int) -> Iterator[list[tuple]]:
        """Lists of parts that fill a window; the last one may not."""
        for seed in range(len(self.tails)):
            while self.left[seed]:
                parts = [self.take(seed, size)]
                room = size - len(parts[0][3])
                if room:
                    for unit in self.neighbours(seed).tolist():
                        parts.append(self.take(unit, room))
                        room -= len(parts[-1][3])
                        if not room:
                            break
                yield parts


def _powers(parts: list[tuple]) -> Iterator[list[tuple]]:
    """Parts cut into sequences whose lengths are the powers of two in their sum."""
    total = sum(len(p[3]) for p in parts)
    queue = list(reversed(parts))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, out = 1 << bit, []
        while room:
            doc_id, start, tokens, ids = queue.pop()
            out.append((doc_id, start, tokens, ids[:room]))
            if len(ids) > room:
                queue.append((doc_id, start + room, tokens, ids[room:]))
            room -= len(out[-1][3])
        yield out


def _pack(df: DataFrame, weights: Weights, window: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held, size, carried = TaskContext.get().partitionId() << 32, [], 0, []

        def rows(sequences: list[list[tuple]]) -> list[tuple]:
            nonlocal sequence
            out = []
            for parts in sequences:
                offset = 0
                for doc_id, start, tokens, ids in parts:
                    out.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), tokens, 2 * sequence + 1, offset, ids.tobytes() if with_ids else None))
                    offset += len(ids)
                sequence += 1
            return out

        def shard() -> list[list[tuple]]:
            """The full windows of what is held; the rest is carried on."""
            found = list(_Shard([*carried, *held], weights).windows(window)) if carried or held else []
            carried[:] = found.pop() if found and sum(len(p[3]) for p in found[-1]) < window else []
            held.clear()
            return found

        for batch in batches:
            for doc_id, start, tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "start", "doc_tokens", "ids"))):
                held.append((doc_id, start, tokens, _wide(raw)))
                size += len(held[-1][3])
                if size >= SHARD_IDS:
                    yield _rows(_PACKED, rows(shard()))
                    size = 0
        last = rows([*shard(), *_powers(carried)])
        if last:
            yield _rows(_PACKED, last)

    return df.mapInArrow(run, _PACKED)


def packed(df: DataFrame, id_col: str, text_col: str, window: int = 1024, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row a piece.

    Each id of each document lies in exactly one piece; ``offset`` is the piece's place in
    its sequence. Sequences have ``window`` ids, or a smaller power of two. ``ids``
    (little-endian u32) is filled with ``with_ids``. A null text counts as empty and gives
    the end id alone; null and repeated ids are documents of their own; equal texts lie
    next to each other in the order of ids, over as many ranges as they need; other columns
    are not read; no rows give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = path or default_path()
    cut = staged(_cut_documents(id_and_text(df, id_col, text_col), path, window, end_id, with_ids), "packing-cut")
    counts = cut.filter(F.col("kind") == _COUNTS)
    sums = counts.agg(F.sum("id").alias("documents"), F.sum("start").alias("tails"), F.sum("length").alias("tail_ids")).first()
    each = counts.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    frequency = each.collect()  # a row for each id of the vocabulary at most
    weights = Weights(len(encoder(path).pieces), [r[0] for r in frequency], [r[1] for r in frequency], sums["documents"] or 0, sums["tails"] or 0, sums["tail_ids"] or 0)
    tails = _route(cut.filter(F.col("kind") == _TAIL).select("id", "start", "doc_tokens", "ids"), weights)
    order = ["first", "second", F.asc_nulls_first("id"), "start", F.xxhash64("ids")]
    ordered = tails.repartitionByRange(*order).sortWithinPartitions(*order)
    filled = _pack(ordered, weights, window, with_ids)
    full = cut.filter(F.col("kind") == _FULL).select(
        "id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    return full.unionByName(filled)
