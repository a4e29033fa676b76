"""Repeated passages by difference-cover anchors that are extended along diagonals.

Of the places of a document only those are hashed whose number modulo ``PERIOD`` is in
``COVER``. Every two places have, within the next ``PERIOD`` ones, a common step that takes both
into the cover, so two equal windows of ``window`` words share an aligned anchor of
``window - PERIOD + 1`` words. The work is one chain of four steps:

1. Anchors go to buckets of their hash. The first place of an anchor that has several is told to
   all of them.
2. In its document, anchors whose first places lie on one diagonal overlap and are extended to
   runs; a window inside a run is a copy of an earlier one and is settled. Windows around other
   repeated anchors (ends of runs, first copies, passages that go on like a later copy) are left.
3. The windows left go, by two hashes of all their words, to buckets again: those that have an
   earlier place are copies too. An earliest window is never settled in step 2, so it is there.
4. Words covered by a copied window are taken out.

Equal hashes are one place for each task's batch before anything is shuffled, so a passage
with a third of all rows costs a bucket one place a batch, and pairs of copies are never
listed. Anchors travel packed, thousands in a row; the texts are shuffled once, to meet what was
found for them, and both meetings read that one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import byte_view, slices, small_batches
from panelmark.llm.wordscan import scramble, span_prints, word_spans

#: A perfect difference cover: every number below 7 is a difference of two of these modulo 7.
PERIOD, COVER = 7, (0, 1, 3)
#: Places that a bucket holds, about; text bytes to one of them.
BUCKET, BYTES_A_PLACE = 1_000_000, 14
#: The id that null counts as: the largest.
NO_ID = (1 << 63) - 1
_MIX = [int(x) * 2 + 1 for x in np.random.default_rng(13).integers(1, 2**62, 8)]
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Packed places of one bucket, or (without payload) what is known of places of one document.
PARCEL = "bucket int, payload binary, idn long, mark int, places array<int>, first_idn long, first_mark int, shift long"
_PARCEL = pa.schema([
    ("bucket", pa.int32()), ("payload", pa.binary()), ("idn", pa.int64()), ("mark", pa.int32()), ("places", pa.list_(pa.int32())),
    ("first_idn", pa.int64()), ("first_mark", pa.int32()), ("shift", pa.int64()),
])


def window_prints(prints: np.ndarray, first: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Fingerprints of the ``width`` words from each of ``first`` on."""
    total = np.full(len(first), salt, np.uint64)
    for k in range(width):
        total = (total ^ prints[first + k]) * np.uint64(_MIX[(salt + k) % 8]) + np.uint64(k + 1)
    return scramble(total)


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows differ from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Places:
    """Places of windows: (hash, other hash, id, mark of the text, number of the first word, seen elsewhere)."""

    NAMES = ("key", "more", "idn", "mark", "at", "many")
    KINDS = ("<u8", "<u8", "<i8", "<i4", "<i4", "u1")

    def __init__(self, *columns: np.ndarray):
        self.key, self.more, self.idn, self.mark, self.at, self.many = columns

    def take(self, rows: np.ndarray) -> Places:
        return Places(*(getattr(self, n)[rows] for n in self.NAMES))

    def packed(self, whole: bool) -> bytes:
        """In the order of documents, so that all but the hashes are small differences; ``whole`` keeps both hashes."""
        near = [np.diff(getattr(self, n), prepend=getattr(self, n).dtype.type(0)) for n in ("idn", "mark", "at")]
        small = b"".join(x.tobytes() for x in [*near, self.many])
        hashes = self.key.tobytes() + (self.more.tobytes() if whole else b"")
        return len(self.key).to_bytes(4, "little") + hashes + pa.compress(small, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, payloads: list[bytes], whole: bool) -> Places:
        columns = [[] for _ in cls.NAMES]
        for payload in payloads:
            n = int.from_bytes(payload[:4], "little")
            hashes = 4 + (16 if whole else 8) * n
            columns[0].append(np.frombuffer(payload, "<u8", n, 4))
            columns[1].append(np.frombuffer(payload, "<u8", n, 4 + 8 * n) if whole else np.zeros(n, np.uint64))
            small, at = pa.decompress(payload[hashes:], 17 * n, codec="zstd", asbytes=True), 0
            for k, kind in enumerate(cls.KINDS[2:], 2):
                part = np.frombuffer(small, kind, n, at)
                columns[k].append(part if kind == "u1" else np.cumsum(part, dtype=part.dtype))
                at += part.nbytes
        return cls(*(np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, cls.KINDS)))

    def gathered(self) -> tuple[Places, np.ndarray]:
        """Sorted by hashes and then by place, each place once; and the row of the first of each one's hashes."""
        out = self.take(np.lexsort((-self.many.astype(np.int8), self.mark, self.at, self.idn, self.more, self.key)))
        out = out.take(_starts([out.key, out.more, out.idn, out.at, out.mark]))
        firsts = _starts([out.key, out.more])
        return out, np.repeat(firsts, np.diff(np.append(firsts, len(out.key))))

    def replies(self, first: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
        """What is known of some rows: the first place of their hashes if that is earlier; else that they are repeated."""
        to = first[rows]
        idn, mark, at = self.idn[rows], self.mark[rows], self.at[rows]
        earlier = (self.idn[to] < idn) | ((self.idn[to] == idn) & (self.at[to] < at))
        of = [np.where(earlier, x[to], 0) for x in (self.idn, self.mark)]
        shift = np.where(earlier, at.astype(np.int64) - self.at[to], 0)
        order = np.lexsort((at, shift, of[1], of[0], ~earlier, mark, idn))
        idn, mark, at, earlier, shift, of = idn[order], mark[order], at[order], earlier[order], shift[order], [x[order] for x in of]
        cuts = _starts([idn, mark, earlier, *of, shift])
        no = ~earlier[cuts]
        return _known(
            idn[cuts], mark[cuts], pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)), pa.int32()), pa.array(at, pa.int32())), buckets,
            pa.array(of[0][cuts], pa.int64(), mask=no), pa.array(of[1][cuts], pa.int32(), mask=no), pa.array(shift[cuts], pa.int64(), mask=no),
        )

    def copies(self, first: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
        """Runs (first, last) of the places among some rows that have an earlier one."""
        to = first[rows]
        idn, at = self.idn[rows], self.at[rows]
        rows = rows[(self.idn[to] < idn) | ((self.idn[to] == idn) & (self.at[to] < at))]
        order = np.lexsort((self.at[rows], self.mark[rows], self.idn[rows]))
        idn, mark, at = (x[rows][order] for x in (self.idn, self.mark, self.at))
        return _runs(idn, mark, at, buckets)


def _known(idn: np.ndarray, mark: np.ndarray, places: pa.ListArray, buckets: int, *first: pa.Array) -> pa.RecordBatch:
    n = len(idn)
    first = first or tuple(pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64()))
    spread = (idn.astype(np.uint64) % np.uint64(buckets)).astype(np.int32)  # on its way these rows ride along in any bucket
    return pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(n, pa.binary()), pa.array(idn, pa.int64()), pa.array(mark, pa.int32()), places, *first], schema=_PARCEL)


def _runs(idn: np.ndarray, mark: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a document with the ends of its runs of neighbouring places; rows come sorted."""
    document = _starts([idn, mark])
    group = np.zeros(len(at), np.int64)
    group[document] = 1
    first = _starts([np.cumsum(group), at.astype(np.int64) - np.arange(len(at))])
    last = np.append(first[1:], len(at))[: len(first)] - 1
    ends = np.stack([at[first], at[last]], axis=1).ravel()
    offsets = 2 * np.searchsorted(first, np.append(document, len(at)))
    return _known(idn[document], mark[document], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int32())), buckets)


def _sent(places: Places, buckets: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The first place of each hash of a batch, packed by bucket, and what the batch knows of the others."""
    sorted_, first = places.gathered()
    own = np.arange(len(first))
    firsts, others = own[first == own], own[first != own]
    if len(others):
        sorted_.many[first[others]] = 1
        yield sorted_.copies(first, others, buckets) if whole else sorted_.replies(first, others, buckets)
    sent = sorted_.take(firsts)
    bucket = ((sent.key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((sent.at, sent.mark, sent.idn, bucket))
    sent, bucket = sent.take(order), bucket[order]
    cuts = _starts([bucket])
    payloads = [sent.take(np.arange(a, b)).packed(whole) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
    n = len(payloads)
    rest = [pa.nulls(n, f.type) for f in list(_PARCEL)[2:]]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(payloads, pa.binary()), *rest], schema=_PARCEL)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word fingerprints, row of each, place of each row's first word and the end)."""
    for low, high, data, offsets in slices(batch.column("text")):
        starts, ends, rows = word_spans(data, offsets)
        yield low, high, span_prints(data, starts, ends), rows, np.searchsorted(rows, np.arange(high - low + 1))


def _joined(parts: list[tuple[np.ndarray, ...]]) -> Places:
    return Places(*(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(zip(*parts) if parts else [[]] * 6, Places.KINDS)))


def _anchors(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    width = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idn, mark, parts = batch.column("idn").to_numpy(), batch.column("mark").to_numpy(), []
            for low, _high, prints, of, begin in _words(batch):
                place, size = np.arange(len(of)) - begin[of], (begin[1:] - begin[:-1])[of]
                first = np.flatnonzero(_COVERED[place % PERIOD] & (place + width <= size) & (size >= window))
                row = of[first] + low
                parts.append((window_prints(prints, first, width, 0), np.zeros(len(first), np.uint64), idn[row], mark[row], place[first].astype(np.int32), np.zeros(len(first), np.uint8)))
            yield from _sent(_joined(parts), buckets, whole=False)

    return rows.mapInArrow(run, PARCEL)


def _met(parcels: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """(idn, mark, found): all that the buckets tell of the places of a document."""

    def run(table: pa.Table) -> pa.Table:
        passing = table.filter(pc.is_null(table.column("payload")))
        places, first = Places.unpacked([x.as_py() for x in table.column("payload") if x.is_valid], whole).gathered()
        own = np.arange(len(first))
        shared = np.bincount(first, minlength=len(first))[first] > 1
        rows = own[shared | (places.many > 0)]
        told = places.copies(first, rows, buckets) if whole else places.replies(first, rows, buckets)
        return pa.concat_tables([passing.cast(_PARCEL), pa.Table.from_batches([told])])

    found = parcels.groupBy("bucket").applyInArrow(run, PARCEL)
    what = F.col("places") if whole else F.struct("places", "first_idn", "first_mark", "shift")
    return found.groupBy("idn", "mark").agg(F.collect_list(what).alias("found"))


def _extended(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Runs along diagonals as known copies; the windows they leave, packed."""
    width = window - PERIOD + 1

    def spans(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        """Which of n places lie in any of the spans low to high (inclusive; an empty one has high < low)."""
        some = low <= high
        return np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(high[some] + 1, minlength=n + 1))[:n] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idn, mark, parts, done = batch.column("idn").to_numpy(), batch.column("mark").to_numpy(), [], []
            found = batch.column("found")
            told = found.flatten()
            row_of = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            lists = told.field("places")
            sizes = lists.value_lengths().to_numpy()
            at, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(row_of, sizes)
            earlier = np.repeat(told.field("shift").is_valid().to_numpy(zero_copy_only=False), sizes)
            keys = [np.repeat(told.field(c).fill_null(0).to_numpy(), sizes) for c in ("first_idn", "first_mark", "shift")]
            order = np.lexsort((at, *keys[::-1], row))
            order = order[earlier[order]]
            chain, one = [row[order], *(k[order] for k in keys)], at[order]
            cuts = _starts([*chain, np.cumsum(np.diff(one, prepend=0) > width)]) if len(one) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(one))[: len(cuts)] - 1
            run_row, run_low, run_high = row[order][cuts], one[cuts], one[ends] - (PERIOD - 1)
            for low, high, prints, of, begin in _words(batch):
                n, size = len(of), begin[1:] - begin[:-1]
                here = (row >= low) & (row < high)
                base = begin[row[here] - low]
                open_ = spans(base + np.maximum(at[here] - (PERIOD - 1), 0), base + np.minimum(at[here], size[row[here] - low] - window), n)
                here = (run_row >= low) & (run_row < high)
                base = begin[run_row[here] - low]
                settled = spans(base + run_low[here], base + run_high[here], n)
                place = np.flatnonzero(settled)
                if len(place):
                    of_place = of[place] + low
                    done.append((idn[of_place], mark[of_place], place - begin[of[place]]))
                first = np.flatnonzero(open_ & ~settled)
                of_first = of[first] + low
                hashes = [window_prints(prints, first, window, salt) for salt in (1, 2)]
                parts.append((*hashes, idn[of_first], mark[of_first], (first - begin[of[first]]).astype(np.int32), np.zeros(len(first), np.uint8)))
            if done:
                idns, marks, places = (np.concatenate(x) for x in zip(*done))
                order = np.lexsort((places, marks, idns))
                fresh = _starts([idns[order], marks[order], places[order]])
                yield _runs(*(x[order][fresh] for x in (idns, marks, places)), buckets)
            yield from _sent(_joined(parts), buckets, whole=True)

    return rows.mapInArrow(run, PARCEL)


def _kept(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            view, sizes, gone, texts = memoryview(data), [], [], []
            for found, a, b in zip(batch.column("found"), offsets.tolist(), offsets[1:].tolist()):
                words = bytes(view[a:b]).split()
                sizes.append(len(words))
                if found.is_valid and len(found):
                    ends = found.values.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, ends[:, 0], 1)
                    np.add.at(edge, ends[:, 1] + window, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    words = list(compress(words, stays.tolist()))
                gone.append(sizes[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")


def without_repeats(df: DataFrame, id_col: str, text_col: str, window: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text), one row for each row of ``df``.

    A word goes if any ``window`` consecutive words around it also start earlier: under a
    smaller id (null counts as the largest), or under the same id further ahead. All windows are
    judged on the texts as they come. Kept words are joined by one space. Rows with one id
    are one document in this order: neither of two rows with the same id and text is earlier
    than the other, so both stay. Null and empty texts have no words; texts shorter than ``window`` stay whole.
    """
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has {2 * PERIOD - 1} words at least")
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    rows = df.select(id_.alias("id"), F.coalesce(id_, F.lit(NO_ID)).alias("idn"), F.hash(text).alias("mark"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(size // (BUCKET * BYTES_A_PLACE) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchors = _met(_anchors(rows.select("idn", "mark", "text"), window, buckets), buckets, whole=False)
    # both joins ask the same columns of the texts, so that Spark shuffles them once
    met = rows.join(anchors, ["idn", "mark"]).select("id", "idn", "mark", "text", "found")
    copies = _met(_extended(met, window, buckets), buckets, whole=True)
    return _kept(rows.join(copies, ["idn", "mark"], "left").select("id", "idn", "mark", "text", "found"), window)
