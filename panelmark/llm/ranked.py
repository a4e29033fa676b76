"""Ranked lexical search over a document-partitioned index, bounded by range maxima.

A shard is one row: the ids and lengths of a run of documents and a posting list for each
of their terms. Over the impacts of its posting lists a shard has a sparse table, which
tells the largest impact of a term among any interval of documents with two look-ups.
An item begins with all documents of a shard as one interval, whose bound is the sum of its terms'
range maxima. The intervals with the best bounds come first: each is split at the document
with its largest impact, which is scored, and the rest left and right of it gets bounds of its own.
What cannot beat the ten best scores so far is never looked into. Many intervals are
taken at a time, so that the look-ups are few numpy calls; short ones are scored whole.

Shards are built by the tasks that read the documents, of bounded size, and never
shuffled; only document frequencies and the best of each shard are. Items are served in
blocks with a bounded number of terms.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import byte_view, small_batches, staged

#: A shard is closed when it holds so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 1 << 16
#: Terms of the items that one pass over the shards serves.
BLOCK_TERMS = 200_000
#: With no more different terms than this the index leaves out all others.
VOCABULARY = 200_000
#: Look-ups (terms times intervals) of one step, and documents of an interval that is scored whole.
STEP, WHOLE = 1 << 14, 8
#: ASCII letters in lower case, digits and all bytes of longer characters; the rest are spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
INDEX = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<binary>, sizes array<long>, docs array<int>, counts array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = byte_view(column)
    view = memoryview(data)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


def index(df: DataFrame, id_col: str, text_col: str, only: frozenset[bytes] | None = None) -> DataFrame:
    """Shards of the documents with at least one term, in the order of their ids (null last);
    with ``only``, posting lists of these terms alone. Lengths count all terms."""

    def closed(ids: list, lengths: array, known: dict, term: array, doc: array, count: array) -> pa.RecordBatch:
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, count = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (term, doc, count))
        doc = place[doc].astype(np.int32)
        by = np.lexsort((doc, term))
        row = [
            [len(ids)], [int(sum(lengths))], [[ids[i] for i in order.tolist()]], [np.array(lengths, np.int64)[order]], [list(known)],
            [np.bincount(term, minlength=len(known))], [doc[by]], [count[by]],
        ]
        kinds = [pa.int64(), pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [p.split()[0] for p in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            return [], array("q"), {}, array("i"), array("i"), array("i")

        shard = ids, lengths, known, term, doc, count = fresh()
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), _texts(batch.column("text"))):
                found = terms_of(text)
                if not found:
                    continue
                times = Counter(found)
                kept = list(times) if only is None else list(times.keys() & only)
                for t in kept:
                    term.append(known.setdefault(t, len(known)))
                count.extend(map(times.__getitem__, kept))
                doc.extend([len(ids)] * len(kept))
                ids.append(id_)
                lengths.append(len(found))
                if len(term) >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    yield closed(*shard)
                    shard = ids, lengths, known, term, doc, count = fresh()
        if ids:
            yield closed(*shard)

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("text"))
    return rows.mapInArrow(run, INDEX)


class Shard:
    """Posting lists of one shard, one after the other, under a sparse table of places of largest impact."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        self.n = len(lengths)
        self.docs = docs.astype(np.int64)
        self.keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * (self.n + 1) + self.docs
        load = 10 + (90 * lengths.astype(np.int64) * n_docs) // n_terms
        times = counts.astype(np.int64)
        self.impact = (1_000_000_000 * times) // (1000 * times + 8 * load[self.docs])
        levels = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 << len(levels) <= 2 * int(sizes.max(initial=1)):
            last, half = levels[-1], 1 << (len(levels) - 1)
            ahead = np.append(last[half:], last[len(last) - half :])
            levels.append(np.where(self.impact[ahead] > self.impact[last], ahead, last))
        self.table = np.stack(levels)

    def best(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the largest impact among the postings a to b; impact 0 where there are none."""
        size = b - a
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        some = size > 0
        left = self.table[level, np.where(some, a, 0)]
        right = self.table[level, np.where(some, b - (1 << level.astype(np.int64)), 0)]
        place = np.where(self.impact[right] > self.impact[left], right, left)
        return place, np.where(some, self.impact[place], 0)

    def top(self, terms: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of the ``most`` best documents with a score, equal ones by place."""
        base, weights = terms[:, None] * (self.n + 1), weights[:, None]
        width = max(1, STEP // len(terms))
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def at(docs: np.ndarray) -> np.ndarray:
            return np.searchsorted(self.keys, base + docs)

        def scored(docs: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            safe = np.minimum(place, len(self.keys) - 1)
            has = self.keys[safe] == base + docs
            return has, np.where(has, weights * self.impact[safe], 0).sum(axis=0)

        def bounded(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Intervals as columns: (bound, first, end, document to split at)."""
            place, high = self.best(a, b)
            high = high * weights
            lead = high.argmax(axis=0)
            return np.stack([high.sum(axis=0), lo, hi, self.docs[place[lead, np.arange(len(lo))]]])

        whole = np.array([0]), np.array([self.n])
        open_ = bounded(*whole, at(whole[0]), at(whole[1]))
        while True:
            full = len(scores) == most
            least, last = (scores[-1], found[-1]) if full else (0, -1)
            # an interval that only equals the last score helps if it begins before that document
            open_ = open_[:, (open_[0] > least) | ((open_[0] == least) & (open_[1] < last))]
            if not open_.shape[1]:
                return scores, found
            first = np.argpartition(-open_[0], width)[:width] if open_.shape[1] > width else np.arange(open_.shape[1])
            rest = np.ones(open_.shape[1], bool)
            rest[first] = False
            _bound, lo, hi, split = open_[:, first]
            open_ = open_[:, rest]
            short = hi - lo <= WHOLE
            sizes = (hi - lo)[short]
            every = np.repeat(lo[short], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lo, hi, split = lo[~short], hi[~short], split[~short]
            middle = at(split)
            has, score = scored(split, middle)
            more = [scored(every[k : k + width], at(every[k : k + width]))[1] for k in range(0, len(every), width)]
            scores = np.concatenate([scores, score, *more])
            found = np.concatenate([found, split, every])
            order = np.lexsort((found, -scores))[:most]
            order = order[scores[order] > 0]
            scores, found = scores[order], found[order]
            if len(lo):
                parts = bounded(lo, split, at(lo), middle), bounded(split + 1, hi, middle + has, at(hi))
                open_ = np.concatenate([open_, *(p[:, p[0] > 0] for p in parts)], axis=1)


def _best_of_shards(shards: DataFrame, items: list[tuple[int, list[bytes], list[int]]], n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(uid, doc_id, score): the ``most`` best documents of every shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, sizes, docs, counts = (batch.column(c)[i].values for c in ("ids", "lengths", "terms", "sizes", "docs", "counts"))
                place = {t: k for k, t in enumerate(terms.to_pylist())}
                if not place:
                    continue
                shard = Shard(*(np.asarray(x) for x in (lengths, sizes, docs, counts)), n_docs, n_terms)
                uids, places, scores = [], [], []
                for uid, words, weights in items:
                    held = [(place[t], w) for t, w in zip(words, weights) if t in place]
                    if held:
                        score, found = shard.top(*(np.array(x, np.int64) for x in zip(*held)), most)
                        uids.append(np.full(len(score), uid))
                        places.append(found)
                        scores.append(score)
                if uids:
                    uids, places, scores = (np.concatenate(x) for x in (uids, places, scores))
                    yield pa.RecordBatch.from_arrays([pa.array(uids), ids.take(pa.array(places)), pa.array(scores)], ["uid", "doc_id", "score"])

    return shards.mapInArrow(run, "uid long, doc_id long, score long")


def _items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, item_id, term), one row for each different term of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(text))) for text in _texts(batch.column("text"))]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(t) for t in terms]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(rows), batch.column("item_id").take(rows), pa.array([t for x in terms for t in x], pa.binary())], ["uid", "item_id", "term"]
            )

    rows = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("item_id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("text"),
    )
    return rows.mapInArrow(run, "uid long, item_id long, term binary")


def ranked(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``most`` best documents with a score above 0.

    Scores are integers, as the weights and impacts are; equal ones are ordered by id, null
    last. A row of ``docs`` is a document: rows repeated under an id are ranked each by itself.
    Null and empty texts have no term; they count nowhere and are never found. Items without a
    term that any document holds get no rows; rows repeated under an item id get their results each. No
    documents or no items give no rows.
    """
    spark = docs.sparkSession
    asked = staged(_items(items, item_col, item_text_col), "ranked-items")
    words = asked.select("term").distinct()
    few = words.limit(VOCABULARY + 1).count() <= VOCABULARY
    only = frozenset(bytes(r.term) for r in words.collect()) if few else None
    shards = staged(index(docs, id_col, text_col, only), "ranked-index")
    total = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not total.docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = shards.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy(F.col("terms").alias("term")).agg(F.sum("sizes").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = staged(asked.join(held, "term").select("uid", "term", weight.alias("weight")), "ranked-weights")
    blocks = -(-weighed.count() // BLOCK_TERMS)
    best = spark.createDataFrame([], "uid long, doc_id long, score long")
    for block in range(blocks):
        of_block = weighed.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)
        rows = of_block.groupBy("uid").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).collect()
        served = [(r.uid, [bytes(t) for t in r.terms], list(r.weights)) for r in rows]
        best = best.unionByName(_best_of_shards(shards, served, total.docs, total.terms, most))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return top.join(asked.select("uid", "item_id").distinct(), "uid").select("item_id", "rank", "doc_id", "score")
