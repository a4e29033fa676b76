"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document is the set of its distinct word shingles; equal sets are one node from the
start. A node has signatures of several min-hashes, one a tree, as many and as long as the threshold asks (``forest``), and
a sketch of ``SKETCH`` bytes. Each tree is all nodes in the order of its signature, dealt
out by ranges, so neighbours in the order share the longest prefixes; equal signatures are ordered by further min-hashes, others in each tree. A region is a run of
nodes that share a prefix: one min-hash deep where that holds no more than ``REGION``
nodes, and only where it holds more is it split by the next min-hash, so the depth
follows the density and no region is cut off. Inside a region every two nodes are
compared by size and sketch; a node then proposes those most like it and the ones that
most of the region resembles (the originals of large groups of copies), not all pairs.

Proposals are confirmed on the full sets. The best of each node go first; of the others only
those that would join two components still apart are looked at, so a group of thousands
costs a few confirmations a document. Nodes that left a pair out are marked, and go through the
trees again with their components known, and with ``FINE`` more bytes. Before, in runs that share half a signature and are longer than a region, all nodes meet
the ``HEADS`` nodes of the run with most links, one a component, wherever in the run they lie. Then every two components that have nodes whose size
and sketch allow a link are proposed by the most alike of these, whatever their number; then, with
the components that gives, every pair across. For these the nodes bring ``FINE`` more bytes, which
hold their whole set if it is small, so that what is proposed are links; larger sets have a finer sketch there.

Recall: two nodes at the threshold s share a min-hash in one of T trees with probability
1 - (1 - s)^T, at 0.85 and 10 trees 1 - 6e-9. Where regions are split down to all d
min-hashes it is 1 - (1 - s^d)^T for a single pair, ``RECALL`` or more by the choice of T and d: 10 trees of 6 at 0.85,
16 of 6 at 0.8. With the originals of groups dense enough to be split so, which are heads of runs, it is that of half the depth:
misses of 7e-5 and 1e-5. The tests and the README give measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import byte_view, id_and_text, slices, small_batches, staged
from panelmark.llm.components import components
from panelmark.llm.quality import _repeats
from panelmark.llm.wordscan import LOWER, scramble, span_prints, windows_of, word_spans

SKETCH = 128
#: Min-hashes of a signature, trees and hashes of all trees at most, and what of single pairs at the threshold is found at full depth.
DEPTH, TREES, HASHES, RECALL = 6, 20, 128, 0.99
#: Bytes of the finer sketch of nodes that left a pair out, a power of two, and shingles of sets that are whole in it.
FINE, WHOLE = 1024, 256
#: Nodes that one region compares at most before it is split by a further min-hash.
REGION = 1024
#: Proposals of a node in one region: most alike, and most resembled by others.
NEAREST, HUBS = 6, 3
#: Components of a long run of one signature that are shown to all of it.
HEADS = 16
#: Ranks of proposals; a node paired with itself has the last one if it left a pair out.
FIRST, OTHER, LEFT = 0, 1, 2
_RNG = np.random.default_rng(85)
_FACTOR = _RNG.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_SHORT = 0x9E3779B97F4A7C15


def forest(percent: int) -> tuple[int, int]:
    """(trees, min-hashes of each): the longest signatures of which few enough trees find ``RECALL`` of the pairs at the threshold."""
    share = min(max(percent, 1), 99) / 100
    for depth in range(DEPTH, 0, -1):
        trees = int(np.ceil(np.log(1 - RECALL) / np.log(1 - share**depth)))
        if trees <= TREES or depth == 1:
            return min(trees, HASHES), depth
    raise AssertionError


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingles, their rows) of lower-cased texts, each distinct one once a row. A row
    with fewer words has all of them as its one shingle; a row without words has none."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    prints = span_prints(data, starts, ends)
    first, keys = windows_of(prints, rows, words)
    at_rows = rows[first]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for short in range(1, words):
        begin = np.searchsorted(rows, np.flatnonzero(counts == short))
        if len(begin):
            total = np.full(len(begin), _SHORT * short % 2**64, np.uint64)
            for k in range(short):
                total = scramble(total ^ prints[begin + k])
            keys, at_rows = np.concatenate([keys, total]), np.concatenate([at_rows, rows[begin]])
    _many, fresh = _repeats(keys, at_rows)
    order = np.argsort(at_rows[fresh], kind="stable")
    return keys[fresh][order], at_rows[fresh][order]


def _by_row(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, place of their first)."""
    sizes = np.bincount(rows, minlength=n)
    filled = np.flatnonzero(sizes)
    return filled, (np.cumsum(sizes) - sizes)[filled]


def _node_keys(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bytes for each set, the same for the same set in any order."""
    halves = [np.add.reduceat(scramble(keys ^ np.uint64(salt)), starts) for salt in (0x51, 0xA7D3)]
    return np.stack(halves, axis=1).astype(">u8").view(np.uint8).reshape(len(starts), 16)


def signatures(df: DataFrame, words: int, trees_depth: tuple[int, int]) -> DataFrame:
    """(id, text_key, n_shingles, node, trees, sketch) of (id, text, text_key); without shingles the last three are null."""
    hashes = trees_depth[0] * trees_depth[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                n = high - low
                keys, rows = shingles(data, offsets, words)
                filled, starts = _by_row(keys, rows, n)
                node, trees, sketch = ([None] * n for _ in range(3))
                if len(filled):
                    short = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
                    least = np.stack([np.minimum.reduceat(short * f + s, starts) for f, s in zip(_FACTOR, _SHIFT)], axis=1)
                    of_trees = least[:, :hashes].astype(">u4").view(np.uint8)
                    of_sketch = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)[:, :SKETCH]
                    for i, row in enumerate(filled.tolist()):
                        trees[row], sketch[row] = of_trees[i].tobytes(), of_sketch[i].tobytes()
                    for row, key in zip(filled.tolist(), _node_keys(keys, starts)):
                        node[row] = key.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[low:high], batch.column("text_key")[low:high], pa.array(np.bincount(rows, minlength=n), pa.int64()),
                        *(pa.array(x, pa.binary()) for x in (node, trees, sketch)),
                    ],
                    ["id", "text_key", "n_shingles", "node", "trees", "sketch"],
                )

    return df.mapInArrow(run, "id long, text_key long, n_shingles long, node binary, trees binary, sketch binary")


def _regions(hashes: np.ndarray, low: int, high: int, depth: int, region: int = REGION) -> Iterator[tuple[int, int]]:
    """Runs of sorted signatures that share ``depth`` min-hashes, split further while too large."""
    if high - low <= region or depth == hashes.shape[1]:
        for at in range(low, high, region):
            yield at, min(at + region, high)
        return
    column = hashes[low:high, depth]
    cuts = [low, *(np.flatnonzero(column[1:] != column[:-1]) + 1 + low).tolist(), high]
    begin = low
    for a, b in zip(cuts, cuts[1:]):  # small neighbours stay together
        if b - begin > region:
            if a > begin:
                yield begin, a
            begin = a
            if b - a > region:
                yield from _regions(hashes, a, b, depth + 1, region)
                begin = b
    if high > begin:
        yield begin, high


def _alike(sketch: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int, least: int):
    """The pairs whose sizes and sketches allow the similarity, with their equal sketch bytes."""
    a, b = sizes[first], sizes[second]
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    first, second = first[fits], second[fits]
    equal = np.empty(len(first), np.int32)
    for k in range(0, len(first), 1 << 15):
        equal[k : k + (1 << 15)] = (sketch[first[k : k + (1 << 15)]] == sketch[second[k : k + (1 << 15)]]).sum(axis=1)
    near = equal >= least
    return first[near], second[near], equal[near]


def _chosen(one: np.ndarray, other: np.ndarray, equal: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs that look alike those that either node proposes, and the nodes of the others: (one, other, rank)."""
    n = len(one)
    node, mate, equal = np.concatenate([one, other]), np.concatenate([other, one]), np.tile(equal, 2)
    degree = np.bincount(node[equal >= sure], minlength=int(node.max()) + 1 if len(node) else 1)

    def ranked(by: np.ndarray) -> np.ndarray:
        """Each proposal's place among its node's, largest ``by`` first."""
        order = np.lexsort((mate, -by, node))
        place = np.empty(len(node), np.int32)
        starts = np.flatnonzero(np.diff(node[order], prepend=-1))
        place[order] = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        return place

    nearest, hub = ranked(equal), ranked(degree[mate])
    taken = (nearest < NEAREST) | (hub < HUBS)
    rank = np.where((nearest == 0) | (hub == 0), FIRST, OTHER)[taken]
    out = ~(taken[:n] | taken[n:])
    left = np.unique(np.concatenate([node[:n][out], mate[:n][out]]))
    return np.concatenate([node[taken], left]), np.concatenate([mate[taken], left]), np.append(rank, np.full(len(left), LEFT))


def _least(percent: int) -> int:
    """Equal sketch bytes that a pair at the threshold has at least, but for five deviations."""
    share = percent / 100
    return int((share - 5 * np.sqrt(share * (1 - share) / SKETCH)) * SKETCH)


def propose(hashes: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int, region: int = REGION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(one, other, rank) of the pairs that sorted rows of one tree propose.

    Small regions are compared together, step by step; a large one by itself, so that
    no more than its pairs are ever held. Equal signatures in more rows than a region has are
    compared region by region, so all of them count as having left pairs out.
    """
    least, sure = _least(percent), int(percent / 100 * SKETCH)
    equal = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]).any(axis=1)))
    for a, b in zip(equal.tolist(), [*equal[1:].tolist(), len(hashes)]):
        if b - a > region:
            yield np.arange(a, b), np.arange(a, b), np.full(b - a, LEFT)
    edge = np.flatnonzero(np.diff(hashes[:, 0], prepend=hashes[0, 0] ^ 1, append=hashes[-1, 0] ^ 1))
    run, found = np.full(len(hashes), -1, np.int32), []
    regions = (r for a, b in zip(edge, edge[1:]) if b - a > 1 for r in _regions(hashes, int(a), int(b), 1, region))
    for number, (a, b) in enumerate(regions):
        if b - a <= 64:
            run[a:b] = number
            continue
        parts = []
        for i in range(b - a - 1):
            first, second = np.full(b - a - i - 1, i, np.int32), np.arange(i + 1, b - a, dtype=np.int32)
            parts.append(_alike(sketch[a:b], sizes[a:b], first, second, percent, least))
        one, other, rank = _chosen(*(np.concatenate(x) for x in zip(*parts)), sure)
        yield one + a, other + a, rank
    for step in range(1, 64):
        first = np.flatnonzero((run[step:] == run[:-step]) & (run[step:] >= 0)).astype(np.int32)
        if not len(first):
            break
        found.append(_alike(sketch, sizes, first, first + np.int32(step), percent, least))
    if found:
        yield _chosen(*(np.concatenate(x) for x in zip(*found)), sure)


def _finely(fine: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of one first node are links by their whole sets, or allowed by their finer sketches but for five deviations.

    Of bins that either node fills, those equal are as many as links among so many shingles drawn
    from the union without return. A small set and a large one have no sketch in common and are allowed.
    """
    share, near = percent / 100, np.ones(len(first), bool)
    whole = np.sort(fine[first[0]].view("<u4")[: sizes[first[0]]]) if len(first) and sizes[first[0]] <= WHOLE else None
    at = np.flatnonzero((sizes[second] <= WHOLE) == (whole is not None))
    for some in (at[k : k + (1 << 12)] for k in range(0, len(at), 1 << 12)):
        a, b = fine[first[some]], fine[second[some]]
        total = sizes[first[some]] + sizes[second[some]]
        if whole is not None:
            b = b.view("<u4")
            place = np.minimum(np.searchsorted(whole, b), len(whole) - 1)
            common = ((whole[place] == b) & (np.arange(WHOLE) < sizes[second[some], None])).sum(axis=1)
            near[some] = 100 * common >= percent * (total - common)
        else:
            filled = np.count_nonzero(a | b, axis=1)
            equal = np.count_nonzero((a == b) & (a > 0), axis=1)
            union = total / (1 + share)
            spread = share * (1 - share) * filled * np.clip((union - filled) / (union - 1), 0, 1)
            near[some] = equal >= share * filled - 5 * np.sqrt(spread) - 1
    return near


def _mixed(hashes: np.ndarray, labels: np.ndarray, low: int, high: int, depth: int, region: int = REGION) -> Iterator[tuple[int, int]]:
    """Runs of sorted signatures with nodes of several components, split while they have too many pairs across."""
    _labels, counts = np.unique(labels[low:high], return_counts=True)
    if len(counts) == 1:
        return
    if depth == hashes.shape[1] or (high - low) ** 2 - int((counts**2).sum()) <= region**2:
        yield low, high
        return
    column = hashes[low:high, depth]
    cuts = [low, *(np.flatnonzero(column[1:] != column[:-1]) + 1 + low).tolist(), high]
    for a, b in zip(cuts, cuts[1:]):
        yield from _mixed(hashes, labels, a, b, depth + 1, region)


def _most_alike(parts: list[tuple], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two labels the pair with most equal sketch bytes."""
    one, other, equal = (np.concatenate(x) for x in zip(*parts))
    a, b = labels[one], labels[other]
    order = np.lexsort((other, one, -equal, b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    best = order[fresh]
    return one[best], other[best], equal[best]


def propose_across(hashes: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, labels: np.ndarray, percent: int, fine: np.ndarray | None = None, region: int = REGION, best: bool = False):
    """(one, other, rank): for each two labels with rows that look alike in a region, the most alike of these;
    with finer sketches all pairs of different labels that these allow too, or with ``best`` the most alike of them.

    Each node is compared with those of larger components, so the largest one, of which a hot
    group mostly consists, is only compared with the others.
    """
    least = _least(percent)
    edge = np.flatnonzero(np.diff(hashes[:, 0], prepend=hashes[0, 0] ^ 1, append=hashes[-1, 0] ^ 1))
    for low, high in (r for a, b in zip(edge.tolist(), edge[1:].tolist()) if b - a > 1 for r in _mixed(hashes, labels, a, b, 1, region)):
        _labels, of, counts = np.unique(labels[low:high], return_inverse=True, return_counts=True)
        order = np.lexsort((of, counts[of]))
        ends = np.append(np.flatnonzero(np.diff(of[order])) + 1, high - low)
        later = ends[np.searchsorted(ends, np.arange(high - low), "right")]
        order = (order + low).astype(np.int32)
        parts, held = [], 0
        for i in range(int(ends[-2])):
            found = _alike(sketch, sizes, np.full(high - low - later[i], order[i]), order[later[i] :], percent, least)
            if fine is not None:
                near = _finely(fine, sizes, found[0], found[1], percent)
                found = tuple(x[near] for x in found)
                if not best:
                    if near.any():
                        yield found[0], found[1], np.full(len(found[0]), FIRST)
                    continue
            parts.append(found)
            held += len(parts[-1][0])
            if held > 1 << 20 or i == ends[-2] - 1:
                if held:
                    one, other, _equal = _most_alike(parts, labels)
                    yield one, other, np.full(len(one), FIRST)
                parts, held = [], 0


def _by_tree(nodes: DataFrame, trees_depth: tuple[int, int], *extra: str) -> DataFrame:
    """(tree, signature, node, n_shingles, sketch, ...): each node once a tree."""
    width = 4 * trees_depth[1]
    each = nodes.select("node", "n_shingles", "trees", "sketch", *extra, F.explode(F.sequence(F.lit(0), F.lit(trees_depth[0] - 1))).alias("tree"))
    return each.select("tree", F.expr(f"substring(trees, tree * {width} + 1, {width})").alias("signature"), "node", "n_shingles", "sketch", *extra)


def proposals(nodes: DataFrame, percent: int, trees_depth: tuple[int, int], across: bool = False, region: int = REGION, best: bool = False) -> DataFrame:
    """(a, b, rank): pairs of nodes to confirm, a < b; rank ``FIRST`` is some node's first choice in
    some region, and a row with rank ``LEFT`` names a node, as a and b, that left pairs out.
    With ``across`` pairs of nodes whose ``label`` differs, those most alike of each two labels,
    or all that their finer sketches allow if the nodes have a column ``fine`` (of these too the most alike, with ``best``)."""
    extra = [c for c in ("label", "fine") if across and c in nodes.columns]
    depth = trees_depth[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def go(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not rows:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            tree = table["tree"].to_numpy()
            raw = lambda name, width: np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, width)
            hashes = np.ascontiguousarray(raw("signature", 4 * depth)).view(">u4").astype(np.uint32)
            keys, sketch, sizes = raw("node", 16), raw("sketch", SKETCH), table["n_shingles"].to_numpy()
            labels = np.unique(raw("label", 16).copy().view("V16").ravel(), return_inverse=True)[1] if across else None
            fine = byte_view(table["fine"])[0][-FINE * rows :].reshape(rows, FINE) if "fine" in extra else None
            # an unfinished run waits for its rest; one larger than a buffer is cut at its next min-hash,
            # and rows of one signature with enough overlap to be seen as too many for a region
            end, keep, fresh = rows, rows, tree[1:] != tree[:-1]
            for k in range(0 if last else depth):
                fresh = fresh | (hashes[1:, k] != hashes[:-1, k])
                if fresh.any():
                    end = keep = int(np.flatnonzero(fresh)[-1]) + 1
                    break
            else:
                keep = rows if last else rows - region - 1
            held, rows = ([] if keep == rows else table.slice(keep).to_batches()), rows - keep
            for a in np.flatnonzero(np.append(True, tree[1:end] != tree[: end - 1])).tolist():
                b = a + int(np.searchsorted(tree[a:end], tree[a], "right"))
                part = hashes[a:b], sizes[a:b], sketch[a:b]
                over = (labels[a:b], percent, None if fine is None else fine[a:b], region, best) if across else ()
                for one, other, rank in propose_across(*part, *over) if across else propose(*part, percent, region):
                    left, right = keys[a:b][one], keys[a:b][other]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(map(bytes, left)), pa.binary()), pa.array(list(map(bytes, right)), pa.binary()), pa.array(rank, pa.int32())],
                        ["a", "b", "rank"],
                    )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= (64 if across else 8) * region:
                yield from go(last=False)
        yield from go(last=True)

    each = _by_tree(nodes, trees_depth, *extra)
    further = F.expr(f"substring(sketch, pmod(tree * 12 + 64, {SKETCH - 12}) + 1, 12)")
    order = ["tree", "signature", further, "node"]
    found = each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a binary, b binary, rank int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank").groupBy("a", "b").agg(F.min("rank").alias("rank"))


def to_heads(nodes: DataFrame, links: DataFrame, percent: int, trees_depth: tuple[int, int], region: int = REGION) -> DataFrame:
    """(a, b): nodes of a run that shares half a signature and is longer than ``region`` with the heads of the run's other components.

    ``nodes`` have a ``label``. A component's head in a run is its node with most ``links``; the ``HEADS`` heads with
    most are shown to the whole run, over however many buffers and tasks it lies. Heads are found by partial maxima;
    sketches go along only with nodes of such runs.
    """
    least, width = _least(percent), 4 * max(1, trees_depth[1] // 2)
    run = ["tree", "prefix"]
    each = _by_tree(nodes, trees_depth).select("tree", F.expr(f"substring(signature, 1, {width})").alias("prefix"), "node")
    long = each.groupBy(*run).agg(F.count("*").alias("rows")).filter(F.col("rows") > region).select(*run)
    each = staged(each.join(long, run, "left_semi"), "near-dense").join(nodes.select("node", "label", "n_shingles", "sketch"), "node")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    heads = each.join(degree, "node").groupBy(*run, "label").agg(F.max(F.struct("links", "node", "n_shingles", "sketch")).alias("head"))
    place = F.row_number().over(Window.partitionBy(*run).orderBy(F.desc("head.links"), F.desc("head.node")))
    heads = heads.select("*", place.alias("place")).filter(F.col("place") <= HEADS).select(
        *run, F.col("label").alias("of"), F.col("head.node").alias("mate"), F.col("head.n_shingles").alias("size"), F.col("head.sketch").alias("other"))
    met = each.join(heads, run).filter(
        (F.col("label") != F.col("of")) & (100 * F.least("n_shingles", "size") >= percent * F.greatest("n_shingles", "size")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "other"))
            yield batch.select(["a", "b"]).filter(pa.array((one == other).sum(axis=1) >= least))

    pairs = met.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b"), "sketch", "other")
    return pairs.mapInArrow(compare, "a binary, b binary").distinct()


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(node, shingles: sorted u64) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                keys, rows = shingles(data, offsets, words)
                filled, starts = _by_row(keys, rows, high - low)
                if len(filled):
                    nodes = [key.tobytes() for key in _node_keys(keys, starts)]
                    sets = [np.sort(part).tobytes() for part in np.split(keys, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return df.mapInArrow(run, "node binary, shingles binary")


def _fine_sketches(sets: DataFrame) -> DataFrame:
    """(node, fine) of (node, shingles): half of each shingle's hash for up to ``WHOLE`` of them, else the least
    of the shingles whose hash starts with the same bits as a byte, 0 without any."""
    bits = np.uint64(64 - (FINE.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, FINE), np.uint8)
            for row, shingles_ in zip(out, batch.column("shingles")):
                hashes = np.sort(scramble(np.frombuffer(shingles_.as_buffer(), np.uint64)))
                if len(hashes) <= WHOLE:
                    row.view("<u4")[: len(hashes)] = hashes >> np.uint64(32)
                    continue
                place = (hashes >> bits).astype(np.int64)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                row[place[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(map(bytes, out)), pa.binary())], ["node", "fine"])

    return sets.select("node", "shingles").mapInArrow(run, "node binary, fine binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, other in zip(batch.column("one"), batch.column("other")):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    whole = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b")
    whole = whole.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").select("a", "b", "one", "other")
    return whole.mapInArrow(run, "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 80, region: int = REGION) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_key), one row for each row of ``df``.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle
    sets; ``component_id`` is the smallest id reachable over links. Null, empty and
    blank texts have no shingles and are linked with nothing. Null ids count as no id:
    such a row is kept only if its component has no id at all, or it has no shingles. Rows
    repeated under one id are all kept or all not. ``text_key`` is a hash of the text, by
    which rows of a null or repeated id can be told apart. Other columns are not read.
    ``region`` is the number of nodes that are compared at once; buffers are 8 and 64 of it.
    """
    small_batches(df.sparkSession)
    trees_depth = forest(percent)
    rows = id_and_text(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    signed = staged(signatures(rows, words, trees_depth), "near-signed")
    some = signed.filter("node is not null")
    # equal sets have equal signatures, so any of them will do
    nodes = some.groupBy("node").agg(
        F.min("id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("trees").alias("trees"), F.first("sketch").alias("sketch")
    )
    nodes = staged(nodes, "near-nodes")
    pairs = staged(proposals(nodes, percent, trees_depth, region=region), "near-pairs")
    ends = lambda some: some.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def whole(some: DataFrame) -> DataFrame:
        wanted = some.join(nodes, "node").select(F.col("least_id").alias("wanted")).distinct()
        texts = rows.select("id", "text").join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        return staged(_sets(texts, words), "near-sets")

    sets = whole(ends(pairs))

    links = staged(_confirmed(pairs.filter(F.col("rank") == FIRST), sets, percent), "near-links")
    label = components(links)
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
    apart = pairs.filter(F.col("rank") == OTHER).join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.withColumn("of_a", F.coalesce("of_a", "a")).withColumn("of_b", F.coalesce("of_b", "b")).filter("of_a <> of_b").select("a", "b")
    more = staged(_confirmed(apart, sets, percent), "near-links")
    label = components(links.unionByName(more))

    def labelled(some: DataFrame) -> DataFrame:
        return some.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # what the nodes left out: heads of long runs, then the most alike of each two components, then every pair still across
    left = pairs.filter(F.col("rank") == LEFT).select(F.col("a").alias("node")).join(nodes, "node")
    finely = left.join(_fine_sketches(sets), "node")  # nodes that left pairs out were proposed themselves, so they have sets
    tried = pairs.select("a", "b")
    walks = [
        lambda: to_heads(labelled(nodes), links.unionByName(more), percent, trees_depth, region),
        lambda: proposals(labelled(finely), percent, trees_depth, across=True, region=region, best=True),
        lambda: proposals(labelled(finely), percent, trees_depth, across=True, region=region),
    ]
    for walk in walks:
        rest = staged(walk().select("a", "b").join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = tried.unionByName(rest)
        new = staged(ends(rest).join(sets, "node", "left_anti"), "near-new")  # heads meet nodes that nothing proposed before
        if not new.isEmpty():
            sets = sets.unionByName(whole(new))
        joined = staged(_confirmed(rest, sets, percent), "near-links")
        if not joined.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(joined))

    known = nodes.select("node", "least_id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = staged(known.groupBy("label").agg(F.min("least_id").alias("component_id")), "near-components")
    known = known.join(least, "label").select("node", "component_id")
    out = signed.select("id", "n_shingles", "node", "text_key").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_key")
