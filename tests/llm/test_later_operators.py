"""Centroid clusters, ranked search and repeated passages against plain Python versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.llm import clusters, queries, ranked, repeats
from tests.llm import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# clusters


def plain_clusters(vectors, k, rounds, scale=64):
    """[(id, cluster, distance, inertia of it, of all, digest)] by full comparison."""
    points = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"1:{'null' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centroids = [p for _, p in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centroids)) for _, p in points]

    for _ in range(rounds):
        near = [n for _, n in assign()]
        for n in set(near):
            mine = [p for (_, p), m in zip(points, near) if m == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found, sums = assign(), collections.Counter()
    for d, n in found:
        sums[n] += d
    marks = [brute.sha(",".join(map(str, c)).encode()) for c in centroids]
    return [(i, n, d, sums[n], sum(sums.values()), marks[n]) for (i, _), (d, n) in zip(points, found)]


@pytest.mark.parametrize("spread", [0.03, 0.4, 6.0])
def test_clusters_equal_full_comparison(spark, spread):
    """Coarse components (ties, equal vectors, empty clusters) and fine ones."""
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(0, spread, 5).round(2)]) for i in range(400)]
    vectors += vectors[:9] + [(None, [0.0] * 5), (None, [0.1] * 5)]
    df = spark.createDataFrame(vectors, "id long, v array<double>").repartition(5)
    got = clusters.clustered(df, "id", "v", dims=5, k=16, rounds=3)
    assert rows(got) == sorted(plain_clusters(vectors, 16, 3), key=repr)


def test_clusters_of_odd_rows(spark):
    bad = [(50, None), (51, []), (52, [1.0, 2.0, None]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, float("-inf"), 2.0]), (55, [1.0, 2.0]), (56, [1.0] * 4)]
    good = [(1, [1.0, -2.5, 3.0]), (1, [1.0, -2.5, 3.0]), (2, [0.0, 0.0, 0.0]), (None, [1.0, -2.5, 3.0])]
    df = spark.createDataFrame([(*r, "c", 1) for r in bad + good], "vec_id long, embedding array<float>, near string, `select` int")
    got = clusters.clustered(df, "vec_id", "embedding", dims=3, k=16, rounds=2)
    assert rows(got) == sorted(plain_clusters(good, 16, 2), key=repr)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows(clusters.clustered(df, "vec_id", "embedding", dims=3, k=1, rounds=2)) == sorted(plain_clusters(good, 1, 2), key=repr)
    for none in (df.limit(0), df.filter("vec_id > 49")):
        assert clusters.clustered(none, "vec_id", "embedding", dims=3).collect() == []


def test_components_too_wide_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30])], "id long, v array<double>")
    with pytest.raises(Exception, match="may not fit 64 bits"):
        clusters.clustered(df, "id", "v", dims=1).collect()


def test_shallot_finds_the_two_nearest():
    rng = np.random.default_rng(5)
    points, centroids = rng.integers(-20, 20, (600, 3)), rng.integers(-20, 20, (12, 3))
    start = np.stack([rng.permutation(12)[:2] for _ in range(600)])
    near, second, d1, d2 = clusters.shallot(points, centroids, clusters._ways(centroids), start[:, 0], start[:, 1])
    full = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    want = np.lexsort((np.broadcast_to(np.arange(12), full.shape), full), axis=1)[:, :2]
    assert (np.stack([near, second], axis=1) == want).all()
    assert (d1 == full[np.arange(600), near]).all() and (d2 == full[np.arange(600), second]).all()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_ranked(docs, items, most=10):
    def terms(text):
        return TERM.findall((text or "").translate(LOWER))

    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            load = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * load)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_scoring_everything(spark, monkeypatch, small):
    """Ties, copies, null ids, terms of other scripts; once with tiny shards, blocks and an index of all terms."""
    if small:
        for name, value in {"SHARD_DOCS": 7, "BLOCK_TERMS": 10, "VOCABULARY": 3, "STEP": 8, "WHOLE": 2}.items():
            monkeypatch.setattr(ranked, name, value)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)] + ["Été", "日本", "ÉTÉ", "İx"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(400 + i, docs[i % 3][1]) for i in range(40)] + [(None, docs[5][1]), (None, docs[6][1]), (7, "w1 w2"), (500, None), (501, ""), (502, "?! .")]
    items = [(i, " ".join(rng.choice(words).upper() for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere to be found"), (None, "w1 w3"), (93, docs[0][1]), (93, docs[0][1])]
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, uid int, terms string").repartition(4)
    asked = spark.createDataFrame([(*q, 2) for q in items], "item_id long, text string, weight int")
    got = ranked.ranked(made, "doc_id", "text", asked, "item_id", "text")
    assert rows(got) == plain_ranked(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    for a, b in ((made.limit(0), asked), (made, asked.limit(0)), (made.filter("doc_id >= 500"), asked)):
        assert ranked.ranked(a, "doc_id", "text", b, "item_id", "text").collect() == []


def test_range_maxima_bound_and_order():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 60, 500)
    lists = [np.sort(rng.choice(500, rng.integers(1, 400), replace=False)) for _ in range(9)]
    docs, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
    counts = rng.integers(1, 4, len(docs))
    shard = ranked.Shard(lengths, sizes, docs, counts, 500, int(lengths.sum()))
    for _ in range(50):
        a, b = sorted(rng.integers(0, sizes[3] + 1, 2) + sizes[:3].sum())
        place, high = shard.best(np.array([a]), np.array([b]))
        assert high[0] == shard.impact[a:b].max(initial=0) and (a == b or a <= place[0] < b)
    weights = rng.integers(0, 5, 9)
    full = np.zeros(500, np.int64)
    np.add.at(full, docs, np.repeat(weights, sizes) * shard.impact)
    order = np.lexsort((np.arange(500), -full))[:10]
    scores, found = shard.top(np.arange(9), weights, 10)
    assert found.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


# repeated passages


def plain_repeats(docs, window=20):
    first, split = {}, [(i, brute.words(t)) for i, t in docs]
    place = {r: (i is None, i or 0) for r, (i, _) in enumerate(docs)}
    for r, (_, w) in enumerate(split):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (True, math.inf, 0)), (*place[r], s))
    out = []
    for r, (i, w) in enumerate(split):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (*place[r], s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_comparing_all_windows(spark, seed):
    """Passages of all alignments that part ways at any word, inside one text and between texts, among few words."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{j}" for j in range(rng.randint(15, 60))] for k in range(6)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            text += p[a : len(p) - rng.randint(0, 8)] if rng.random() < 0.7 else [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40))]
            if text and rng.random() < 0.4:
                text[rng.randrange(len(text))] = "other"
        docs.append((rng.choice([i, i, i, i % 7, None]), "\n ".join(text)))
    docs += docs[:5] + [(900, " ".join(passages[0])), (901, "\t".join(["a"] * 70)), (3, " ".join(passages[0])), (5, "x " + " ".join(passages[0][:20]))]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, found int, mark string").repartition(6)
    got = repeats.without_repeats(df, "doc_id", "text")
    assert rows(got) == plain_repeats(docs)
    assert got.columns == ["id", "n_words", "n_removed", "kept_text"]


def test_repeats_of_many_copies_and_shorter_windows(spark):
    passage = " ".join(f"s{k}" for k in range(33))
    docs = [(i, f"head{i} {passage} tail{i % 3} " + "z " * (i % 5)) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    for window in (13, 20, 33):
        assert rows(repeats.without_repeats(df, "doc_id", "text", window)) == plain_repeats(docs, window)
    with pytest.raises(ValueError):
        repeats.without_repeats(df, "doc_id", "text", 12)


def test_later_operators_on_odd_documents(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(repeats.without_repeats(odd, "doc_id", "text")) == plain_repeats(docs)
    assert repeats.without_repeats(none, "doc_id", "text").collect() == []
    items = spark.createDataFrame([(1, "word5 of3 tail"), (2, "one two")], "item_id long, text string")
    assert rows(ranked.ranked(odd, "doc_id", "text", items, "item_id", "text")) == plain_ranked(docs, [(1, "word5 of3 tail"), (2, "one two")])


def test_passages_of_the_tables(spark, sf, documents):
    got = queries.op13_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = [(i, n, gone, brute.sha(text.encode())) for i, n, gone, text in plain_repeats(documents)]
    assert rows(got) == sorted(want, key=repr)
    assert got.agg(F.sum("n_removed")).first()[0] > 0
