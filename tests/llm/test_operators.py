"""Every operator on odd rows and empty tables, and every query without SQL against a plain version."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.llm import bpe, exact, near, packing, pii, quality, queries, records, shards, template, warc
from tests.llm import brute
from tests.llm.conftest import LONG, ODD


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_near_query(spark, sf, documents):
    want = brute.near(documents, 3, 85)
    rows = queries.op1_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(documents)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_finds_every_link_of_large_groups(spark):
    """Copies that differ from one original in up to a fifth of it: most pairs of copies are no links."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(3):
        base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
        for k in range(700):
            copy = list(base)
            for at in rng.integers(0, 160, int(rng.integers(0, 9))):
                copy[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((group * 10_000 + k, " ".join(copy)))
    want = brute.near(rows, 3, 85)
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 85).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == want


def test_near_finds_one_link_amid_pairs_just_below_the_threshold(spark):
    """Two families whose originals are the only link; all other pairs across are at 0.83 to 0.845 and many look more alike."""
    rng = np.random.default_rng(11)
    rows = []
    for pair in range(6):
        base = [f"p{pair}w{x}" for x in range(400)]
        for side in range(2):
            start = list(base)
            if side:  # 31 of 398 shingles: a run of 29 words
                start[50:79] = [f"p{pair}o{x}" for x in range(29)]
            for k in range(60):
                copy = list(start)
                if k:
                    copy[int(rng.integers(100, 390))] = f"p{pair}s{side}k{k}"
                rows.append((pair * 1000 + side * 100 + k, " ".join(copy)))
    want = brute.near(rows, 3, 85)
    assert len({c for _, c in want.values()}) == 6
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 85).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_near_finds_copies_of_one_original_over_many_buffers(spark, percent):
    """A third of the rows are copies that only the original links; runs of them are longer than any buffer."""
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in range(200)]
    rows = []
    for k in range(1500):
        copy = list(base)
        for at in rng.choice(66, int((100 - percent) / 2.6) if k else 0, replace=False):
            copy[3 * at] = f"n{k}m{at}"
        rows.append((10_000 - k, " ".join(copy)))
    rows += [(20_000 + k, " ".join(f"o{x}" for x in rng.integers(0, 10**6, 60))) for k in range(1000)]
    want = brute.near(rows, 3, percent)
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text", 3, percent, region=4).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == want
    assert max(collections.Counter(c for _, c in want.values()).values()) > 1000


def test_near_odd_rows(odd, none):
    rows = near.near_duplicates(odd, "doc_id", "text", 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {r.id: r for r in rows if r.id not in (None, 12)}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1, 1, 5]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 2, 3, 4, 5, 5, 7, 7, 9, 9]
    assert sorted((r.component_id or 0, r.kept) for r in rows if r.id is None) == [(0, True), (7, False)]
    assert near.near_duplicates(none, "doc_id", "text").count() == 0


def test_personal_query(spark, sf, documents):
    texts = dict(documents)
    rows = queries.op2_personal_data(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.personal(texts[r.doc_id])
        written = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert r.base_sha256 == brute.sha(",".join(written).encode()) and set(written) <= set(filter(None, r.spans.split(",")))


def test_personal_odd_rows(spark, odd, none):
    rng = np.random.default_rng(6)
    parts = [*"ab1234567890 -.+()@é\n_%:", "+1 (383) 555-6083", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "255.256.1.1", "x@y", "\U0001f600", "000255.1.1.1"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(1500)]
    more = spark.createDataFrame([(None, t) for t in [*texts, "1" * 3000, "9 " * 2000, "a@b.co " * 700]], "doc_id long, text string")
    found = pii.find_spans(odd.select("doc_id", "text").unionByName(more), {}, "text", "doc_id")
    rows = pii.redacted(found, "_text", "spans", "clean").collect()
    assert len(rows) == len(ODD) + 1503
    for r in rows:
        want = brute.personal(r._text)
        assert [tuple(s) for s in r.base] == want == [tuple(s) for s in r.spans]
        out, at = "", 0
        while want:
            start, kind, end = want.pop(0)
            while want and want[0][0] < end:
                end = max(end, want.pop(0)[2])
            out, at = f"{out}{r._text[at:start]}[{pii.KINDS[kind].upper()}]", end
        assert r.clean == out + r._text[at:]
    assert pii.fit_models(none, "doc_id", "text") == {} and pii.find_spans(none, {}, "text", "doc_id").count() == 0


def test_personal_trees_add_what_looks_valid_and_leave_the_rest(spark):
    rng = np.random.default_rng(7)

    def number():
        return "".join(map(str, rng.integers(0, 10, 15)))

    def card(valid):
        body = number()
        last = next(str(d) for d in range(10) if brute.luhn(body + str(d)) == valid)
        digits = body + last
        return f"card {' '.join(digits[k : k + 4] for k in range(0, 16, 4))} paid"

    rows = [(k, f"text {k} {card(True)} end") for k in range(900)] + [(k, f"order no={number()} end") for k in range(900, 1500)]
    rows += [(5000, f"then {card(False)} end"), (5001, "order no=" + "123456789012345" + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = pii.fit_models(docs, "doc_id", "text")
    assert "card" in models
    odd_ones = pii.find_spans(docs.filter("doc_id >= 5000"), models, "text", "doc_id").collect()
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in odd_ones}
    assert spans == {5000: [(10, 29)], 5001: []}


def test_personal_spans_with_models_one_by_one(spark, odd):
    """Added spans of odd texts, recomputed from the candidates and the trees in plain Python."""
    rng = np.random.default_rng(16)
    parts = [*"ab1 .-(@\n", "+1 (383) 555-6083", "4111 1111 1111 1112", "a@b.c", "1.2.3.4", "300.256.1.1", "www.a-b.org", "0049 30 1234567", "7.5", "x (at) y (dot) z", "1.2.3.4.5"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(400)] + ["1.2.3.999 " * 1500, "300.1.2.3" * 400]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    models = pii.fit_models(docs, "doc_id", "text")
    assert set(models) == set(pii.KINDS)
    models = {k: (m[0], -0.5) for k, m in models.items()}
    every = pii._candidates(pii._base(pii._texts(docs, "text", F.monotonically_increasing_id().alias("row"))))
    found = pii.find_spans(docs, models, "text", F.monotonically_increasing_id().alias("row"))
    spans = {r.row: [tuple(s) for s in r.spans] for r in found.select("row", "spans").collect()}
    added = 0
    for r in every.collect():
        base = sorted((s.start, k, s.end) for k, kind in enumerate(pii.KINDS) for s in r[f"base_{kind}"])
        over = []
        for k, kind in enumerate(pii.KINDS):
            loose = r[f"loose_{kind}"]
            x = np.array([[c[f] for f in pii.FEATURES] for c in loose]).reshape(len(loose), len(pii.FEATURES))
            trees, threshold = models[kind]
            over += [(c.start, k, c.end, o) for c, o in zip(loose, trees.margin(x).tolist()) if o >= threshold]
        meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
        covered = np.zeros(len(r._text) + 1, bool)
        for s in base:
            covered[s[0] : s[2]] = True
        over = sorted(c for c in over if not covered[c[0] : c[2]].any())
        mine = []
        for i, c in enumerate(over):
            near = [o for o in over[max(0, i - 60) : i + 60] if meets(o, c)]
            if not any((o[3], ) > (c[3], ) or (o[3] == c[3] and o[:2] < c[:2]) for o in near):
                mine.append(c[:3])
        added += len(mine)
        assert spans[r.row] == sorted(base + mine), r._text[:200]
    assert added > 100


def test_rising_shares():
    low, share = pii.rising_shares(np.array([1.0, 2, 2, 3, 4, 5]), np.array([0, 1, 1, 0, 1, 1]))
    assert low.tolist() == [1, 2, 4] and np.allclose(share, [0, 2 / 3, 1])
    assert pii._threshold(np.arange(10.0), np.ones(10)) == np.inf  # a handful proves nothing
    assert pii._threshold(np.arange(100.0), np.arange(100) >= 40) == 40 - 1e-9


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 300_000
    rows = [(3, "http://a/", "p" * 100), (2, None, "p" * 100), (None, "u", "p" * 100), (4, "u", "p" * 99), (5, "u", "p" * 99), (6, "é\n", None), (7, "u", ""), (8, "u", big), (9, "u", big), (8, "u", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    folder = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(pages), folder)
    read = warc.read_warc(spark, folder)
    got = bag(read.select("page_id", "record_type", "refers_to", "payload_bytes").collect())
    assert got == collections.Counter([
        (2, "response", None, 100), (3, "revisit", 2, 100), (None, "revisit", 2, 100), (4, "response", None, 99), (5, "response", None, 99),
        (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 300_000), (8, "response", None, 300_000), (9, "revisit", 8, 300_000)])
    assert {r[0] for r in read.filter("record_type = 'revisit' and payload_digest is not null").select("page_id").collect()} == {3, None, 9}
    plan = read.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in plan
    assert read.filter("target_uri like 'http://a%'").count() == 1
    assert warc.read_warc(spark, folder, payload=False).filter("payload is not null").count() == 0
    empty = str(tmp_path / "none")
    warc.write_warc(warc.with_revisits(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_archives_without_an_index_or_manifest(spark, tmp_path):
    import zlib

    members = b""
    for k in range(5):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        members += engine.compress(warc.record(k, "u", b"body%d" % k, "0" * 64, 5, None)) + engine.flush()
    (tmp_path / "x.warc.gz").write_bytes(members)
    assert sorted((r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [(k, b"body%d" % k) for k in range(5)]


def check_packing(rows, texts, library):
    """Each id of each document in one piece, sequences gapless and of at most 1024; returns padded ids."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids[at : at + r.length]))
            assert r.ids is None or np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    padded = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded


def test_packing_query(spark, sf, documents, library):
    rows = queries.op4_packing(spark, sf).withColumnRenamed("doc_id", "id").withColumn("ids", F.lit(None)).collect()
    assert check_packing(rows, documents, library) == 0


def test_packing_odd_rows(odd, none, library):
    rows = packing.packed(odd, "doc_id", "text", with_ids=True).collect()
    single = [(i, t) for i, t in ODD if i not in (None, 8, 12)]
    assert check_packing(rows, single, library) == 0
    want = collections.Counter()
    for i, t in ODD:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in rows:
        got[r.id] += r.length
    assert got == want
    assert packing.packed(none, "doc_id", "text").count() == 0


def test_packing_prefers_lexical_neighbours(spark):
    """Windows of a corpus of three vocabularies mix them rarely."""
    rng = np.random.default_rng(8)
    vocab = [[f"{a}{b}{c}" for b in "aeiou" for c in "lmnrst"] for a in ("Kra", "vilo", "zhe")]
    rows = [(k, " ".join(rng.choice(vocab[k % 3], 60))) for k in range(600)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", with_ids=False).collect()
    kinds = collections.defaultdict(set)
    for r in found:
        kinds[r.sequence_id].add(r.id % 3)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.7 * len(kinds)


@pytest.mark.parametrize("digests", [False, True])
def test_exact_odd_rows(odd, none, digests):
    rows = exact.exact_duplicates(odd, "doc_id", "text", digests).collect()
    assert len(rows) == len(ODD)
    got = bag((r.id, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == collections.Counter([
        (1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True),
        (None, 7, 2, False), (8, 8, 2, True), (8, 8, 2, False), (9, 9, 1, True), (10, 10, 1, True), (11, 11, 1, True), (12, 12, 1, True), (12, 12, 1, True)])
    assert exact.exact_duplicates(none, "doc_id", "text", digests).count() == 0


def test_exact_looks_past_equal_lengths_and_prefixes(spark):
    same = "p" * 600
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a"), (4, "q" * 601), (5, " x\t\ty "), (6, " x y ")]
    found = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.id: r.keep_id for r in found} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}


def test_quality_query(spark, sf, documents):
    rows = queries.op6_quality(spark, sf).collect()
    texts = dict(documents)
    for r in rows:
        counts = brute.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)
    assert len(rows) == len(documents)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd_ids = labels.filter("doc_id % 2 = 1")
    rules = quality.fit_rules(docs, odd_ids)
    found = quality.judged(docs, rules, "doc_id", "text").filter("not base_failed").join(labels.filter("doc_id % 2 = 0"), F.col("id") == F.col("doc_id")).collect()
    good, bad = [r.kept for r in found if r.quality], [r.kept for r in found if not r.quality]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.3


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    rules = quality.fit_rules(odd, labels)
    assert rules.trees is None
    rows = quality.judged(odd, rules, "doc_id", "text").collect()
    assert bag((r.id, r.n_words) for r in rows) == collections.Counter((i, brute.quality(t)[0]) for i, t in ODD)
    kept = quality.keep_good(odd, rules, "text")
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {9, 10}
    assert quality.judged(none, rules, "doc_id", "text").count() == 0 and quality.keep_good(none, rules, "text").count() == 0
    assert quality.fit_rules(none, labels.limit(0)).trees is None


def test_shards_match_the_mixture(spark):
    rows = [(k, f"t{k % 50}", None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 4}", 1) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int").repartition(5)
    found = shards.interleaved_shards(docs, "doc_id", "text", "source", 7).collect()
    assert sorted(r.id for r in found) == list(range(5000))
    sizes = collections.Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    whole = collections.Counter(r.source for r in found)
    for (shard, source), n in collections.Counter((r.shard, r.source) for r in found).items():
        assert abs(n - whole[source] * sizes[shard] / 5000) <= len(whole)  # rounding of each source shifts a cut by less than a row


def test_shards_odd_rows(odd, none):
    found = shards.interleaved_shards(odd.withColumn("source", F.lit(None).cast("string")), "doc_id", "text", "source").collect()
    assert sorted(r.shard for r in found) == sorted({(k * 24) // len(ODD) for k in range(len(ODD))})
    assert bag((r.id, r.size) for r in found) == collections.Counter((i, len((t or "").encode()) + 8) for i, t in ODD)
    assert shards.interleaved_shards(none.withColumn("source", F.lit("x")), "doc_id", "text", "source").count() == 0


def test_bpe_query(spark, sf, documents, library):
    rows = {r.doc_id: r for r in queries.op8_bpe(spark, sf).collect()}
    for i, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(rows[i]) == (i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(decoded.encode()))


def test_bpe_odd_rows(odd, none, library):
    rows = bpe.encode_texts(odd, "doc_id", "text").collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ODD]
    assert bag((r.id, tuple(r.ids), r.decoded) for r in rows) == collections.Counter((i, tuple(ids), t) for i, ids, t in want)
    assert bpe.encode_texts(none, "doc_id", "text").count() == 0 and bpe.token_digests(none, "doc_id", "text").count() == 0


def test_records_query(spark, sf, documents, library):
    rows, start = {r.doc_id: r for r in queries.op9_token_records(spark, sf).collect()}, 0
    for i, text in sorted(documents):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[i]) == (i, start, len(ids), brute.crc(ids))
        start += len(ids)


def test_records_odd_rows(spark, odd, none, library, tmp_path, monkeypatch):
    folder = str(tmp_path / "r")
    records.write_records(odd, "doc_id", "text", folder, end_id=70_000)
    rows = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = collections.Counter((i, brute.crc([*library.encode(t or "", add_special_tokens=False).ids, 70_000])) for i, t in ODD)
    import zlib

    assert bag((r.id, zlib.crc32(bytes(r.ids))) for r in rows) == want
    empty = str(tmp_path / "none")
    records.write_records(none, "doc_id", "text", empty)
    assert records.read_records(spark, empty).count() == 0


def test_html_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op10_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute.article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_html_without_article_elements_by_the_host_s_template(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.lit("http://one.example/"), "page_id").alias("url"), "html")
    want = {r.page_id: brute.article(r.html) for r in pages.collect()}
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div class='b1'>"), "</article>", "</div>"))
    assert {r.page_id: r.text for r in template.extracted(plain).collect()} == want


def test_lines_that_a_host_repeats_inside_its_articles_are_template(spark):
    share = ["<p>Follow us on Foo", "<div class=x>Sign the petition</div>"]

    def page(k, lines, body):
        return f"<nav>Top</nav><article><h1>Title {k}</h1>{lines[0]}<h2>Summary</h2>{body}<table><tr><td>Price<td>{k}</table>{''.join(lines[1:])}</article>"

    rows = [(k, "one", page(k, share, f"<p>Body of page {k} in words of its own, long enough.")) for k in range(12)]
    # a host where one article and its copies are most pages, and one with edited copies of one article
    rows += [(100 + k, "two", page(0, ["", ""], "<p>A line that is copied<p>and another one")) for k in range(30)]
    rows += [(200 + k, "two", page(k, ["", ""], f"<p>Own text {k} of a page")) for k in range(3)]
    rows += [(300 + k, "three", page(0, ["", ""], f"<p>A first paragraph that all of them have<p>and a second one<p>edit {k}")) for k in range(9)]
    # too few different articles for a template, and a line on half of them with a class of its own
    rows += [(400 + k, "four", page(k, share, f"<p>Body {k}")) for k in range(2)]
    rows += [(500 + k, "five", page(k, ["", *(["<p class=y>Read on tomorrow"] if k % 2 else [])], f"<p>Body of page {k} that is longer")) for k in range(10)]
    pages = spark.createDataFrame([(k, f"http://{host}/{k}", html) for k, host, html in rows], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text.split("\n") for r in template.extracted(pages).collect()}
    want = brute.repeated(rows)
    for k, host, html in rows:
        whole = template.main_text(html, frozenset(), None).split("\n")
        gone = {"one": {"Follow us on Foo", "Sign the petition"}, "five": {"Read on tomorrow"}}.get(host, set())
        assert got[k] == [x for x in whole if x not in gone], (k, host)
        assert gone & set(whole) == (want[k] - {"Summary", "Price"} if host in ("one", "five") else set())
        assert host not in ("one",) or len(got[k]) == len(whole) - 2
    assert want[300] and not want[400]


def test_html_odd_rows(spark):
    body = "<nav>n</nav><article><p>Same text</p></article>"
    rows = [(1, "http://h/1", None), (2, None, body), (3, "no url", ""), (4, "http://h/2", "<p>" + LONG), (None, "http://h/3", body), (4, "http://h/2", body)]
    rows += [(100 + k, f"http://copies/{k}", body) for k in range(40)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    found = template.extracted(pages)
    got = collections.Counter((r.page_id, r.url, r.text[:9], r.n_chars) for r in found.collect())
    assert sum(got.values()) == len(rows) and got[(1, "http://h/1", "", 0)] == 1 and got[(3, "no url", "", 0)] == 1 and got[(None, "http://h/3", "Same text", 9)] == 1
    assert all(got[(100 + k, f"http://copies/{k}", "Same text", 9)] == 1 for k in range(40))
    assert template.extracted(pages.limit(0)).count() == 0
