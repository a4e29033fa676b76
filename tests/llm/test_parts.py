"""Pieces that need no Spark."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelmark.llm import boosting, markup, near, packing, quality, records, template, tokens, warc
from panelmark.llm.common import slices
from tests.llm import brute

LETTERS = [*"ab'st Z9*!\n\t  　é日<|>.-_\x1c\x85", "<|endoftext|>", "'re", "  ", "don't", "\U0001f600"]


def made(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, most))) for _ in range(n)]


def test_forced_boundaries_give_the_library_s_ids(library):
    texts = [*made(1, 8000), "", "x" * 5000, " " * 3000 + "y"]
    model = tokens.encoder(tokens.default_path())
    found = [ids for _l, _h, data, offsets in slices(pa.array(texts), 4000) for ids in model.encode(data, offsets)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in want]
    decoded = [model.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in found]
    assert decoded == [library.decode(e.ids, skip_special_tokens=False) for e in want]


def test_a_slice_s_repeated_fragments_are_looked_up_once():
    model, seen = tokens.Encoder(tokens.default_path()), []

    class Known(dict):
        def get(self, key):
            seen.append(key)
            return super().get(key)

    model.known = Known()
    texts = [None, "", *["the same few words again and again"] * 500, ""]
    [(_l, _h, data, offsets)] = slices(pa.array(texts))
    found = model.encode(data, offsets)
    assert len(seen) == len(set(seen)) < 20 and found[0] == found[1] == found[-1] == b""
    want = model.library.encode(texts[2], add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in found[2:-1]] == [want] * 500


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    model, texts = tokens.Encoder(tokens.default_path()), made(2, 500)
    found = [ids for _l, _h, data, offsets in slices(pa.array(texts), 200) for ids in model.encode(data, offsets)]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(model.known) <= 3


def test_counts_of_documents():
    texts = [*made(3, 600, 80), "a b c a b c\nx\nx\n \nx", None, "", "é é é é"]
    found = [{k: v[i] for k, v in c.items()} for _l, _h, d, o in slices(pa.array(texts), 500) for c in [quality.measure(d, o)] for i in range(len(o) - 1)]
    assert [tuple(int(c[k]) for k in quality.COUNTS[:5]) for c in found] == [brute.quality(t) for t in texts]


def test_trees_keep_to_their_constraints_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (x[:, 0] + 0.1 * np.sin(20 * x[:, 0]) > 0.5) & (x[:, 1] < 0.8)
    trees = boosting.fit(x, y, monotone=[1, -1, 0])
    assert ((trees.margin(x) > 0) == y).mean() > 0.95  # the rule itself is not monotonic
    for feature, sign in ((0, 1), (1, -1)):
        line = np.tile(rng.random(3), (200, 1))
        line[:, feature] = np.linspace(0, 1, 200)
        assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()


def test_regions_split_only_where_dense():
    hashes = np.sort(np.random.default_rng(1).integers(0, 3, (5000, 6)).astype(np.uint32).view("u4,u4,u4,u4,u4,u4"), axis=0).view(np.uint32).reshape(-1, 6)
    parts = list(near._regions(hashes, 0, 5000, 1))
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == 5000
    assert max(b - a for a, b in parts) <= near.REGION


def _alike_rows(seed, n):
    """Rows of one tree with sketches of which very many look alike, and the pairs that do in regions of equal first hash."""
    rng = np.random.default_rng(seed)
    hashes = np.repeat(rng.integers(0, 9, (n // 50, near.DEPTH)), 50, axis=0).astype(np.uint32)
    hashes = hashes[np.lexsort(hashes.T[::-1])]
    kinds = rng.integers(0, 256, (4, near.SKETCH))
    sketch = kinds[rng.integers(0, 4, n)].astype(np.uint8)
    noise = rng.random(sketch.shape) < rng.random((n, 1)) * 0.25
    sketch[noise] = rng.integers(0, 256, int(noise.sum()))
    same = hashes[:, None, 0] == hashes[None, :, 0]
    equal = (sketch[:, None] == sketch[None]).sum(axis=2)
    one, other = np.nonzero(np.triu(same & (equal >= near._least(85)), 1))
    return hashes, np.full(n, 100), sketch, dict(zip(zip(one.tolist(), other.tolist()), equal[one, other].tolist()))


def _pairs(found):
    return [(min(a, b), max(a, b), r) for one, other, rank in found for a, b, r in zip(one.tolist(), other.tolist(), rank.tolist())]


def test_trees_and_depth_follow_the_threshold():
    assert near.forest(85) == (10, 6) and near.forest(80) == (16, 6)
    for percent in range(10, 100):
        trees, depth = near.forest(percent)
        assert 1 - (1 - (percent / 100) ** depth) ** trees >= near.RECALL and trees * depth <= near.HASHES


def test_pairs_not_proposed_are_between_marked_nodes():
    *rows, alike = _alike_rows(3, 800)
    found = _pairs(near.propose(*rows, 85))
    proposed = {(a, b) for a, b, r in found if r != near.LEFT}
    marked = {a for a, b, r in found if r == near.LEFT}
    assert proposed <= set(alike) and len(alike) > 2 * len(proposed)
    assert all(a in marked and b in marked for a, b in set(alike) - proposed)


def test_every_two_components_are_proposed_by_their_most_alike():
    hashes, sizes, sketch, alike = _alike_rows(4, 800)
    for kinds in (1, 2, 30, 800):
        labels = np.random.default_rng(kinds).integers(0, kinds, 800)
        two = lambda a, b: (int(hashes[a, 0]), *sorted((int(labels[a]), int(labels[b]))))
        want = {}
        for (a, b), equal in alike.items():
            if labels[a] != labels[b]:
                want[two(a, b)] = max(equal, want.get(two(a, b), 0))
        found = [(a, b) for a, b, _ in _pairs(near.propose_across(hashes, sizes, sketch, labels, 85))]
        assert len(found) == len(want) and {two(a, b): alike[a, b] for a, b in found} == want


def test_equal_signatures_beyond_a_region_are_marked_and_compared():
    n = 3 * near.REGION
    hashes, sizes, sketch = np.ones((n, near.DEPTH), np.uint32), np.full(n, 50), np.zeros((n, near.SKETCH), np.uint8)
    marked = {int(a) for one, other, rank in near.propose(hashes, sizes, sketch, 85) for a in one[rank == near.LEFT]}
    assert marked == set(range(n))
    labels = np.zeros(n, np.int64)
    labels[[5, n - 5]] = 1, 2
    found = [(a, b) for a, b, _ in _pairs(near.propose_across(hashes, sizes, sketch, labels, 85))]
    assert len(found) == 3
    unlike = np.random.default_rng(0).integers(0, 256, (40, near.SKETCH)).astype(np.uint8)
    assert not _pairs(near.propose_across(hashes[:40], sizes[:40], unlike, np.arange(40), 85))


def test_powers_of_two_need_no_padding():
    parts = [(k, 0, 700, np.arange(300, dtype="<u4") + k) for k in range(3)]
    found = list(packing._powers(parts))
    assert [sum(len(p[3]) for p in s) for s in found] == [512, 256, 128, 4]
    assert np.concatenate([p[3] for s in found for p in s]).tolist() == np.concatenate([p[3] for p in parts]).tolist()


def test_damaged_records_are_noticed():
    data = records.frame(7, np.array([1, 70_000], "<u4")) + records.frame(None, np.array([], "<u4"))
    doc_id, ids, at = records.unframe(memoryview(data), 0)
    assert (doc_id, ids.tolist()) == (7, [1, 70_000]) and records.unframe(memoryview(data), at)[0] is None
    for place in (3, 9, 15, at - 2):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe(memoryview(bytes(broken)), 0)


def test_warc_records_are_inflated_only_as_far_as_needed():
    payload = random.Random(4).randbytes(200_000)
    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = engine.compress(warc.record(5, "http://a.example/\r\nx", payload, "d" * 64, len(payload), None)) + engine.flush()
    row = warc.parse(raw, lambda r: r["record_type"] == "response", True)
    assert row[2] == 5 and row[6] == len(payload) and row[8] == payload and "\r" not in row[3]
    assert warc.parse(raw, lambda r: r["record_type"] == "revisit", True) is None
    member = warc._Member(raw)
    member.until(b"\r\n\r\n")
    assert len(member.seen) < 2000
    assert warc.member_places(io.BytesIO(raw * 3)) == [k * len(raw) for k in range(4)]


PAGE = (
    "<html><head><title>t</title><script>var a='</p><nav>';</script><body class='has-sidebar'><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>"
    "<div id=cookie-notice>We use cookies</div><article class=post><header><h1>Head &amp; more</h1></header><p>One<br>two <b>bold&nbsp;text</b><p>Three &lt;tag&gt;"
    "<div class='ad-slot'>Buy</div><aside>Side</aside><ul><li>First<li>Second</ul><form><input>Mail me</form><section class=comments><p>Nice</section>"
    "<!-- gone <p>hidden</p> --><style>p{}</style></article><footer>&copy; x</footer>"
)


def test_what_stands_around_an_article_is_left_out():
    assert template.main_text(PAGE, frozenset(), None) == "Head & more\nOne two bold text\nThree <tag>\nFirst\nSecond"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='content-sidebar-wrap'><main><p>Body</main><div class=sidebar>Side</div></div>", "Body"),
        ("<div id='page-with-sidebar'><article><p>Body</article><div class='widget'>W</div></div>", "Body"),
        ("<div class='sidebar'><main><p>Body</main></div>", "Body"),
        ("<div class='social'><article><p>Body of the page</article></div><p>x", "Body of the page"),
        ("<article><h2 id='related-work'>Related</h2><p>One<section id='search-algorithms'><p>Two</section><h3 id=notice>N</h3></article>", "Related\nOne\nTwo\nN"),
        ("<article><p>Body</article><div class=comments><article>Nice</article></div>", "Body"),
    ],
)
def test_names_with_a_word_of_what_stands_around_do_not_drop_the_article(html, want):
    assert template.main_text(html, frozenset(), None) == want


def test_the_template_decides_on_elements_whose_name_only_has_a_word_of_what_stands_around():
    html = "<article><p>Some longer body text<div class='story-newsletter'>Mail</div></article>"
    token = markup.digest(f"{template.ELEMENT}>article>div.story-newsletter")
    assert template.main_text(html, frozenset(), None).endswith("Mail")
    assert template.main_text(html, frozenset([token]), None) == "Some longer body text"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<main><h1>Title</h1><p>Lead</p><article>Body of it</article></main>", "Title\nLead\nBody of it"),
        ("<main><h1>Title</h1><p>Lead that is longer</p><article>Body</article></main>", "Title\nLead that is longer\nBody"),
        ("<article><p>First half</article><article><p>Second</article>", "First half\nSecond"),
        ("<article><p>First half</article><article class=comment><p>Nice one, very good</article>", "First half"),
        ("<article><p>First half</article><article><a href=/x>Another page</a></article>", "First half"),
    ],
)
def test_all_article_elements_of_a_page_are_kept(html, want):
    assert template.main_text(html, frozenset(), None) == want


@pytest.mark.parametrize("html", ["", "<", "<p", "a < b", "<!--", "<script>", "</p></div>", "<a href='x", "&#0;&bogus;", "<article>", "<p>" * 3000, "<div>" * 300 + "x"])
def test_broken_pages_do_not_fail(html):
    markup.scan(html)
    assert isinstance(template.main_text(html, frozenset(), ">p"), str)


def test_two_components_are_proposed_only_if_their_sets_may_be_linked():
    """Sets that all look alike by their sketch, of which few are links: pairs don't grow with the square of their number."""
    n, rng = 300, np.random.default_rng(6)
    fine = np.zeros((n, near.FINE), np.uint8)
    for row in fine:  # 100 of 115 shingles: two sets share about 87 of 113
        row.view("<u4")[:100] = np.sort(rng.permutation(115)[:100] + 1)
    fine[[7, 90, 200]] = fine[5], fine[4], fine[4]
    hashes, sizes, sketch = np.ones((n, near.DEPTH), np.uint32), np.full(n, 100), np.zeros((n, near.SKETCH), np.uint8)
    labels = np.arange(n)
    labels[200] = 90
    sets = [set(row.view("<u4")[:100].tolist()) for row in fine]
    links = {(a, b) for a in range(n) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    found = [(max(a, b), min(a, b)) for a, b, _ in _pairs(near.propose_across(hashes, sizes, sketch, labels, 85, fine, best=True))]
    assert set(found) <= links and {(7, 5), (90, 4)} <= set(found) and (200, 4) not in found
    two = lambda some: {frozenset((int(labels[a]), int(labels[b]))) for a, b in some if labels[a] != labels[b]}
    assert two(found) == two(links) and len(found) == len(two(links)) < n * n / 20


@pytest.mark.parametrize("size", [100, near.WHOLE, near.WHOLE + 1, 3000])
def test_all_pairs_across_are_proposed_but_those_the_finer_sketches_rule_out(size):
    hashes, _sizes, sketch, alike = _alike_rows(6, 400)
    labels, sizes = np.arange(400) % 3, np.full(400, size)
    fine = np.ones((400, near.FINE), np.uint8)
    fine[::2] = 2  # nodes of odd and even place have nothing in common
    found = [(a, b) for a, b, _ in _pairs(near.propose_across(hashes, sizes, sketch, labels, 85, fine))]
    assert sorted(found) == sorted((a, b) for a, b in alike if labels[a] != labels[b] and a % 2 == b % 2)


def test_finer_sketches_lose_no_link(spark):
    rng = np.random.default_rng(8)
    for size in (40, 200, 250, 600, 5000):
        base, rows, nodes = rng.integers(0, 2**63, size).astype(np.uint64), [], []
        for k in range(60):
            own = int(size * rng.random() * 0.2)
            nodes.append(np.concatenate([base[own:], rng.integers(0, 2**63, own + k % 9).astype(np.uint64)]))
            rows.append((bytes([k]), np.sort(nodes[-1]).tobytes()))
        found = {r.node[0]: r.fine for r in near._fine_sketches(spark.createDataFrame(rows, "node binary, shingles binary")).collect()}
        fine = np.stack([np.frombuffer(found[k], np.uint8) for k in range(60)])
        sizes, ruled_out = np.array([len(x) for x in nodes]), 0
        for k in range(59):
            rest = np.arange(k + 1, 60)
            common = np.array([len(np.intersect1d(nodes[k], nodes[j])) for j in rest])
            link = 100 * common >= 85 * (sizes[k] + sizes[rest] - common)
            near_ = near._finely(fine, sizes, np.full(len(rest), k), rest, 85)
            assert near_[link].all()
            ruled_out += (~near_).sum()
            if size == 200:
                assert (near_ == link).all()
        assert ruled_out
