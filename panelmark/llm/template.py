"""Main text of pages by the template their host's pages share.

Tokens of a page are its elements (with the path of elements above them) and its blocks
of text (with their path). A token's occurrence vector says how often each page of the
host has it. Vectors are never brought together: two sums over pages of a hash of
(page, count) stand for one, so tokens with equal sums have equal vectors but for
chance, and both sums are partial sums by (host, token). Tokens of one vector are an
equivalence class. A class is valid if at least ``LEAST_PAGES`` pages, and half of the host's
pages, have it and it has two tokens or more; valid classes nest by their paths into the host's
template. As each of its tokens is on half of the pages, a template is no larger than
twice a page, whatever the number of pages.

Tokens inside article and main elements have vectors of their own, over the host's different
articles instead of its pages: copies of one article count once, so that what is repeated with
an article is not taken for what a host repeats in every article.

What is left of a page between the tokens of its template are slots. Main text is what
slots inside the page's article and main elements hold, other than in elements that
stand around articles by their kind or name. A name that only has a word of such (as in
``page-with-sidebar``) counts if the template has the element and it is not most of the page. Headings, cells
and terms inside an article are its own even if the template has them, and an article of which the slots hold
less than half is an edited copy of others and stays whole. On a page without such an element main text is what
the slots below the template's densest element hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import small_batches, staged
from panelmark.llm.markup import AROUND_IT, HEADINGS, INSIDE, Page, digest, scan

LEAST_PAGES, SHARE = 3, 0.5
#: The densest element holds this share of the text of a host's pages outside links, and no element below it does.
DENSE = 0.6
#: Tokens a task holds before it passes on their sums.
HELD = 100_000
_TOKENS = "host string, token long, path string, article long, pages long, uses long, first long, second long, chars long"
#: Kinds of tokens: elements and texts of a page, elements and texts of its articles.
ELEMENT, TEXT, INNER, OWN = "E", "T", "I", "A"
#: What every page, and every different article, has once: their vectors' pages are a host's numbers of both.
EACH_PAGE, EACH_ARTICLE = digest("pages"), digest("articles")
#: Elements whose text names what follows in an article.
LABELS = HEADINGS | frozenset("th td dt caption figcaption summary".split())


def _text_token(page: Page, block: tuple) -> int:
    return digest(f"{OWN if block[2] >= 0 else TEXT}{page.paths[block[0]] if block[0] >= 0 else ''}\n{block[3]}")


def _is_label(page: Page, block: tuple) -> bool:
    return block[0] >= 0 and re.match("[a-z0-9]*", page.paths[block[0]].rsplit(">", 1)[-1])[0] in LABELS


def _tokens(page: Page) -> Iterator[tuple[int, str | None, int, int, int]]:
    """(token, path of an element, article or 0 for tokens of the page, uses, characters below it)."""
    yield EACH_PAGE, None, 0, 1, 0
    for path, uses, chars in zip(page.paths, page.uses, page.chars):
        yield digest(ELEMENT + path), path, 0, uses, chars
    within = [block for block in page.blocks if block[2] >= 0]
    article = (digest("\n".join(block[3] for block in within)) or 1) if within else 0
    if article:
        yield EACH_ARTICLE, None, article, 1, 0
        for path in sorted(set().union(*(block[5] for block in within))):
            yield digest(INNER + page.paths[path]), None, article, page.uses[path], 0
    texts: dict[tuple[int, int], int] = {}
    for block in page.blocks:
        token = _text_token(page, block), article if block[2] >= 0 else 0
        texts[token] = texts.get(token, 0) + 1
    for (token, of), uses in texts.items():
        yield token, None, of, uses, 0


def token_sums(pages: DataFrame) -> DataFrame:
    """(host, token, path, pages, uses, first, second, chars) of (key, host, html): tokens of pages
    summed over pages, those of articles over the host's different articles."""
    values = ("pages", "uses", "first", "second", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            keys, held = list(sums), np.array(list(sums.values()), np.int64).reshape(len(sums), len(values)).T
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
            sums.clear()
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, held)], ["host", "token", "path", "article", *values])

        for batch in batches:
            for key, host, html in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
                for token, path, article, uses, chars in _tokens(scan(html)):
                    vector = digest(f"{article or key} {uses}")
                    entry = sums.setdefault((host, token, path, article), [0, 0, 0, 0, 0])
                    for k, value in enumerate((1, uses, vector & 0xFFFFFFFF, vector >> 32 & 0xFFFFFFFF, chars)):
                        entry[k] = max(entry[k], value) if article else entry[k] + value
                if len(sums) >= HELD:
                    yield out()
        if sums:
            yield out()

    each = pages.mapInArrow(run, _TOKENS)
    once = [F.when(F.col("article") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in values]
    each = each.groupBy("host", "token", "article").agg(F.max("path").alias("path"), *once)
    of_articles = F.max(F.col("article") != 0).alias("of_articles")
    return each.groupBy("host", "token").agg(F.max("path").alias("path"), of_articles, *(F.sum(c).alias(c) for c in values))


def templates(sums: DataFrame) -> DataFrame:
    """(host, tokens: array<long>, dense: string) from token sums. What is on fewer than
    ``LEAST_PAGES`` pages, which most texts are, is left out before the sums are written and read twice."""
    often = staged(sums.filter(F.col("pages") >= LEAST_PAGES), "tokens")
    totals = often.filter(F.col("token").isin(EACH_PAGE, EACH_ARTICLE)).select("host", "of_articles", F.col("pages").alias("in_all"))
    often = often.join(totals, ["host", "of_articles"]).filter(F.col("pages") >= SHARE * F.col("in_all"))
    vector = ["host", "pages", "uses", "first", "second"]
    classes = often.groupBy(*vector).agg(
        F.collect_list("token").alias("tokens"),
        F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "chars"))).alias("elements"),
    ).filter(F.size("tokens") >= 2)
    whole = classes.groupBy("host").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"),
        # an element that each of its pages has once can be the one an article stands in
        F.flatten(F.collect_list(F.when(F.col("pages") == F.col("uses"), F.col("elements")))).alias("elements"),
    )
    most = F.array_max(F.transform("elements", lambda e: e["chars"]))
    dense = F.filter("elements", lambda e: e["chars"] >= DENSE * most)
    deepest = F.array_max(F.transform(dense, lambda e: F.struct(F.size(F.split(e["path"], ">")).alias("depth"), e["chars"].alias("chars"), e["path"].alias("path"))))
    return whole.select("host", "tokens", F.when(most > 0, deepest["path"]).alias("dense"))


def main_text(html: str, tokens: frozenset[int], dense: str | None) -> str:
    page = scan(html)
    total = sum(max(0, len(b[3]) - b[4]) for b in page.blocks)
    # elements whose name only has a word of what stands around are around if the template has them and they are not most of the page
    around = {p for b in page.blocks for p in b[6] if 2 * page.chars[p] < total and digest(ELEMENT + page.paths[p]) in tokens}
    shown = [b for b in page.blocks if b[1] != AROUND_IT and not around.intersection(b[6])]
    blocks = [b for b in shown if b[1] == INSIDE]
    within = [b for b in blocks if b[2] >= 0]
    if not within:  # what holds most of the page's text is no surrounding, whatever its name
        named = [b for b in shown if b[2] >= 0]
        within = named if 2 * sum(max(0, len(b[3]) - b[4]) for b in named) > total else []
    if tokens and within:
        slots = [b for b in within if _is_label(page, b) or _text_token(page, b) not in tokens]
        if 2 * sum(len(b[3]) for b in slots) >= sum(len(b[3]) for b in within):
            within = slots
    if within:
        sizes: dict[int, list[int]] = {}
        for b in within:
            size = sizes.setdefault(b[2], [0, 0])
            size[0], size[1] = size[0] + len(b[3]), size[1] + b[4]
        largest = max(sizes, key=lambda a: (sizes[a][0] - sizes[a][1], -a))
        # further articles that are mostly links are teasers of other pages
        return "\n".join(b[3] for b in within if b[2] == largest or 2 * sizes[b[2]][1] <= sizes[b[2]][0])
    slots = [b for b in blocks if _text_token(page, b) not in tokens and 2 * b[4] <= len(b[3])]
    if dense is not None and dense in page.paths:
        below = page.paths.index(dense)
        inside = [b for b in slots if below in b[5]]
        slots = inside or slots
    return "\n".join(b[3] for b in slots)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, and
    blocks follow each other by line breaks in the order of the page. A null html is
    empty and gives an empty text. A null or hostless url makes one host of all such
    pages; hosts of few pages have no template. Null and repeated ids are pages of
    their own. A host may have any share of all pages: its tokens are summed before they are
    shuffled, and its template is joined to its pages by Spark's choice, which broadcasts
    templates only below its checked size. Other columns are not read; no rows give no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host"),
    )
    keyed = rows.select(F.xxhash64("page_id", "url").alias("key"), "host", "html")
    found = staged(templates(token_sums(keyed)), "templates")
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "tokens", "dense")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for batch in batches:
            texts = []
            for k, html in enumerate(batch.column("html").to_pylist()):
                tokens = batch.column("tokens")[k]
                raw = tokens.values.to_numpy() if tokens.is_valid else None
                if raw is None:
                    mine: frozenset[int] = frozenset()
                elif last[0] is not None and np.array_equal(last[0], raw):
                    mine = last[1]
                else:
                    mine = frozenset(raw.tolist())
                    last = (raw, mine)
                texts.append(main_text(html, mine, batch.column("dense")[k].as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(rows.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
