"""Personal data: fixed rules, and boosted trees over overlapping candidate spans.

Everything on the way from text to spans is a DataFrame expression inside the row of
its document: no shuffle, whatever the skew.

Four rules (BASE) find spans that always count. Four looser generators propose spans of
the same kinds and near misses (dotted names, dotted numbers of any length, long numbers), which
may overlap the others. Trees, one set a kind, give each candidate the odds that a span of such a
format in such surroundings passes the rule's checks; the checks themselves (Luhn, numbers up
to 255, the at sign, the plus sign) are not among the features. A kind's odds are calibrated
on candidates the trees have not seen (cross-fitting, then a rising curve of shares), and its
threshold is the lowest score from which on at least ``PRECISION`` of them pass. So a mistyped
number that looks in all else like the valid ones is taken too, and where the shape says little
(most long numbers are no cards) nothing is added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm import boosting
from panelmark.llm.common import hashed_share
from panelmark.session import settled

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
# The patterns of the rules, anchored so that a long run is not tried from each of its
# characters: where a match could not begin earlier in a run, it cannot begin later in it
# either, except right after the match before (\G). A run of digits can be taken whole
# since no digit follows it. The card pattern is the rule's with its count of digits.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HOST = "[A-Za-z0-9-]++"
LOOSE = {
    # an address in any of its spellings, or else a dotted name
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{_HOST}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_HOST})*+"
             rf"|(?<![A-Za-z0-9._%+@-]){_HOST}(?:\.{_HOST})++(?![@_%+(\[])",
    "ip": r"[0-9](?<![0-9A-Za-z.][0-9])[0-9]{0,3}+(?:\.[0-9]{1,4}+){1,5}+(?![0-9A-Za-z])",
    "card": r"[0-9](?<![0-9A-Za-z][0-9])(?:[\x20./-]?[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?:\+|00)?+\(?+[0-9](?<![0-9A-Za-z][0-9])(?:[\x20().-]{0,2}+[0-9]){8,14}+(?![0-9A-Za-z])",
}
#: Spellings that only the generators know: the rules say nothing about them, so they are no lesson for the trees.
OWN = {"email": r"[\x20(\[]", "ip": "^$", "card": "[./]", "phone": "^00"}
#: Numbers up to 255, as text of any length.
_OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)(?:\.|$)){4}$"
_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|adresse|correo)\b", "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|pay)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon)\b",
}
FEATURES = [
    "n_chars", "n_digits", "n_letters", "n_spaces", "n_dots", "n_dashes", "n_brackets", "n_groups", "first_group", "last_group",
    "word_before", "glued_before", "glued_after", "assigned", "starts_line",
]
#: Candidates of each kind the trees are fitted on at most, those with the smallest hashes; characters of context; numbers of a block of sums.
TRAIN_CANDIDATES, CONTEXT, BLOCK = 2000, 24, 256
#: Documents, those with the smallest hashed ids, in which these candidates are looked for.
TRAIN_DOCUMENTS = 100_000
PRECISION = 0.95
_ROUNDS, _DEPTH, _FOLDS = 16, 3, 4


def _before(values: Column, together, nothing: int = 0) -> Column:
    """For each number of an array the sum (or maximum, ...) of those before it, by blocks."""
    fold = lambda a: F.aggregate(a, F.lit(nothing).cast("long"), together)
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: F.slice(values, at + 1, BLOCK))
    folded = F.transform(starts, lambda at: fold(F.slice(values, at + 1, BLOCK)))
    heads = F.transform(F.sequence(F.lit(0), F.size(folded) - 1), lambda i: fold(F.slice(folded, F.lit(1), i)))
    inner = lambda block, head: F.transform(block, lambda _v, i: together(head, fold(F.slice(block, F.lit(1), i))))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, heads, inner))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    return F.length(_digits(value)).between(9, 15)


def _matches(df: DataFrame, patterns: dict[str, str], label: str) -> DataFrame:
    """Adds ``{label}_{kind}``: array<struct<start, end, value, before, after>> of all matches."""
    made = []
    for kind in KINDS:
        named = F.col("_mail") | F.col("_dotted") if label == "loose" else F.col("_mail")
        text = F.when(named if kind == "email" else F.col("_digit"), F.col("_text")).otherwise("")
        gap = lambda g: F.struct(F.char_length(g).cast("long").alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head"))
        df = df.withColumn(f"_found_{kind}", F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0)))
        df = df.withColumn(f"_gaps_{kind}", F.transform(F.split(text, patterns[kind], -1), gap))
        made += [f"_found_{kind}", f"_gaps_{kind}"]
    df = settled(df, *made)
    starts = []
    for kind in KINDS:
        found, gaps = F.col(f"_found_{kind}"), F.col(f"_gaps_{kind}")
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: g["n"] + F.char_length(f))
        df = df.withColumn(f"_sizes_{kind}", sizes)
        starts += [f"_sizes_{kind}", f"_before_{kind}"]
    df = settled(df, *starts[::2])
    for kind in KINDS:
        df = df.withColumn(f"_before_{kind}", _before(F.col(f"_sizes_{kind}"), lambda x, y: x + y))
    df = settled(df, *starts[1::2])
    for kind in KINDS:
        gaps, before = F.col(f"_gaps_{kind}"), F.col(f"_before_{kind}")

        def span(value: Column, i: Column) -> Column:
            gap, after = F.get(gaps, i), F.get(gaps, i + 1)
            start = F.get(before, i) + gap["n"]
            return F.struct(
                start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), gap["tail"].alias("before"), after["head"].alias("after"),
                (gap["n"] == 0).alias("bare"),
            )

        df = df.withColumn(f"{label}_{kind}", F.transform(F.col(f"_found_{kind}"), span))
    return settled(df, *(f"{label}_{kind}" for kind in KINDS)).drop(*made, *starts)


def _features(kind: str, c: Column) -> Column:
    """struct<start, end, own, FEATURES...> of one candidate: its format, and what stands around it."""
    value, before, after = c["value"], c["before"], c["after"]
    count = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", ""))
    group = lambda at: F.length(F.regexp_extract(value, at, 1))
    flag = lambda x: x.cast("int")
    of = {
        "n_chars": F.char_length(value), "n_digits": count("0-9"), "n_letters": count("A-Za-z"), "n_spaces": count(r"\x20"), "n_dots": count("."),
        "n_dashes": count("-/"), "n_brackets": count(r"()\[\]"), "n_groups": F.size(F.split(value, "[^0-9A-Za-z]+", -1)),
        "first_group": group("^[^0-9A-Za-z]*([0-9A-Za-z]+)"), "last_group": group("(?<![0-9A-Za-z])([0-9A-Za-z]++)$"),
        "word_before": flag(before.rlike(_WORDS[kind])), "glued_before": flag(before.rlike("[^\\s(\"'<,;:]$")), "glued_after": flag(after.rlike("^[^\\s)\"'>,;:.!?]")),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")), "starts_line": flag(before.rlike("^$|\n$")),
    }
    own = value.rlike(OWN[kind]).alias("own")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), own, *(of[f].cast("double").alias(f) for f in FEATURES))


def _texts(df: DataFrame, text_col: str, *others: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.select(*others, text.alias("_text"))
    mail = F.instr("_text", "@") + F.instr("_text", "(at)") + F.instr("_text", "[at]") > 0
    dotted = F.col("_text").rlike(r"[A-Za-z0-9]\.[A-Za-z0-9]")
    return settled(df.withColumns({"_mail": mail, "_digit": F.col("_text").rlike("[0-9]"), "_dotted": dotted}), "_text", "_mail", "_digit", "_dotted")


def _base(df: DataFrame) -> DataFrame:
    """Adds ``base_{kind}``: array<struct<start, end>> of the rule's spans."""
    df = _matches(df, BASE, "base")
    for kind in KINDS:
        passing = F.filter(F.col(f"base_{kind}"), lambda c: _valid(kind, c["value"]))
        df = df.withColumn(f"base_{kind}", F.transform(passing, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    return settled(df, *(f"base_{kind}" for kind in KINDS))


def _candidates(df: DataFrame) -> DataFrame:
    """Adds ``loose_{kind}``: array<struct<start, end, own, FEATURES...>> of the generators' spans."""
    df = _matches(df, LOOSE, "loose")
    for kind in KINDS:
        df = df.withColumn(f"loose_{kind}", F.transform(F.col(f"loose_{kind}"), lambda c: _features(kind, c)))
    return settled(df, *(f"loose_{kind}" for kind in KINDS))


def rising_shares(scores: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest score, share of hits) of blocks of rising score, pooled until the share rises too (isotonic regression)."""
    order = np.argsort(scores, kind="stable")
    low, total, good = [], [], []
    for score, hit in zip(scores[order].tolist(), hits[order].tolist()):
        if low and score == last:  # noqa: F821  equal scores are one block
            total[-1], good[-1] = total[-1] + 1, good[-1] + hit
        else:
            low, total, good = [*low, score], [*total, 1], [*good, hit]
        last = score
    at = 1
    while at < len(low):
        if good[at] * total[at - 1] <= good[at - 1] * total[at]:
            total[at - 1] += total.pop(at)
            good[at - 1] += good.pop(at)
            low.pop(at)
            at = max(1, at - 1)
        else:
            at += 1
    return np.array(low), np.array(good, float) / np.maximum(np.array(total, float), 1)


def _threshold(scores: np.ndarray, hits: np.ndarray) -> float:
    """The lowest score whose calibrated share is ``PRECISION``, and from which on candidates pass that often
    (one hit and one miss are added to their count, so a handful proves nothing); infinite if there is none."""
    low, share = rising_shares(scores, hits)
    for t in low[share >= PRECISION]:
        above = scores >= t
        if (hits[above].sum() + 1) / (above.sum() + 2) >= PRECISION:
            return float(t) - 1e-9
    return math.inf


def fit_models(df: DataFrame, id_col: str, text_col: str, most: int = TRAIN_CANDIDATES) -> dict[str, tuple[boosting.Trees, float]]:
    """(trees, threshold) by kind, from at most ``most`` candidates of each kind in about ``TRAIN_DOCUMENTS`` documents.

    A candidate's label is whether it is a span of the rules; spellings only the generators know have none.
    Only the sample is bounded: spans are looked for in every text. Each candidate is scored by trees fitted
    without its fold, and these scores give the threshold of the trees fitted on all. A kind of which the
    sample has only one label has no trees; one without a threshold that is precise enough adds nothing.
    """
    documents = hashed_share(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", TRAIN_DOCUMENTS)
    rows = _candidates(_base(_texts(documents, "text", F.col("id"))))
    each = []
    for number, kind in enumerate(KINDS):
        # the rule's spans and the candidates in one order: a candidate is good if the rule's span of its place stands before it
        place = lambda c: (c["start"].alias("start"), c["end"].alias("end"))
        none = F.transform(F.slice(f"loose_{kind}", 1, 0), lambda c: F.struct(*place(c), F.lit(0).alias("loose"), c.alias("c")))
        ruled = F.transform(f"base_{kind}", lambda b: F.struct(*place(b), F.lit(0).alias("loose"), F.get(none, F.lit(0))["c"].alias("c")))  # noqa: B023
        loose = F.transform(f"loose_{kind}", lambda c: F.struct(*place(c), F.lit(1).alias("loose"), c.alias("c")))
        rows = settled(rows.withColumn(f"_all_{kind}", F.array_sort(F.concat(ruled, loose))), f"_all_{kind}")
        every = F.col(f"_all_{kind}")
        good = lambda x, i: (F.get(every, i - 1)["start"] == x["start"]) & (F.get(every, i - 1)["end"] == x["end"])  # noqa: B023, E731
        each.append(F.transform(every, lambda x, i: F.struct(
            F.lit(number).alias("kind"), F.coalesce(good(x, i), F.lit(False)).cast("int").alias("good"), x["loose"].alias("loose"), x["c"].alias("c"))))  # noqa: B023
    found = rows.select("id", F.explode(F.concat(*each)).alias("x")).filter("x.loose = 1 AND (x.good = 1 OR NOT x.c.own)")
    found = found.select("x.kind", "x.good", F.xxhash64("id", "x.c.start", "x.kind").alias("key"), *(F.col(f"x.c.{f}") for f in FEATURES))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("key", *FEATURES, "good"))
    sample = found.withColumn("turn", turn).filter(F.col("turn") <= most).orderBy("kind", "turn").collect()
    models = {}
    for number, kind in enumerate(KINDS):
        mine = [r for r in sample if r["kind"] == number]
        x = np.array([[r[f] for f in FEATURES] for r in mine]).reshape(len(mine), len(FEATURES))
        y, key = np.array([r["good"] for r in mine], int), np.array([r["key"] for r in mine], np.int64)
        if len(set(y.tolist())) < 2:
            continue
        fold = boosting.folds(key, _FOLDS)
        odds = np.zeros(len(mine))
        for k in range(_FOLDS):
            rest, held = fold != k, fold == k
            if rest.any() and held.any():
                odds[held] = boosting.fit(x[rest], y[rest], rounds=_ROUNDS, depth=_DEPTH, rate=0.3).margin(x[held])
        models[kind] = (boosting.fit(x, y, rounds=_ROUNDS, depth=_DEPTH, rate=0.3), _threshold(odds, y))
    return models


def _accepted(df: DataFrame, models: dict[str, tuple[boosting.Trees, float]]) -> DataFrame:
    """Adds ``added``: array<struct<start, kind, end, odds>> of candidates over their threshold that
    touch no span of the rules and no accepted candidate of higher odds."""
    kept = []
    models = {k: m for k, m in models.items() if m[1] < math.inf}
    for kind, (trees, threshold) in models.items():
        odds = lambda c: trees.expression(lambda i: c[FEATURES[i]])
        scored = F.transform(F.col(f"loose_{kind}"), lambda c: F.struct(
            c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"), odds(c).alias("odds")))
        df = settled(df.withColumn(f"_scored_{kind}", scored), f"_scored_{kind}")
        kept.append(F.filter(F.col(f"_scored_{kind}"), lambda c: c["odds"] >= threshold))
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,odds:double>>)")
    df = settled(df.withColumn("_over", F.array_sort(F.concat(empty, *kept))), "_over")
    df = _clear_of_base(df)
    # candidates that touch, directly or through others, are a chain; only those of one chain are compared
    df = settled(df.withColumn("_reach", _before(F.transform("_free", lambda c: c["end"]), lambda x, y: F.greatest(x, y))), "_reach")
    heads = F.filter(F.transform("_free", lambda c, i: F.when(c["start"] >= F.get("_reach", i), i)), lambda i: i.isNotNull())
    df = settled(df.withColumn("_heads", heads), "_heads")
    chains = F.transform("_heads", lambda h, i: F.slice("_free", h + 1, F.coalesce(F.get("_heads", i + 1), F.size("_free")) - h))
    df = settled(df.withColumn("_chains", chains), "_chains")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (a["odds"] > b["odds"]) | ((a["odds"] == b["odds"]) & (F.struct(a["start"], a["kind"]) < F.struct(b["start"], b["kind"])))
    best = lambda chain: F.filter(chain, lambda c: ~F.exists(chain, lambda o: meets(o, c) & better(o, c)))
    added = F.flatten(F.transform("_chains", best))
    return settled(df.withColumn("added", added), "added").drop("_over", "_free", "_reach", "_heads", "_chains", *(f"_scored_{k}" for k in models))


def _clear_of_base(df: DataFrame) -> DataFrame:
    """Adds ``_free``: those of ``_over`` that touch no span of ``base``; both are sorted once, together.

    A candidate touches one that starts before it if the furthest end of these lies behind its start, and
    one that starts with or after it if the nearest of these starts lies before its end.
    """
    one = lambda c, base, odds: F.struct(c["start"].alias("start"), F.lit(base).alias("base"), c["kind"].alias("kind"), c["end"].alias("end"), odds.alias("odds"))
    both = F.concat(F.transform("base", lambda c: one(c, 1, F.lit(0.0))), F.transform("_over", lambda c: one(c, 0, c["odds"])))
    df = settled(df.withColumn("_both", F.array_sort(both)), "_both")
    far = F.expr("bigint(9223372036854775807)")
    df = df.withColumn("_ends", F.transform("_both", lambda c: F.when(c["base"] == 1, c["end"]).otherwise(F.lit(0).cast("long"))))
    df = df.withColumn("_starts", F.reverse(F.transform("_both", lambda c: F.when(c["base"] == 1, far - c["start"]).otherwise(F.lit(0).cast("long")))))
    df = settled(df, "_ends", "_starts")
    df = df.withColumn("_reach", _before(F.col("_ends"), lambda x, y: F.greatest(x, y)))
    df = df.withColumn("_next", F.reverse(_before(F.col("_starts"), lambda x, y: F.greatest(x, y))))
    df = settled(df, "_reach", "_next")
    clear = lambda c, i: (c["base"] == 0) & (F.get("_reach", i) <= c["start"]) & (far - F.get("_next", i) >= c["end"])
    free = F.transform(F.filter("_both", clear), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["odds"].alias("odds")))
    return settled(df.withColumn("_free", free), "_free").drop("_both", "_ends", "_starts", "_reach", "_next")


def find_spans(df: DataFrame, models: dict, text_col: str, *others: Column) -> DataFrame:
    """(others..., _text, base, spans): arrays of struct<start, kind, end>, by start, then kind.

    ``base`` holds the rules' spans, ``spans`` those and the added ones; places count
    code points, ends are exclusive. A null text is empty and has no spans. Only the
    text and the columns in ``others`` are read.
    """
    df = _candidates(_base(_texts(df, text_col, *others)))
    of = [F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))) for i, k in enumerate(KINDS)]
    df = settled(df.withColumn("base", F.array_sort(F.concat(*of))), "base")
    df = _accepted(df, models)
    plain = F.transform("added", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    df = settled(df.withColumn("spans", F.array_sort(F.concat("base", plain))), "spans")
    return df.drop("added", *(f"{label}_{k}" for label in ("base", "loose") for k in KINDS))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text_col: str, spans_col: str, name: str) -> DataFrame:
    """Adds ``name``: the text with each span, or chain of overlapping spans, as its first kind's name in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, spans = F.col(text_col), F.col(spans_col)
    df = settled(df.withColumn("_ends", F.transform(spans, lambda s: s["end"])), "_ends")
    df = settled(df.withColumn("_reach", _before(F.col("_ends"), lambda x, y: F.greatest(x, y))), "_reach")
    # sorted spans: one that starts at or after the furthest end before it begins a chain
    placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get("_reach", i).alias("reach")))
    df = settled(df.withColumn("_heads", F.filter(placed, lambda h: h["start"] >= h["reach"])), "_heads")
    # and what it reaches past is where the chain before it ended
    pieces = F.transform("_heads", lambda h: F.concat(F.substring(text, (h["reach"] + 1).cast("int"), (h["start"] - h["reach"]).cast("int")), F.get(names, h["kind"])))
    tail = F.substring(text, (F.array_max("_ends") + 1).cast("int"), F.char_length(text))
    return settled(df.withColumn(name, F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))), name).drop("_ends", "_reach", "_heads")
