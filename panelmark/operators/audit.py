"""Written answers against the evidence they cite.

An answer and its evidence payload are one row each and meet on ``answer_id``, which
is unique; everything after that join works inside the row, so no figures of two
answers ever meet and no answer needs a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.functions import phrases as H
from panelmark.functions import words as V
from panelmark.functions.markup import strip_markup  # noqa: F401  part of the audit's surface
from panelmark.operators.evidence import walk
from panelmark.session import settled

TOLERANCE = 0.005
RATIO_TOLERANCE = 0.10
EXTREME_PERCENT = 1000.0
MAX_OPERANDS = 6
SCALES = [1.0, 1e3, 1e6, 1e9, 1e12]


def to_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def numbers(text: Column) -> Column:
    """Digit figures of a text in order, as struct(literal, value)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.struct(t.alias("literal"), to_number(t).alias("value"))),
                    lambda n: n["value"].isNotNull())


def sentences(text: Column, same_line: bool = False) -> Column:
    return F.split(F.coalesce(text, F.lit("")), V.SENTENCE_SAME_LINE if same_line else V.SENTENCE, -1)


def asks_for_ranking(question: Column) -> Column:
    return F.regexp_replace(F.coalesce(question, F.lit("")), V.NOT_SUPERLATIVE, " ").rlike(V.SUPERLATIVE)


def claims_worldwide(answer: Column) -> Column:
    """A sentence that pairs a worldwide scope with a superlative or its negative form."""
    cleaned = F.transform(sentences(answer, same_line=True), lambda s: F.regexp_replace(s, V.NOT_SUPERLATIVE, " "))
    return F.exists(cleaned, lambda s: s.rlike(V.GLOBAL_SCOPE) & (s.rlike(V.SUPERLATIVE) | s.rlike(V.NEGATIVE_UNIVERSAL)))


def citation_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(V.CITATION), F.lit(1)), lambda n: n.cast("int"))


def split_citations(answers: DataFrame, counts: DataFrame) -> DataFrame:
    """answers(answer_id, text) with prose, markers and the markers that point outside
    1..citations. counts(answer_id, citations) may lack answers without evidence."""
    rows = answers.join(counts, "answer_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    rows = rows.withColumn("prose", F.regexp_replace("text", V.CITATION, "")).withColumn("cited", citation_markers(F.col("text")))
    return rows.withColumn("dangling", F.array_sort(F.array_distinct(F.filter(
        "cited", lambda n: (n < 1) | (n > F.col("citations"))))))


# Evidence. Its numbers are read off the JSON text; what it asserts about direction needs
# its structure (``evidence.walk``).

JSON_TOKEN = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*'


def evidence_numbers(evidence: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``allowed``: every number the evidence supplies, also digits inside its texts.
    Field names supply nothing."""
    tokens = F.regexp_extract_all(F.col(payload), F.lit(JSON_TOKEN), F.lit(0))
    rows = settled(evidence.withColumn("_t", F.filter(tokens, lambda t: ~t.rlike('^".*:$'))), "_t")
    plain = F.transform(F.filter("_t", lambda t: ~t.startswith('"')), lambda t: t.try_cast("double"))
    unescaped = lambda t: F.regexp_replace(F.regexp_replace(
        t, r"\\u[0-9a-fA-F]{4}|\\[bfnrt]", " "), r"\\(.)", "$1")
    texts = F.filter("_t", lambda t: t.rlike(r'^".*\d'))
    quoted = F.flatten(F.transform(texts, lambda t: F.transform(numbers(unescaped(t)), lambda x: x["value"])))
    finite = F.filter(F.concat(plain, quoted), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return settled(rows.withColumn("allowed", F.array_distinct(finite)).drop("_t"), "allowed")


# Figures.

def is_year(v: Column) -> Column:
    return (v == F.floor(v)) & v.between(1800, 2200)


def _rounds_to(base: Column, target: Column, places: range) -> Column:
    out = F.lit(False)
    for p in places:
        out = out | (F.rint(base * (10.0 ** p)) / (10.0 ** p) == target)
    return out


def faithful(value: str, allowed: str, tolerance: float = TOLERANCE) -> str:
    """SQL text of whether a figure renders some supplied number: equal, rounded,
    rescaled, or the decade of a supplied year. Years get no relative band."""
    year = lambda v: f"({v} = floor({v}) AND {v} BETWEEN 1800 AND 2200)"
    near = lambda target, b: f"abs({b} - {target}) <= greatest(abs({b}) * {tolerance}D, 1e-9D)"
    rounded = lambda target: " OR ".join(f"rint(b * {10.0 ** p}D) / {10.0 ** p}D = {target}" for p in range(5))
    hits = [f"b = {value}", rounded(value), f"(NOT {year(value)} AND {near(value, 'b')})",
            f"({year(value)} AND {value} % 10 = 0 AND {year('b')} AND floor(b / 10) = floor({value} / 10))"]
    for scale in SCALES[1:]:
        big = f"({value} * {scale}D)"
        hits += [f"b = {big}", rounded(big), f"(NOT {year(value)} AND {near(big, 'b')})",
                 f"(b <> 0 AND {near(value, f'(b / {scale}D)')})"]
    return f"exists({allowed}, b -> {' OR '.join(hits)})"


def judge_figures(answers: DataFrame, allowed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """answers(answer_id, text) with ``parts``: per sentence its lower-case text and its
    figures struct(literal, value, grounded)."""
    rows = answers.join(allowed.select("answer_id", "allowed"), "answer_id", "left")
    rows = rows.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<double>")))
    rows = settled(rows.withColumn("_parts", F.transform(
        sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), numbers(s).alias("figures")))), "_parts")
    judged = F.expr(
        "transform(_parts, p -> named_struct('sentence', p.sentence, 'figures', transform(p.figures, n -> named_struct("
        f"'literal', n.literal, 'value', n.value, 'grounded', {faithful('n.value', 'allowed', tolerance)}))))")
    return settled(rows.withColumn("parts", judged).drop("_parts"), "parts")


def _reproduced(literal: Column, value: Column, results: Column) -> Column:
    """A result written at the precision of the literal gives its digits."""
    places = F.length(F.regexp_extract(literal, r"\.(.*)$", 1))
    half = F.pow(F.lit(10.0), -places) * 0.5 + 1e-9
    hit = lambda r: [F.abs(r / s - value) <= half for s in SCALES]
    any_of = lambda r: hit(r)[0] | hit(r)[1] | hit(r)[2] | hit(r)[3] | hit(r)[4]
    return F.exists(results, any_of)


def _operations(operands: Column) -> Column:
    """Results of one operation on two operands; at most six operands come here."""
    def with_later(a: Column, i: Column) -> Column:
        later = F.slice(operands, i + 2, F.greatest(F.size(operands) - i - 1, F.lit(0)))
        return F.flatten(F.transform(later, lambda b: F.array(
            a - b, b - a, a + b, (a + b) / 2, a / F.nullif(b, F.lit(0.0)), (a - b) / F.nullif(b, F.lit(0.0)) * 100,
            b / F.nullif(a, F.lit(0.0)), (b - a) / F.nullif(a, F.lit(0.0)) * 100)))
    return F.filter(F.flatten(F.transform(operands, with_later)), lambda r: r.isNotNull())


def derived_figures(judged: DataFrame) -> DataFrame:
    """Adds ``derived``: ungrounded values that are one exact operation on two to six
    grounded non-year figures of their own or the previous sentence."""
    rows = judged.withColumn("_windows", F.transform("parts", lambda p, i: F.struct(
        F.filter(p["figures"], lambda n: ~n["grounded"]).alias("pending"),
        F.transform(F.filter(
            F.concat(F.coalesce(F.get("parts", i - 1)["figures"], F.array().cast("array<struct<literal:string,value:double,grounded:boolean>>")),
                     p["figures"]),
            lambda n: n["grounded"] & ~is_year(n["value"])), lambda n: n["value"]).alias("operands"))))
    usable = F.filter("_windows", lambda w: (F.size(w["pending"]) > 0) & F.size(w["operands"]).between(2, MAX_OPERANDS))
    rows = settled(rows.withColumn("_usable", usable).drop("_windows"), "_usable")
    rows = settled(rows.withColumn("_results", F.transform("_usable", lambda w: F.struct(
        w["pending"].alias("pending"), _operations(w["operands"]).alias("results")))).drop("_usable"), "_results")
    hits = F.flatten(F.transform("_results", lambda w: F.transform(F.filter(
        w["pending"], lambda n: _reproduced(n["literal"], n["value"], w["results"])), lambda n: n["value"])))
    return settled(rows.withColumn("derived", F.array_distinct(hits)).drop("_results"), "derived")


def ratio_words(judged: DataFrame) -> DataFrame:
    """Adds ``approximations``: ratio words no quoted pair of grounded figures bears out."""
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).cast("double").alias("claimed")) for t, c in V.RATIO_TERMS])

    def unsupported(p: Column) -> Column:
        low = F.lower(p["sentence"])
        grounded = F.transform(F.filter(p["figures"], lambda n: n["grounded"]), lambda n: n["value"])

        def flagged(t: Column) -> Column:
            present = F.regexp_like(low, F.concat(F.lit(r"\b"), t["term"], F.lit(r"\b")))
            period = (t["term"] == "half") & low.rlike(V.PERIOD_HALF)
            borne_out = F.exists(grounded, lambda a: F.exists(grounded, lambda b: (
                (b != 0) & (a != b) & (F.abs(a / F.nullif(b, F.lit(0.0)) - t["claimed"]) <= t["claimed"] * RATIO_TOLERANCE))))
            return present & ~period & ~F.coalesce(borne_out, F.lit(False))

        return F.transform(F.filter(terms, flagged), lambda t: t["term"])

    return settled(judged.withColumn("approximations", F.array_distinct(F.flatten(F.transform("parts", unsupported)))),
                   "approximations")


def score_answers(judged: DataFrame) -> DataFrame:
    """Adds total, ungrounded literals and score: the grounded share, zero beside an
    unsupported ratio word, one for prose without figures."""
    rows = ratio_words(derived_figures(judged))
    figures = F.flatten(F.transform("parts", lambda p: p["figures"]))
    rows = rows.withColumn("_all", figures).withColumn("total_numbers", F.size("_all"))
    rows = rows.withColumn("ungrounded", F.transform(F.filter(
        "_all", lambda n: ~n["grounded"] & ~F.array_contains(F.col("derived"), n["value"])), lambda n: n["literal"]))
    share = F.when(F.col("total_numbers") == 0, F.lit(1.0)).otherwise(
        (F.col("total_numbers") - F.size("ungrounded")) / F.nullif(F.col("total_numbers"), F.lit(0)))
    return settled(rows.drop("_all").withColumn(
        "score", F.when(F.size("approximations") > 0, F.lit(0.0)).otherwise(F.rint(share * 1e4) / 1e4)), "score", "ungrounded")


# Meaning.

def direction_facts(walked: DataFrame) -> DataFrame:
    """Adds ``facts``: array<struct<value, direction, kind>> the evidence asserts, without
    values it describes both ways; ``transitions`` and ``extremes`` beside them."""
    fact = lambda v, d, k: F.struct(v.alias("value"), d.alias("direction"), F.lit(k).alias("kind"))
    rows = settled(walked.withColumnsRenamed({"objects": "_objs", "texts": "_texts"}), "_objs", "_texts")
    rows = settled(rows.withColumn("_cut", F.transform("_texts", lambda t: H.tokens(t["t"]))), "_cut")
    rows = rows.withColumn("_moves", F.flatten(F.transform("_cut", H.moves))).withColumn("_sizes", F.flatten(F.transform("_cut", H.sizes)))
    rows = settled(rows.drop("_cut"), "_moves", "_sizes")
    marked = F.transform(F.filter("_objs", lambda o: o["type"].isin("spike", "drop") & o["value"].isNotNull()), lambda o: fact(
        o["value"], F.when(o["type"] == "spike", "rise").otherwise("fall"), "level"))
    deltas = F.transform(F.flatten(F.transform("_objs", lambda o: F.coalesce(o["changes"], F.array().cast("array<string>")))), to_number)
    changed = F.transform(F.filter(deltas, lambda d: d.isNotNull() & (d != 0)), lambda d: fact(
        F.abs(d), F.when(d > 0, "rise").otherwise("fall"), "change"))
    reached = F.transform("_moves", lambda m: fact(to_number(m["end"]), m["way"], "level"))
    moved = F.transform("_moves", lambda m: fact(F.abs(to_number(m["start"]) - to_number(m["end"])), m["way"], "change"))
    sized = F.transform("_sizes", lambda m: fact(F.abs(to_number(m["figure"])), m["way"], "change"))
    rows = rows.withColumn("_facts", F.filter(F.concat(marked, changed, reached, moved, sized), lambda f: f["value"].isNotNull()))
    rows = settled(rows, "_facts")
    rows = rows.withColumn("facts", F.filter("_facts", lambda f: ~F.exists("_facts", lambda g: (
        (g["kind"] == f["kind"]) & (g["direction"] != f["direction"])
        & (F.rint(g["value"] * 1e6) == F.rint(f["value"] * 1e6))))))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    rows = rows.withColumn("transitions", F.concat(
        F.transform(F.filter("_objs", lambda o: o["value"].isNotNull() & o["previous"].isNotNull()),
                    lambda o: pair(o["previous"], o["value"])),
        F.filter(F.transform("_moves", lambda m: pair(to_number(m["start"]), to_number(m["end"]))),
                 lambda p: p["start"].isNotNull() & p["end"].isNotNull())))
    keyed = F.transform(F.filter("figures", lambda n: n["unit"] == "%"), lambda n: n["value"])
    inline = F.flatten(F.transform(F.filter("_texts", lambda t: t["unit"].isNull()), lambda t: F.transform(
        F.regexp_extract_all(t["t"], F.lit(V.PERCENT), F.lit(1)), to_number)))
    rows = rows.withColumn("extremes", F.array_sort(F.array_distinct(F.filter(
        F.concat(keyed, inline), lambda v: v.isNotNull() & (F.abs(v) >= EXTREME_PERCENT)))))
    return settled(rows.drop("figures", "_objs", "_moves", "_sizes", "_texts", "_facts"), "facts", "transitions", "extremes")


def same_figure(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return (a == b) | (F.abs(a - b) <= size * tolerance) | _rounds_to(b, a, range(4))


def check_meaning(answers: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """answers(answer_id, text) with contradictions, level_as_change and unqualified_extremes."""
    rows = answers.join(facts.select("answer_id", "facts", "transitions", "extremes", "unreadable"), "answer_id", "left")
    for name, kind in (("facts", "struct<value:double,direction:string,kind:string>"),
                       ("transitions", "struct<start:double,end:double>"), ("extremes", "double")):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")))
    rows = rows.withColumn("_levels", F.filter("facts", lambda f: f["kind"] == "level")).withColumn(
        "_changes", F.filter("facts", lambda f: f["kind"] == "change"))
    parts = F.transform(F.filter(sentences(F.col("text"), same_line=True), lambda s: F.trim(s) != ""), lambda s: F.struct(
        F.lower(s).alias("low"), numbers(s).alias("figures"), H.tokens(s).alias("cut")))
    rows = settled(rows.withColumn("_cut", parts), "_cut", "_levels", "_changes")
    parts = F.transform("_cut", lambda p: F.struct(
        p["low"].alias("low"), p["figures"].alias("figures"),
        H.figure_after(p["cut"], "to", "at").alias("directed"), H.figure_after(p["cut"], "of", "by").alias("sized")))
    rows = settled(rows.withColumn("_parts", parts).drop("_cut"), "_parts")

    def contradicted(m: Column) -> Column:
        said = F.when(m["word"].isin(V.RISE_WORDS), "rise").when(m["word"].isin(V.FALL_WORDS), "fall")
        return said.isNotNull() & F.exists("_levels", lambda f: (
            same_figure(to_number(m["figure"]), f["value"], tolerance) & (f["direction"] != said)))

    def level_misread(m: Column) -> Column:
        size = F.abs(to_number(m["figure"]))
        fits = lambda facts_: F.exists(facts_, lambda f: same_figure(size, f["value"], tolerance))
        return m["word"].isin(V.CHANGE_NOUNS) & ~fits("_changes") & fits("_levels")

    def bare_extreme(p: Column) -> Column:
        qualified = F.lit(False)
        for term in V.QUALIFIERS:
            qualified = qualified | F.contains(p["low"], F.lit(term))

        def unplaced(n: Column) -> Column:
            quoted = lambda other: F.exists(p["figures"], lambda m: same_figure(m["value"], other, tolerance))
            both_ends = F.exists("transitions", lambda t: (
                (same_figure(n["value"], t["start"], tolerance) & quoted(t["end"]))
                | (same_figure(n["value"], t["end"], tolerance) & quoted(t["start"]))))
            return F.exists("extremes", lambda e: same_figure(n["value"], e, tolerance)) & ~both_ends

        first = F.slice(F.filter(p["figures"], unplaced), 1, 1)
        return F.when(~qualified, F.transform(first, lambda n: n["literal"])).otherwise(F.array().cast("array<string>"))

    literal = lambda m: m["figure"]
    gather = lambda field, test: F.array_distinct(F.flatten(F.transform(
        "_parts", lambda p: F.transform(F.filter(p[field], test), literal))))
    out = rows.withColumn("contradictions", gather("directed", contradicted)).withColumn(
        "level_as_change", gather("sized", level_misread)).withColumn(
        "unqualified_extremes", F.array_distinct(F.flatten(F.transform("_parts", bare_extreme))))
    names = ["contradictions", "level_as_change", "unqualified_extremes"]
    return settled(out.drop("_parts", "_levels", "_changes"), *names)


def audit_answers(answers: DataFrame, evidence: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Verdict per answer: score, what is not grounded, what contradicts the evidence.

    answers(answer_id, text) and evidence(answer_id, payload) hold one row per answer. Evidence that
    cannot be read contradicts nothing, so an answer that cites it does not pass.
    """
    judged = judge_figures(answers, evidence_numbers(evidence), tolerance)
    scored = score_answers(judged).drop("parts", "allowed")
    meaning = check_meaning(answers.select("answer_id", "text"), direction_facts(walk(evidence)), tolerance).drop(
        "text", "facts", "transitions", "extremes")
    out = scored.join(meaning, "answer_id").withColumn("unreadable", F.coalesce("unreadable", F.lit(False)))
    clean = (F.size("contradictions") == 0) & (F.size("level_as_change") == 0) & (F.size("unqualified_extremes") == 0) & ~F.col("unreadable")
    return out.withColumn("passed", (F.col("score") >= 1.0) & clean)


def figure_rows(judged: DataFrame) -> DataFrame:
    """One row per figure of each answer."""
    rows = judged.select("answer_id", F.posexplode("parts").alias("sentence_no", "p"))
    return rows.select("answer_id", "sentence_no", F.posexplode("p.figures").alias("position", "n")).select(
        "answer_id", "sentence_no", "position", "n.literal", "n.value", "n.grounded")


def disposition(facts: DataFrame) -> DataFrame:
    """facts(results, ok_results, failure, timed_out, text, called_ranking, passed, dangling)
    to an outcome: absent, timeout, refused, retracted or answered, first match wins."""
    worldwide = claims_worldwide(F.col("text")) & ~F.coalesce(F.col("called_ranking"), F.lit(False))
    silent = (F.coalesce(F.col("text"), F.lit("")) == "") | F.col("failure").isNotNull()
    return facts.withColumn(
        "outcome",
        F.when((F.col("results") > 0) & (F.col("ok_results") == 0), "absent")
        .when(silent & F.col("timed_out"), "timeout")
        .when(silent | (F.col("results") == 0) | worldwide, F.when(F.col("timed_out"), "timeout").otherwise("refused"))
        .when(~F.col("passed") | (F.size("dangling") > 0), "retracted").otherwise("answered"))
