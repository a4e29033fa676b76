"""Text audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmark.functions import words as V
from panelmark.operators import audit as T
from panelmark.operators import ranking as R
from panelmark.plans import sql as S
from panelmark.plans.derived import RESULTS, tool_results
from panelmark.plans.registry import oracle, query
from panelmark.sources import adapters as A
from panelmark.sources import prose as B

# A number token for an engine without look-behind: word runs, and what a sign or point
# glued to a word or number would start, are consumed so that no number begins there.
NUM = r"(?:([-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d*\.?\d+)|[\p{L}\p{N}_])[\p{L}\p{N}_]*[-+.]?"


def lits(t):
    return f"list_filter(regexp_extract_all({t}, '{NUM}', 1), lambda x: x <> '')"


VAL = "try_cast(replace({t}, ',', '') AS DOUBLE)"
SPLIT = r"string_split(regexp_replace(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
SPLIT_LINE = r"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"

BASE = f"base AS ({B.BASE})"
ANSWERS = f"answers AS (SELECT id AS answer_id, {B.duck(B.TEXT)} AS text FROM base)"
EVIDENCE = f"evidence AS (SELECT id AS answer_id, {B.duck(B.PAYLOAD)} AS payload FROM base)"
ALLOWED = r"""
tok AS (SELECT answer_id, unnest(regexp_extract_all(payload, '"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*')) AS t FROM evidence),
leaf AS (SELECT answer_id, t FROM tok WHERE NOT (t LIKE '"%' AND t LIKE '%:' AND NOT t LIKE '%"')),
allowed AS (SELECT DISTINCT answer_id, b FROM (
  SELECT answer_id, CAST(t AS DOUBLE) AS b FROM leaf WHERE t NOT LIKE '"%'
  UNION ALL SELECT answer_id, """ + VAL.format(t="n") + r""" FROM (SELECT answer_id, unnest(""" + lits("replace(t, '\\\"', '\"')") + r""") AS n FROM leaf WHERE t LIKE '"%')) WHERE b IS NOT NULL)"""
YEARY = "({v} = floor({v}) AND {v} BETWEEN 1800 AND 2200)"


def near(target, b):
    return f"abs({b} - {target}) <= greatest(abs({b}) * 0.005::DOUBLE, 1e-9)"


def rounds(b, v, n=5):
    return "(" + " OR ".join(f"round_even({b}, {p}) = {v}" for p in range(n)) + ")"


MATCH = " OR ".join(
    [f"b = v OR {rounds('b', 'v')} OR (NOT {YEARY.format(v='v')} AND {near('v', 'b')})",
     f"({YEARY.format(v='v')} AND v % 10 = 0 AND {YEARY.format(v='b')} AND floor(b / 10) = floor(v / 10))"]
    + [f"b = v * {s} OR {rounds('b', f'(v * {s})')} OR (NOT {YEARY.format(v='v')} AND {near(f'(v * {s})', 'b')}) OR (b <> 0 AND {near('v', f'(b / {s})')})"
       for s in ("1e3", "1e6", "1e9", "1e12")])
FIGURES = f"""
sent AS (SELECT answer_id, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT answer_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT answer_id, {SPLIT.format(t='text')} AS s FROM answers))),
fig0 AS (SELECT answer_id, sentence_no, j - 1 AS position, l[j] AS literal, {VAL.format(t='l[j]')} AS v FROM (SELECT answer_id, sentence_no, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT answer_id, sentence_no, {lits('sentence')} AS l FROM sent))),
fig AS (SELECT f.answer_id, sentence_no, position, literal, v, coalesce(bool_or({MATCH}), false) AS grounded FROM fig0 f LEFT JOIN allowed a ON a.answer_id = f.answer_id GROUP BY 1, 2, 3, 4, 5)"""
DERIVED = f"""
op AS (SELECT s.answer_id, s.sentence_no, f.v, row_number() OVER (PARTITION BY s.answer_id, s.sentence_no ORDER BY f.sentence_no, f.position) AS r,
   count(*) OVER (PARTITION BY s.answer_id, s.sentence_no) AS n FROM sent s JOIN fig f ON f.answer_id = s.answer_id AND f.sentence_no IN (s.sentence_no, s.sentence_no - 1)
   WHERE f.grounded AND NOT {YEARY.format(v='f.v')}),
res AS (SELECT a.answer_id, a.sentence_no, unnest([a.v - b.v, b.v - a.v, a.v + b.v, (a.v + b.v) / 2, a.v / nullif(b.v, 0), (a.v - b.v) / nullif(b.v, 0) * 100, b.v / nullif(a.v, 0), (b.v - a.v) / nullif(a.v, 0) * 100]) AS c
  FROM op a JOIN op b ON a.answer_id = b.answer_id AND a.sentence_no = b.sentence_no AND a.r < b.r WHERE a.n <= 6),
derived AS (SELECT DISTINCT f.answer_id, f.v FROM fig f JOIN res r ON r.answer_id = f.answer_id AND r.sentence_no = f.sentence_no WHERE NOT grounded AND c IS NOT NULL AND ("""
DERIVED += " OR ".join(f"abs(c / {s} - v) <= 0.5 * pow(10.0::DOUBLE, -length(split_part(literal, '.', 2))) + 1e-9" for s in ("1", "1e3", "1e6", "1e9", "1e12")) + "))"
RATIOS = S.values("terms", ["term", "claimed"], [(t, c) for t, c in V.RATIO_TERMS], {"claimed": "DOUBLE"}) + rf""",
approx AS (SELECT DISTINCT s.answer_id, t.term FROM sent s JOIN terms t ON regexp_matches(lower(sentence), '\b' || t.term || '\b')
  WHERE NOT (t.term = 'half' AND regexp_matches(lower(sentence), '{V.PERIOD_HALF}'))
  AND NOT EXISTS (SELECT 1 FROM fig a JOIN fig b ON a.answer_id = b.answer_id AND a.sentence_no = b.sentence_no WHERE a.answer_id = s.answer_id AND a.sentence_no = s.sentence_no
    AND a.grounded AND b.grounded AND a.v <> b.v AND b.v <> 0 AND abs(a.v / nullif(b.v, 0) - t.claimed) <= t.claimed * 0.1::DOUBLE))"""
AUDIT = S.with_(BASE, ANSWERS, EVIDENCE, ALLOWED, FIGURES)


def judged(spark, d):
    return T.judge_figures(B.answers(spark, d), T.evidence_numbers(B.evidence(spark, d)))


@query("TX-1_numbers", f"""SELECT doc_id, j - 1 AS position, l[j] AS literal, {VAL.format(t='l[j]')} AS value
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, {lits('text')} AS l FROM documents))""")
def _(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.posexplode(T.numbers(F.col("text"))).alias("position", "n"))
    return rows.select("doc_id", "position", "n.literal", "n.value")


@query("TX-2_evidence_numbers", S.with_(BASE, EVIDENCE, ALLOWED) + "SELECT answer_id, b AS number FROM allowed")
def _(spark, d):
    return T.evidence_numbers(B.evidence(spark, d)).select("answer_id", F.explode("allowed").alias("number"))


@query("TX-3_faithful", AUDIT + "SELECT answer_id, sentence_no, position, literal, v AS value, grounded FROM fig")
def _(spark, d):
    return T.figure_rows(judged(spark, d))


@query("TX-4_derivable", S.with_(BASE, ANSWERS, EVIDENCE, ALLOWED, FIGURES, DERIVED) + "SELECT answer_id, v AS value FROM derived")
def _(spark, d):
    return T.derived_figures(judged(spark, d)).select("answer_id", F.explode("derived").alias("value"))


@query("TX-5_ratio_words", S.with_(BASE, ANSWERS, EVIDENCE, ALLOWED, FIGURES, RATIOS) + "SELECT answer_id, term FROM approx")
def _(spark, d):
    return T.ratio_words(judged(spark, d)).select("answer_id", F.explode("approximations").alias("term"))


SCORE = S.with_(BASE, ANSWERS, EVIDENCE, ALLOWED, FIGURES, DERIVED, RATIOS) + """
, per AS (SELECT answer_id, count(*) AS n, count(*) FILTER (grounded OR (answer_id, v) IN (SELECT answer_id, v FROM derived)) AS good FROM fig GROUP BY 1)
SELECT a.answer_id, coalesce(n, 0) AS total_numbers, coalesce(n - good, 0) AS ungrounded,
  CASE WHEN a.answer_id IN (SELECT answer_id FROM approx) THEN 0 WHEN n IS NULL THEN 1 ELSE round_even(good / n, 4) END AS score FROM answers a LEFT JOIN per USING (answer_id)"""


@query("TX-6_scores", SCORE)
def _(spark, d):
    return T.score_answers(judged(spark, d)).select("answer_id", "total_numbers", F.size("ungrounded").alias("ungrounded"), "score")


FACTS_SQL = f"""
lev AS (SELECT id, CAST(x AS DOUBLE) AS value, CASE {B.KIND} WHEN 'spike' THEN 'rise' WHEN 'drop' THEN 'fall' END AS direction, 'level' AS kind FROM base),
raw_facts AS (SELECT * FROM lev WHERE direction IS NOT NULL UNION ALL SELECT id, CAST(c AS DOUBLE), 'rise', 'change' FROM base WHERE c > 0
  UNION ALL SELECT id, 64.5, 'fall', 'level' FROM base WHERE id % 4 = 0 UNION ALL SELECT id, 18146.5, 'fall', 'change' FROM base WHERE id % 4 = 0),
dfacts AS (SELECT DISTINCT id AS answer_id, value, direction, kind FROM raw_facts f WHERE (SELECT count(DISTINCT direction) FROM raw_facts g WHERE g.id = f.id AND g.kind = f.kind AND round(g.value, 6) = round(f.value, 6)) = 1)"""


@query("TX-7_direction_facts", S.with_(BASE, FACTS_SQL) + "SELECT answer_id, round(value, 4) AS value, direction, kind FROM dfacts")
def _(spark, d):
    rows = T.direction_facts(T.walk(B.evidence(spark, d))).select("answer_id", F.explode("facts").alias("f"))
    return rows.select("answer_id", F.round("f.value", 4).alias("value"), "f.direction", "f.kind").distinct()


@query("TX-8_transitions", S.with_(BASE) + """SELECT id AS answer_id, CAST(p AS DOUBLE) AS start_value, CAST(x AS DOUBLE) AS end_value FROM base
UNION ALL SELECT id, 18211.0, 64.5 FROM base WHERE id % 4 = 0""")
def _(spark, d):
    rows = T.direction_facts(T.walk(B.evidence(spark, d))).select("answer_id", F.explode("transitions").alias("t"))
    return rows.select("answer_id", F.col("t.start").alias("start_value"), F.col("t.end").alias("end_value"))


EXTREMES = """
ext AS (SELECT DISTINCT id AS answer_id, value FROM (SELECT id, CAST(x AS DOUBLE) AS value FROM base WHERE id % 3 = 0 UNION ALL SELECT id, CAST(p AS DOUBLE) FROM base WHERE id % 3 = 0
  UNION ALL SELECT id, 18211.0 FROM base WHERE id % 4 = 0) WHERE abs(value) >= 1000)"""


@query("TX-9_extremes", S.with_(BASE, EXTREMES) + "SELECT * FROM ext")
def _(spark, d):
    return T.direction_facts(T.walk(B.evidence(spark, d))).select("answer_id", F.explode("extremes").alias("value"))


SAME = "({a} = {b} OR abs({a} - {b}) <= 0.005::DOUBLE * greatest(abs({a}), abs({b}), 1e-9) OR {r})"


def same(a, b):
    return SAME.format(a=a, b=b, r=rounds(b, a, 4))


def word_list(words):
    return ", ".join(f"'{w}'" for w in words)


PLAIN = V.PLAIN_NUMBER
MEANING = rf"""
sl AS (SELECT answer_id, i AS no, s[i] AS sentence FROM (SELECT answer_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT answer_id, {SPLIT_LINE.format(t='text')} AS s FROM answers)) WHERE trim(s[i]) <> ''),
dir0 AS (SELECT answer_id, unnest(regexp_extract_all(sentence, '(?i)\b[a-z]+\s+(?:to|at)\s+(?:{PLAIN})')) AS m FROM sl),
dirs AS (SELECT answer_id, lower(regexp_extract(m, '^([A-Za-z]+)', 1)) AS w, regexp_extract(m, '\s((?:{PLAIN}))$', 1) AS lit FROM dir0),
r1 AS (SELECT DISTINCT d.answer_id, lit FROM dirs d JOIN dfacts f ON f.answer_id = d.answer_id AND f.kind = 'level'
  WHERE w IN ({word_list(V.RISE_WORDS + V.FALL_WORDS)}) AND f.direction <> CASE WHEN w IN ({word_list(V.RISE_WORDS)}) THEN 'rise' ELSE 'fall' END AND {same(VAL.format(t='lit'), 'f.value')}),
chg0 AS (SELECT answer_id, unnest(regexp_extract_all(sentence, '(?i)\b[a-z]+\s+(?:of|by)\s+(?:{PLAIN})')) AS m FROM sl),
chgs AS (SELECT answer_id, lower(regexp_extract(m, '^([A-Za-z]+)', 1)) AS w, regexp_extract(m, '\s((?:{PLAIN}))$', 1) AS lit FROM chg0),
r2 AS (SELECT DISTINCT answer_id, lit FROM chgs c WHERE w IN ({word_list(V.CHANGE_NOUNS)})
  AND NOT EXISTS (SELECT 1 FROM dfacts f WHERE f.answer_id = c.answer_id AND kind = 'change' AND {same('abs(' + VAL.format(t='lit') + ')', 'f.value')})
  AND EXISTS (SELECT 1 FROM dfacts f WHERE f.answer_id = c.answer_id AND kind = 'level' AND {same('abs(' + VAL.format(t='lit') + ')', 'f.value')})),
tr AS (SELECT id AS answer_id, CAST(p AS DOUBLE) AS a, CAST(x AS DOUBLE) AS b FROM base UNION ALL SELECT id, CAST(x AS DOUBLE), CAST(p AS DOUBLE) FROM base
  UNION ALL SELECT id, 18211.0, 64.5 FROM base WHERE id % 4 = 0 UNION ALL SELECT id, 64.5, 18211.0 FROM base WHERE id % 4 = 0),
ln0 AS (SELECT answer_id, no, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT answer_id, no, {lits('sentence')} AS l FROM sl
  WHERE NOT regexp_matches(lower(sentence), '{'|'.join(V.QUALIFIERS)}'))),
ln AS (SELECT answer_id, no, j, l[j] AS lit, {VAL.format(t='l[j]')} AS v FROM ln0),
r3 AS (SELECT DISTINCT answer_id, arg_min(lit, j) AS lit FROM ln n WHERE EXISTS (SELECT 1 FROM ext e WHERE e.answer_id = n.answer_id AND {same('n.v', 'e.value')})
  AND NOT EXISTS (SELECT 1 FROM tr JOIN ln m ON m.answer_id = tr.answer_id WHERE tr.answer_id = n.answer_id AND m.no = n.no AND {same('n.v', 'tr.a')} AND {same('m.v', 'tr.b')})
  GROUP BY answer_id, no)"""


@query("TX-10_contradictions", S.with_(BASE, ANSWERS, FACTS_SQL, EXTREMES, MEANING) + """
SELECT answer_id, 'direction' AS rule, lit AS figure FROM r1 UNION ALL SELECT answer_id, 'level_as_change', lit FROM r2 UNION ALL SELECT answer_id, 'extreme', lit FROM (SELECT DISTINCT * FROM r3)""")
def _(spark, d):
    rows = T.check_meaning(B.answers(spark, d), T.direction_facts(T.walk(B.evidence(spark, d))))

    def named(column, rule):
        return F.transform(column, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("figure")))

    found = F.concat(named("contradictions", "direction"), named("level_as_change", "level_as_change"),
                     named("unqualified_extremes", "extreme"))
    return rows.select("answer_id", F.explode(found).alias("f")).select("answer_id", "f.rule", "f.figure")


@query("TX-6_verdicts", S.with_(BASE, ANSWERS, EVIDENCE, ALLOWED, FIGURES, DERIVED, RATIOS, FACTS_SQL, EXTREMES, MEANING) + """
, per AS (SELECT answer_id, count(*) AS n, count(*) FILTER (grounded OR (answer_id, v) IN (SELECT answer_id, v FROM derived)) AS good FROM fig GROUP BY 1),
sc AS (SELECT a.answer_id, CASE WHEN a.answer_id IN (SELECT answer_id FROM approx) THEN 0 WHEN n IS NULL THEN 1 ELSE round_even(good / n, 4) END AS score FROM answers a LEFT JOIN per USING (answer_id))
SELECT answer_id, score, score >= 1 AND answer_id NOT IN (SELECT answer_id FROM r1 UNION ALL SELECT answer_id FROM r2 UNION ALL SELECT answer_id FROM r3) AS passed FROM sc""")
def _(spark, d):
    return T.audit_answers(B.answers(spark, d), B.evidence(spark, d)).select("answer_id", "score", "passed")


DAMAGED = "CASE answer_id % 5 WHEN 0 THEN left(payload, length(payload) - 1) WHEN 1 THEN '{\"by\":\"a\",\"by\":\"b\",' || substring(payload, 2) ELSE payload END"


@query("TX-6_unreadable", oracle("TX-6_verdicts").rsplit("SELECT answer_id, score,", 1)[0] + """SELECT answer_id, score, answer_id % 5 = 0 AS unreadable,
  score >= 1 AND answer_id % 5 <> 0 AND answer_id NOT IN (SELECT answer_id FROM r1 UNION ALL SELECT answer_id FROM r2 UNION ALL SELECT answer_id FROM r3) AS passed FROM sc""")
def _(spark, d):
    evidence = B.evidence(spark, d).withColumn("payload", F.expr(DAMAGED))
    return T.audit_answers(B.answers(spark, d), evidence).select("answer_id", "score", "unreadable", "passed")


SAID = ("coalesce(text, '') || CASE conv_id % 8 WHEN 0 THEN ' Which is the highest in the world?' WHEN 1 THEN ' The most recent figure.' WHEN 2 THEN ' Lower than in the world''s largest economies.' "
        "WHEN 3 THEN ' No other country has a lower rate worldwide.' WHEN 4 THEN ' It ranked first. Globally it is at most average.' WHEN 5 THEN ' The best of all countries!' ELSE '' END AS said")
SCOPE = r"(?i)\b(in the world|worldwide|globally|of all countries|of any country|across (?:all )?countries|among all countries)\b"


# The engine of the SQL ends words at letters beyond ASCII, so these are written as x there.
@query("TX-11_superlatives", rf"""WITH c0 AS (SELECT conv_id, turn, {SAID} FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(said, '[^\x00-\x7F]', 'x', 'g') AS said FROM c0),
s AS (SELECT conv_id, turn, unnest({SPLIT_LINE.format(t='said')}) AS t FROM c),
x AS (SELECT conv_id, turn, regexp_replace(t, '{V.NOT_SUPERLATIVE}', ' ', 'g') AS t FROM s)
SELECT conv_id, turn, any_value(a) AS asks, bool_or(regexp_matches(regexp_replace(t, '(?i)in the world''?s', 'x', 'g'), '{SCOPE}') AND (regexp_matches(t, '{V.SUPERLATIVE}') OR regexp_matches(t, '{V.NEGATIVE_UNIVERSAL}'))) AS claims
FROM x JOIN (SELECT conv_id, turn, regexp_matches(regexp_replace(said, '{V.NOT_SUPERLATIVE}', ' ', 'g'), '{V.SUPERLATIVE}') AS a FROM c) USING (conv_id, turn) GROUP BY 1, 2""")
def _(spark, d):
    rows = A.table(spark, d, "conversations").selectExpr("conv_id", "turn", SAID.replace("world''s", "world\\'s"))
    return rows.select("conv_id", "turn", T.asks_for_ranking(F.col("said")).alias("asks"), T.claims_worldwide(F.col("said")).alias("claims"))


@query("TX-12_markup", S.with_(BASE, ANSWERS) + r"""
SELECT answer_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s{0,3}#{1,6}\s+', '', 'g'),
  '(?m)^(\s*)[-*+]\s+', '\1• ', 'g'), '\*\*(\S[^*]*?\S|\S)\*\*', '\1', 'g'), '`+([^`\n]+?)`+', '\1', 'g'), '\\([\\`*_{}\[\]()#+\-.!])', '\1', 'g')) AS text FROM answers""")
def _(spark, d):
    return B.answers(spark, d).select("answer_id", T.strip_markup(F.col("text")).alias("text"))


CITED = f"""res AS (SELECT {RESULTS} FROM lineitem), cnt AS (SELECT answer_id, count(DISTINCT (entity, indicator_code)) AS citations FROM res WHERE ok GROUP BY 1)"""


@query("TX-13_citations", S.with_(BASE, ANSWERS, CITED) + r"""
SELECT answer_id, regexp_replace(text, '\[(\d{1,2})\]', '', 'g') AS prose, coalesce(citations, 0) AS citations,
  array_to_string(list_sort(list_distinct(list_filter([CAST(n AS INT) FOR n IN regexp_extract_all(text, '\[(\d{1,2})\]', 1)], lambda m: m < 1 OR m > coalesce(citations, 0)))), ',') AS dangling
FROM answers LEFT JOIN cnt USING (answer_id)""")
def _(spark, d):
    counts = R.cited_series(tool_results(spark, d)).groupBy("answer_id").agg(F.count("*").alias("citations"))
    rows = T.split_citations(B.answers(spark, d), counts)
    return rows.select("answer_id", "prose", "citations", F.concat_ws(",", F.transform("dangling", lambda n: n.cast("string"))).alias("dangling"))


@query("TX-14_disposition", S.with_(BASE, CITED) + """
, f AS (SELECT b.id, count(r.answer_id) AS results, count(*) FILTER (r.ok) AS oks, coalesce(bool_or(r.ranked), false) AS ranked, coalesce(any_value(c.citations), 0) AS citations
  FROM base b LEFT JOIN res r ON r.answer_id = b.id LEFT JOIN cnt c ON c.answer_id = b.id GROUP BY 1)
SELECT id AS answer_id, CASE WHEN results > 0 AND oks = 0 THEN 'absent' WHEN id % 23 = 0 THEN 'timeout' WHEN id % 29 = 0 THEN 'refused'
  WHEN results = 0 OR (id % 16 = 14 AND NOT ranked) THEN 'refused' WHEN id % 7 = 0 OR (id % 16 = 14 AND citations < 7) THEN 'retracted' ELSE 'answered' END AS outcome FROM f""")
def _(spark, d):
    results = tool_results(spark, d)
    counts = R.cited_series(results).groupBy("answer_id").agg(F.count("*").alias("citations"))
    per = results.groupBy("answer_id").agg(F.count("*").alias("results"), F.count_if("ok").alias("ok_results"), F.bool_or("ranked").alias("called_ranking"))
    rows = T.split_citations(B.answers(spark, d), counts).join(per, "answer_id", "left").fillna(0, ["results", "ok_results"])
    i = F.col("answer_id")
    rows = rows.withColumn("timed_out", i % 23 == 0).withColumn("passed", i % 7 != 0).withColumn(
        "failure", F.when((i % 23 == 0) | (i % 29 == 0), F.lit("no answer")))
    return T.disposition(rows).select("answer_id", "outcome")


@query("TX-15_sentences", f"""SELECT doc_id, i - 1 AS position, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SPLIT.format(t='text')} AS s FROM documents))""")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))
