"""Resolution, requested slices, charts, caches, traces, conversations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelmark.operators import cache as X
from panelmark.operators import charts as G
from panelmark.operators import latest as L
from panelmark.operators import lists
from panelmark.operators import query as Q
from panelmark.operators import ranking as R
from panelmark.operators import resolve as Z
from panelmark.operators.anomaly import detect_anomalies, local_trend, refresh_anomalies, robust_sigma, score_windows, _trend_columns
from panelmark.plans import sql as S
from panelmark.plans.read import FMT, KEYS
from panelmark.plans.registry import query
from panelmark.sources import adapters as A
from panelmark.sources import names as N
from panelmark.sources import raw as W
from panelmark.sources import reference as ref

SINGLE = {"sales": "revenue", "turnover": "revenue", "order_revenue": "revenue", "order_volume": "orders", "bookings": "orders", "freight": "shipping"}
SEVERAL = {"trade": ["revenue", "orders"], "costs": ["freight_cost"], "business": ["orders", "discount_rate", "revenue"]}
NOTES = {"trade": "No net trade figure is held.", "profit": "Profit is not held."}
TOKENS = ["ORD.REV", " LIN.DISC ", "revenue", "Revenue Index", "sales", "Turnover figures", "order volume", "Trade", "trade values",
          "discount-rate", "ord.cnt", "profit", "business!", "nothing at all", "", None, "costs", "freight", "orders", "_"]
TOKEN_SQL = "CASE c_custkey % 20 " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if t is None else f"'{t}'") for i, t in enumerate(TOKENS)) + " END"


def _alias_rows(single, several):
    return [(a, c, False, 0) for a, c in single.items()] + [(a, c, True, i) for a, cs in several.items() for i, c in enumerate(cs)]


NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
QUAL = "'rate', 'rates', 'ratio', 'level', 'levels', 'index', 'data', 'figures', 'statistics', 'stats', 'numbers', 'percentage', 'percent', 'value', 'values'"

RESOLVED = f"""
r AS (SELECT *, {NORM.format(x='raw')} AS n FROM req),
q AS (SELECT *, CASE WHEN regexp_extract(n, '^(.+)_([^_]*)$', 2) IN ({QUAL}) THEN regexp_extract(n, '^(.+)_([^_]*)$', 1) END AS s FROM r),
heads AS (SELECT concept, arg_min(indicator_code, (CASE WHEN is_primary THEN 0 ELSE 1 END, -country_count, source, indicator_code)) AS code FROM meta WHERE concept IS NOT NULL GROUP BY 1),
nm AS (SELECT concept AS name, 1 AS way, code, NULL AS cands FROM heads
  UNION ALL SELECT alias, 2, code, NULL FROM al JOIN heads USING (concept) WHERE NOT ambiguous
  UNION ALL SELECT alias, 3, NULL, string_agg(code, ',' ORDER BY pos) FROM al JOIN heads USING (concept) WHERE ambiguous GROUP BY 1),
best AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY name ORDER BY way) = 1)
SELECT q.request_id,
  CASE WHEN e.indicator_code IS NOT NULL THEN 'code' WHEN b1.way IS NOT NULL THEN ['concept', 'alias', 'ambiguous'][b1.way]
    WHEN b2.way IS NOT NULL THEN ['concept', 'alias', 'ambiguous'][b2.way] WHEN f.low IS NOT NULL THEN 'folded_code' ELSE 'none' END AS how,
  CASE WHEN e.indicator_code IS NOT NULL THEN e.indicator_code WHEN b1.way IS NOT NULL THEN b1.code WHEN b2.way IS NOT NULL THEN b2.code ELSE f.code END AS code,
  CASE WHEN e.indicator_code IS NOT NULL THEN NULL WHEN b1.way IS NOT NULL THEN b1.cands ELSE b2.cands END AS candidates,
  CASE WHEN e.indicator_code IS NOT NULL THEN NULL WHEN b1.way IS NOT NULL THEN CASE WHEN b1.way = 3 THEN n1.note END
    WHEN b2.way IS NOT NULL THEN CASE WHEN b2.way = 3 THEN n2.note END WHEN f.low IS NOT NULL THEN NULL ELSE n1.note END AS note
FROM q LEFT JOIN (SELECT DISTINCT indicator_code FROM meta) e ON e.indicator_code = q.raw
LEFT JOIN best b1 ON b1.name = q.n LEFT JOIN best b2 ON b2.name = q.s
LEFT JOIN (SELECT DISTINCT lower(indicator_code) AS low, indicator_code AS code FROM meta) f ON f.low = lower(q.raw)
LEFT JOIN nh n1 ON n1.alias = q.n LEFT JOIN nh n2 ON n2.alias = q.s"""
REQUESTS = f", req AS (SELECT c_custkey AS request_id, trim(coalesce({TOKEN_SQL}, '')) AS raw FROM customer),"


def resolved(out):
    r = F.col("resolution")
    return out.select("request_id", r["how"].alias("how"), r["code"].alias("code"),
                      F.when(r["candidates"].isNotNull(), F.concat_ws(",", r["candidates"])).alias("candidates"), r["note"].alias("note"))


@query("J-5_resolve_indicators", S.with_(S.FACTS, S.CATALOG, S.META, S.values("al", ["alias", "concept", "ambiguous", "pos"], _alias_rows(SINGLE, SEVERAL)),
       S.values("nh", ["alias", "note"], list(NOTES.items()))) + REQUESTS + RESOLVED)
def _(spark, d):
    req = A.table(spark, d, "customer").selectExpr("c_custkey AS request_id", f"{TOKEN_SQL} AS token")
    meta = R.indicator_metadata(A.facts(spark, d), ref.catalog(spark))
    return resolved(Z.resolve_indicators(req, meta, N.aliases(spark, SINGLE, SEVERAL), N.not_held(spark, NOTES)))


_HOW, _TAIL = RESOLVED.split("SELECT q.request_id,", 1)


@query("P-6_answered_rankings", S.with_(S.FACTS, S.CATALOG, S.META, S.LATEST, S.PROFILES, S.values("al", ["alias", "concept", "ambiguous", "pos"], _alias_rows(SINGLE, SEVERAL)),
       S.values("nh", ["alias", "note"], list(NOTES.items()))) + REQUESTS + _HOW.rstrip() + ", res AS (SELECT q.request_id," + _TAIL + """),
asked AS (SELECT request_id, code, CASE request_id % 2 WHEN 0 THEN 'asc' ELSE 'desc' END AS ord, CASE WHEN request_id % 3 > 0 THEN request_id % 11 END AS lim FROM res WHERE code IS NOT NULL),
alt AS (SELECT a.indicator_code AS code, string_agg(DISTINCT b.indicator_code, ',' ORDER BY b.indicator_code) AS alternatives
  FROM meta a JOIN meta b ON a.concept = b.concept AND a.indicator_code <> b.indicator_code GROUP BY 1),
f AS (SELECT request_id, code, ord, lim, entity, value, date, row_number() OVER (PARTITION BY request_id ORDER BY CASE ord WHEN 'asc' THEN value ELSE -value END, entity) AS rank,
  count(*) OVER (PARTITION BY request_id) AS entity_count, min(date) OVER (PARTITION BY request_id) AS earliest FROM asked JOIN latest ON indicator_code = code)
SELECT request_id, code AS indicator_code, ord, rank, f.entity, entity_name, value, date, entity_count, earliest,
  lim IS NOT NULL AND entity_count > greatest(lim, 1) AS truncated, coalesce(alternatives, '') AS alternatives
FROM f LEFT JOIN alt USING (code) LEFT JOIN profiles p ON p.entity = f.entity WHERE lim IS NULL OR rank <= greatest(lim, 1)""")
def _(spark, d):
    i = F.col("request_id")
    req = A.table(spark, d, "customer").selectExpr("c_custkey AS request_id", f"{TOKEN_SQL} AS token").withColumn(
        "order", F.when(i % 2 == 0, "asc").otherwise("desc")).withColumn("limit", F.when(i % 3 > 0, i % 11))
    f = A.facts(spark, d)
    out = R.answer_rankings(req, R.indicator_metadata(f, ref.catalog(spark)), N.aliases(spark, SINGLE, SEVERAL), N.not_held(spark, NOTES), L.latest(f), A.profiles(spark, d))
    return out.select("request_id", "indicator_code", F.col("order").alias("ord"), "rank", "entity", "entity_name", "value", "date", "entity_count", "earliest", "truncated",
                      F.concat_ws(",", "alternatives").alias("alternatives"))


# The library's own wording, asked of a catalog of parts: each brand is an indicator of one of its concepts.
CONCEPTS = sorted(set(N.ALIASES.values()))
WORDING = sorted({*N.ALIASES, *N.AMBIGUOUS, *N.NOT_HELD, *CONCEPTS})
PART_META = ("SELECT 'parts' AS source, p_brand AS indicator_code, {concept} AS concept, min(p_partkey) % 3 = 0 AS is_primary, count(*) AS country_count FROM part GROUP BY p_brand")
_CONCEPT = "CASE CAST(substring(p_brand, 7) AS INT) % {n} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONCEPTS)) + " END"
CONCEPT = _CONCEPT.format(n=len(CONCEPTS) + 1)
WORDED = (f"CASE c_custkey % {len(WORDING) + 3} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDING))
          + f" WHEN {len(WORDING)} THEN 'Brand#23' WHEN {len(WORDING) + 1} THEN 'brand#11' ELSE 'unheard of' END")
OWN_WORDS = f"replace({WORDED}, '_', CASE c_custkey % 2 WHEN 0 THEN ' ' ELSE '-' END) || CASE c_custkey % 5 WHEN 0 THEN ' data' ELSE '' END"


@query("J-5_own_wording", "WITH meta AS (" + PART_META.format(concept=CONCEPT).replace("GROUP BY p_brand", "GROUP BY p_brand, concept") + "), "
       + S.values("al", ["alias", "concept", "ambiguous", "pos"], _alias_rows(N.ALIASES, N.AMBIGUOUS)) + ", " + S.values("nh", ["alias", "note"], list(N.NOT_HELD.items()))
       + f", req AS (SELECT c_custkey AS request_id, trim({OWN_WORDS}) AS raw FROM customer)," + RESOLVED)
def _(spark, d):
    req = A.table(spark, d, "customer").selectExpr("c_custkey AS request_id", f"{OWN_WORDS} AS token")
    parts = A.table(spark, d, "part").withColumn("concept", F.expr(CONCEPT))
    meta = parts.groupBy(F.col("p_brand").alias("indicator_code"), "concept").agg(
        F.lit("parts").alias("source"), (F.min("p_partkey") % 3 == 0).alias("is_primary"), F.count("*").alias("country_count"))
    return resolved(Z.resolve_indicators(req, meta, N.aliases(spark), N.not_held(spark)))


WHO = "CASE c_custkey % 9 WHEN 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) WHEN 1 THEN ' nation_1' WHEN 2 THEN 'nat' WHEN 3 THEN 'nati' WHEN 4 THEN 'XYZ' WHEN 5 THEN 'nab' WHEN 6 THEN '' WHEN 7 THEN 'nation_2x' ELSE 'NAY' END"


@query("J-6_resolve_entities", S.with_(S.PROFILES) + f"""
, r AS (SELECT c_custkey AS request_id, trim({WHO}) AS t FROM customer),
x AS (SELECT *, CASE WHEN regexp_full_match(upper(t), '[A-Z]{{3}}') THEN upper(t) END AS code FROM r)
SELECT request_id, CASE WHEN code IS NOT NULL THEN code ELSE coalesce((SELECT min(entity) FROM profiles p WHERE lower(p.entity_name) = lower(t)),
  (SELECT min(entity) FROM profiles p WHERE length(t) >= 4 AND starts_with(lower(p.entity_name), lower(t)))) END AS entity FROM x""")
def _(spark, d):
    req = A.table(spark, d, "customer").selectExpr("c_custkey AS request_id", f"{WHO} AS token")
    return Z.resolve_entities(req, A.profiles(spark, d)).select("request_id", "entity")


REQ = (f"c_custkey AS request_id, CASE WHEN c_custkey % 31 = 0 THEN 'QQQ' ELSE {W.ISO3} END AS entity, "
       "CASE c_custkey % 4 WHEN 0 THEN 'ORD.REV' WHEN 1 THEN 'ORD.AOV' WHEN 2 THEN 'LIN.DISC' ELSE 'LIN.QTY' END AS indicator_code, "
       "CASE c_custkey % 3 WHEN 0 THEN CAST('1997-01-01' AS DATE) WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN CAST('2010-01-01' AS DATE) END END AS {s}, "
       "CASE WHEN c_custkey % 6 = 0 THEN CAST('1998-06-01' AS DATE) END AS {e}, c_custkey % 2 = 0 AS latest_only, 1 + c_custkey % 50 AS {l}")


@query("P-10_requested_windows", S.with_(S.FACTS) + f"""
, q AS (SELECT {REQ.format(s='s', e='e', l='lim')} FROM (SELECT *, c_nationkey AS k FROM customer)),
cov AS (SELECT entity, indicator_code, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM facts WHERE value IS NOT NULL GROUP BY 1, 2),
hit AS (SELECT request_id, count(*) AS found FROM q JOIN facts f USING (entity, indicator_code) WHERE value IS NOT NULL
  AND (s IS NULL OR date >= s) AND (e IS NULL OR date <= e) GROUP BY 1)
SELECT request_id, entity, indicator_code, coalesce(n, 0) AS series_count, first_date, last_date,
  CASE WHEN latest_only AND s IS NULL AND e IS NULL THEN least(coalesce(found, 0), 1) ELSE least(coalesce(found, 0), lim) END AS returned,
  NOT (latest_only AND s IS NULL AND e IS NULL) AND coalesce(found, 0) > lim AS truncated,
  CASE WHEN coalesce(found, 0) > 0 THEN 'rows' WHEN coalesce(n, 0) > 0 THEN 'none_in_window' ELSE 'no_series' END AS outcome
FROM q LEFT JOIN cov USING (entity, indicator_code) LEFT JOIN hit USING (request_id)""")
def _(spark, d):
    parts = _split(REQ.format(s="start", e="`end`", l="limit"))
    req = A.table(spark, d, "customer").withColumn("k", F.col("c_nationkey")).selectExpr(*parts)
    out = Q.query_observations(req, A.facts(spark, d))
    return out.select("request_id", "entity", "indicator_code", "series_count", "first_date", "last_date",
                      F.size("observations").alias("returned"), "truncated", "outcome")


@query("P-10_contents", S.with_(S.FACTS) + f"""
, q AS (SELECT {REQ.format(s='s', e='e', l='lim')} FROM (SELECT *, c_nationkey AS k FROM customer)),
r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY date DESC, value DESC, source DESC) - 1 AS position, date, value, source,
  CASE WHEN latest_only AND s IS NULL AND e IS NULL THEN 1 ELSE lim END AS most
FROM q JOIN facts f USING (entity, indicator_code) WHERE value IS NOT NULL AND (s IS NULL OR date >= s) AND (e IS NULL OR date <= e))
SELECT request_id, position, date, value, source FROM r WHERE position < most""")
def _(spark, d):
    parts = _split(REQ.format(s="start", e="`end`", l="limit"))
    req = A.table(spark, d, "customer").withColumn("k", F.col("c_nationkey")).selectExpr(*parts)
    out = Q.query_observations(req, A.facts(spark, d)).select("request_id", F.posexplode("observations").alias("position", "o"))
    return out.select("request_id", "position", "o.date", "o.value", "o.source")


@query("W-12_truncation", S.with_(S.EVENTS) + """
, r AS (SELECT entity, indicator_code, date, value, row_number() OVER (PARTITION BY entity, indicator_code ORDER BY date DESC) AS n,
  count(*) OVER (PARTITION BY entity, indicator_code) AS total FROM efacts)
SELECT entity, indicator_code, date, value, total > 8 AS truncated FROM r WHERE n <= 8""")
def _(spark, d):
    return lists.newest_readings(A.event_facts(spark, d), 8)


@query("W-11_recent_messages", """
SELECT conv_id, turn, role, trim(text) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE n <= 8""")
def _(spark, d):
    return lists.recent_messages(A.table(spark, d, "conversations"))


# Detector parts.
def an_sql(tail, **kw):
    return S.with_(S.FACTS, S.anomalies(**kw)) + tail


@query("AN-1_trailing_window", an_sql("""
SELECT source, indicator_code, entity, date, count(*) AS prior, round(sum(v), 4) AS total FROM anomalies_p GROUP BY ALL"""))
def _(spark, d):
    rows = _trend_columns(A.facts(spark, d), KEYS, 12).where("_index >= 8")
    return rows.select(*KEYS, "date", F.size("_prior").alias("prior"),
                       F.round(F.aggregate("_prior", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("AN-2_local_trend", an_sql("SELECT source, indicator_code, entity, date, islog AS log_space, round(pred, 3) AS predicted FROM anomalies_q"))
def _(spark, d):
    rows = local_trend(_trend_columns(A.facts(spark, d), KEYS, 12).where("_index >= 8"))
    return rows.select(*KEYS, "date", F.col("_log").alias("log_space"), F.round("predicted", 3).alias("predicted"))


@query("AN-3_robust_sigma", an_sql("SELECT source, indicator_code, entity, date, round(sigma, 6) AS sigma FROM anomalies_q"))
def _(spark, d):
    rows = robust_sigma(local_trend(_trend_columns(A.facts(spark, d), KEYS, 12).where("_index >= 8")))
    return rows.select(*KEYS, "date", F.round("sigma", 6).alias("sigma"))


@query("AN-4_flat_windows", an_sql("SELECT source, indicator_code, entity, date, flat FROM anomalies_z"))
def _(spark, d):
    return score_windows(A.facts(spark, d), KEYS).select(*KEYS, "date", "flat")


HELD = "CASE WHEN (month(date) + length(entity)) % 12 < 9 THEN 4.25 ELSE 4.25 + (year(date) % 5) * 1.75 END"
HELD_SQL = S.with_(S.FACTS, f"held AS (SELECT source, indicator_code, entity, date, {HELD} AS value FROM facts)",
                   S.anomalies("held", window=6, min_obs=6))


@query("AN-5_structural_breaks", HELD_SQL + "SELECT * FROM anomalies WHERE deviation_type = 'structural_break'")
def _(spark, d):
    held = A.facts(spark, d).withColumn("value", F.expr(HELD).cast("double"))
    return detect_anomalies(held, KEYS, window=6, min_obs=6).where("deviation_type = 'structural_break'")


@query("AN-6_fences", an_sql("""
SELECT source, indicator_code, entity, date, round(q1 - 1.5 * (q3 - q1), 5) AS low, round(q3 + 1.5 * (q3 - q1), 5) AS high FROM anomalies_q"""))
def _(spark, d):
    return score_windows(A.facts(spark, d), KEYS).select(
        *KEYS, "date", F.round("fence_low", 5).alias("low"), F.round("fence_high", 5).alias("high"))


@query("AN-7_detect", an_sql("SELECT * FROM anomalies"))
def _(spark, d):
    return detect_anomalies(A.facts(spark, d), KEYS)


@query("AN-7_detect_events", S.with_(S.EVENTS, S.anomalies("efacts")) + "SELECT * FROM anomalies")
def _(spark, d):
    return detect_anomalies(A.event_facts(spark, d), KEYS)


@query("AN-8_refresh", S.with_(S.FACTS, S.anomalies(), S.anomalies(name="wide", threshold=3.0)) + """
, o AS (SELECT * FROM anomalies), n AS (SELECT * FROM wide WHERE source = 'lines')
SELECT source, indicator_code, entity, date, coalesce(n.z_score, o.z_score) AS z_score,
  CASE WHEN entity > 'NAM' THEN 'why ' || entity END AS explanation,
  CASE WHEN source <> 'lines' THEN 'kept' WHEN n.date IS NULL THEN 'retracted' ELSE 'updated' END AS change
FROM o LEFT JOIN n USING (source, indicator_code, entity, date)""")
def _(spark, d):
    f = A.facts(spark, d)
    at = F.lit(dt.datetime(2001, 8, 1)).cast("timestamp")
    old = detect_anomalies(f, KEYS).withColumn(
        "explanation", F.when(F.col("entity") > "NAM", F.concat(F.lit("why "), "entity"))).withColumn("detected_at", at)
    found = detect_anomalies(f.where("source = 'lines'"), KEYS, threshold=3.0)
    out = refresh_anomalies(old, found, KEYS, dt.datetime(2001, 8, 15), F.col("source") == "lines")
    return out.select(*KEYS, "date", "z_score", "explanation", "change")


@query("AN-9_context", S.with_(S.FACTS, S.CATALOG, S.PROFILES, S.anomalies()) + f"""
, s AS (SELECT source, indicator_code, entity, count(*) AS observation_count, min(date) AS first_date, max(date) AS last_date, arg_max(value, date) AS lv, min(value) AS lo, max(value) AS hi
  FROM facts WHERE value IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT source, indicator_code, entity, least(count(*), 6) AS flagged, max(date) AS newest_flag FROM anomalies GROUP BY 1, 2, 3)
SELECT source, indicator_code, entity, observation_count, first_date, last_date, {FMT.format(x='lv')} AS latest_value, {FMT.format(x='lo')} AS min_value,
  {FMT.format(x='hi')} AS max_value, flagged, newest_flag, coalesce(entity_name, entity) AS entity_name, 6 AS recent, 2 AS changes
FROM s JOIN catalog USING (source, indicator_code) LEFT JOIN a USING (source, indicator_code, entity) LEFT JOIN profiles USING (entity)""")
def _(spark, d):
    f = A.facts(spark, d)
    ctx = Q.series_context(f, detect_anomalies(f, KEYS), ref.catalog(spark), A.profiles(spark, d), KEYS)
    return ctx.select(
        *KEYS, "observation_count", "first_date", "last_date", "latest_value", "min_value", "max_value",
        F.when(F.col("anomalies").isNotNull(), F.size("anomalies")).alias("flagged"), F.get("anomalies", F.lit(0))["date"].alias("newest_flag"),
        "entity_name", F.size("recent").alias("recent"), F.size("changes").alias("changes"))


def context(spark, d):
    f = A.facts(spark, d)
    return Q.series_context(f, detect_anomalies(f, KEYS), ref.catalog(spark), A.profiles(spark, d), KEYS)


@query("AN-9_recent_points", S.with_(S.FACTS, S.CATALOG) + f"""
, r AS (SELECT source, indicator_code, entity, date, {FMT.format(x='value')} AS value, row_number() OVER (PARTITION BY source, indicator_code, entity ORDER BY date DESC) AS back
  FROM facts JOIN catalog USING (source, indicator_code) WHERE value IS NOT NULL)
SELECT source, indicator_code, entity, row_number() OVER (PARTITION BY source, indicator_code, entity ORDER BY date) - 1 AS position, date, value FROM r WHERE back <= 6""")
def _(spark, d):
    rows = context(spark, d).select(*KEYS, F.posexplode("recent").alias("position", "p"))
    return rows.select(*KEYS, "position", "p.date", "p.value")


@query("AN-9_flagged_points", S.with_(S.FACTS, S.CATALOG, S.anomalies()) + f"""
, r AS (SELECT source, indicator_code, entity, date, {FMT.format(x='value')} AS value, {FMT.format(x='z_score')} AS z_score, deviation_type,
  row_number() OVER (PARTITION BY source, indicator_code, entity ORDER BY date DESC) AS n FROM anomalies JOIN catalog USING (source, indicator_code))
SELECT source, indicator_code, entity, n - 1 AS position, date, value, z_score, deviation_type FROM r WHERE n <= 6""")
def _(spark, d):
    rows = context(spark, d).select(*KEYS, F.posexplode("anomalies").alias("position", "p"))
    return rows.select(*KEYS, "position", "p.date", "p.value", "p.z_score", "p.deviation_type")


# Chart helpers.
@query("A-9_robust_domain", S.with_(S.FACTS, S.LATEST) + """
, r AS (SELECT indicator_code, value, row_number() OVER (PARTITION BY indicator_code ORDER BY value, entity) AS rn, count(*) OVER (PARTITION BY indicator_code) AS n FROM latest),
e AS (SELECT indicator_code, max(value) FILTER (rn = least(floor(0.05::DOUBLE * n) + 1, n)) AS lo, max(value) FILTER (rn = least(floor(0.95::DOUBLE * n) + 1, n)) AS hi FROM r GROUP BY 1)
SELECT indicator_code, CASE WHEN indicator_code = 'LIN.DISC' THEN -greatest(abs(lo), abs(hi)) ELSE lo END AS low,
  CASE WHEN indicator_code = 'LIN.DISC' THEN greatest(abs(lo), abs(hi)) ELSE CASE WHEN lo = hi THEN lo + 1 ELSE hi END END AS high,
  CASE WHEN indicator_code = 'LIN.DISC' THEN 'diverging' ELSE 'sequential' END AS scale FROM e""")
def _(spark, d):
    return G.robust_domain(L.latest(A.facts(spark, d)), signed=["LIN.DISC"])


@query("A-9_robust_domain_events", S.with_(S.EVENTS) + """
, l AS (SELECT entity, indicator_code, arg_max(value, date) AS value FROM efacts GROUP BY 1, 2),
r AS (SELECT indicator_code, value, row_number() OVER (PARTITION BY indicator_code ORDER BY value, entity) AS rn, count(*) OVER (PARTITION BY indicator_code) AS n FROM l)
SELECT indicator_code, max(value) FILTER (rn = least(floor(0.05::DOUBLE * n) + 1, n)) AS low, max(value) FILTER (rn = least(floor(0.95::DOUBLE * n) + 1, n)) AS high, 'sequential' AS scale FROM r GROUP BY 1""")
def _(spark, d):
    return G.robust_domain(L.latest(A.event_facts(spark, d)))


NICE = """
, m AS (SELECT source, indicator_code, entity, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 6 AS t FROM facts WHERE value IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN t > 0 THEN pow(10.0::DOUBLE, floor(log10(CASE WHEN t > 0 THEN t ELSE 1 END))) END AS mag FROM m),
st AS (SELECT *, mag * CASE WHEN t <= mag THEN 1 WHEN t <= mag * 2 THEN 2 WHEN t <= mag * 2.5::DOUBLE THEN 2.5::DOUBLE WHEN t <= mag * 5 THEN 5 ELSE 10 END AS step FROM g)
"""


@query("A-10_nice_domain", S.with_(S.FACTS) + NICE + """
SELECT source, indicator_code, entity, round(CASE WHEN step IS NULL THEN lo - CASE WHEN lo = 0 THEN 1 ELSE abs(lo) * 0.1::DOUBLE END ELSE floor(lo / step) * step END, 6) AS low,
  round(CASE WHEN step IS NULL THEN hi + CASE WHEN lo = 0 THEN 1 ELSE abs(lo) * 0.1::DOUBLE END ELSE ceil(hi / step) * step END, 6) AS high FROM st""")
def _(spark, d):
    out = G.nice_domain(A.facts(spark, d), KEYS)
    return out.select(*KEYS, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("A-11_legend_stops", S.with_(S.FACTS) + NICE + """
, dom AS (SELECT source, indicator_code, entity, floor(lo / step) * step AS low, ceil(hi / step) * step AS high FROM st WHERE step IS NOT NULL),
v AS (SELECT source, indicator_code, entity, i AS stop, low + (high - low) * (i / 4.0::DOUBLE) AS value FROM dom, range(5) r(i))
SELECT source, indicator_code, entity, stop, round(value, 6) AS value, CASE WHEN abs(value) >= 100 THEN CAST(CAST(round(value, 0) AS DECIMAL(38,0)) AS VARCHAR)
  ELSE CAST(CAST(round(value, 1) AS DECIMAL(38,1)) AS VARCHAR) END AS label FROM v""")
def _(spark, d):
    return G.legend_stops(G.nice_domain(A.facts(spark, d), KEYS)).withColumn("value", F.round("value", 6))


@query("A-12_freshness", """
WITH s AS (SELECT user_id AS name, CASE WHEN user_id % 11 = 0 THEN NULL ELSE date_trunc('second', max(ts)) END AS last_run FROM events GROUP BY 1),
x AS (SELECT *, epoch(TIMESTAMP '2024-02-01 00:00:00') AS now, greatest(epoch(TIMESTAMP '2024-02-01 00:00:00') - min(epoch(last_run)) OVER (), 86400) AS span FROM s)
SELECT name, CASE WHEN last_run IS NOT NULL THEN round(least(greatest((epoch(last_run) - (now - span)) / span, 0), 1), 6) END AS placed,
  CASE WHEN last_run IS NULL THEN 'no successful run on record' WHEN now - epoch(last_run) < 60 THEN 'just now' WHEN now - epoch(last_run) < 3600 THEN CAST(CAST(floor((now - epoch(last_run)) / 60) AS INT) AS VARCHAR) || ' min ago'
   WHEN now - epoch(last_run) < 172800 THEN CAST(CAST(floor((now - epoch(last_run)) / 3600) AS INT) AS VARCHAR) || ' hr ago' ELSE CAST(CAST(floor((now - epoch(last_run)) / 86400) AS INT) AS VARCHAR) || ' days ago' END AS elapsed FROM x""")
def _(spark, d):
    runs = A.table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("t")).select(
        "name", F.when(F.col("name") % 11 != 0, F.date_trunc("second", F.col("t").cast("timestamp"))).alias("last_run"))
    placed = G.place_sources(runs, F.lit(dt.datetime(2024, 2, 1)).cast("timestamp"))
    return placed.select("name", F.round("at", 6).alias("placed"), "elapsed")


@query("A-15_map_anchors", """
WITH p AS (SELECT vec_id, unnest(range(4)) AS ring, embedding AS e FROM embeddings),
v AS (SELECT vec_id, ring, i, CAST(e[ring * 16 + i * 2 + 1] AS DOUBLE) * 100 AS x, CAST(e[ring * 16 + i * 2 + 2] AS DOUBLE) * 100 AS y FROM p, range(8) r(i)),
a AS (SELECT v.vec_id, v.ring, abs(sum((w.x + v.x) * (w.y - v.y))) / 2 AS area FROM v JOIN v w ON w.vec_id = v.vec_id AND w.ring = v.ring AND w.i = (v.i + 7) % 8 GROUP BY 1, 2),
b AS (SELECT vec_id, arg_min(ring, (-area, ring)) AS ring FROM a GROUP BY 1)
SELECT vec_id, round(avg(x), 6) AS lon, round(avg(y), 6) AS lat, round((avg(x) + 180) / 360, 6) AS sweep FROM b JOIN v USING (vec_id, ring) GROUP BY 1""")
def _(spark, d):
    point = lambda r, i: f"array(CAST(embedding[{r * 16 + i * 2}] AS DOUBLE) * 100, CAST(embedding[{r * 16 + i * 2 + 1}] AS DOUBLE) * 100)"
    rings = ", ".join("array(" + ", ".join(point(r, i) for i in range(8)) + ")" for r in range(4))
    features = A.table(spark, d, "embeddings").selectExpr("vec_id", f"array({rings}) AS polygons")
    out = G.ring_anchors(features)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "sweep")])


# Tool results and traces, one row per order line and per event.
RESULTS = ("l_orderkey AS answer_id, l_linenumber AS ordinal, l_returnflag <> 'R' AS ok, 'N' || CAST(l_suppkey % 7 AS STRING) AS entity, "
           "'I' || CAST(l_partkey % 3 AS STRING) AS indicator_code, CAST(l_quantity AS INT) AS rows_read, l_linestatus = 'F' AS ranked, "
           "CAST(l_partkey % 40 AS INT) AS entities_ranked, CASE WHEN l_returnflag = 'R' THEN 'none for N' || CAST(l_suppkey % 2 AS STRING) END AS message")


def tool_results(spark, d):
    return A.table(spark, d, "lineitem").selectExpr(*[p.strip() for p in _split(RESULTS)])


def _split(text):
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@query("A-16_citations", f"""WITH r AS (SELECT {RESULTS} FROM lineitem),
f AS (SELECT answer_id, entity, indicator_code, min(ordinal) AS first_at FROM r WHERE ok GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first_at, entity, indicator_code) AS citation FROM f""")
def _(spark, d):
    return R.cited_series(tool_results(spark, d))


@query("A-17_request_counters", f"""WITH r AS (SELECT {RESULTS} FROM lineitem)
SELECT answer_id, sum(rows_read) AS rows_read, max(entities_ranked) AS entities_ranked, count(*) FILTER (NOT ok) AS tool_failures, bool_or(ranked) AS called_ranking, count(*) AS tool_calls FROM r GROUP BY 1""")
def _(spark, d):
    return R.request_counters(tool_results(spark, d))


@query("U-4_distinct_messages", f"""WITH r AS (SELECT {RESULTS} FROM lineitem), f AS (SELECT answer_id, message, min(ordinal) AS o FROM r WHERE message IS NOT NULL GROUP BY 1, 2)
SELECT answer_id, string_agg(message, ' ' ORDER BY o, message) AS detail FROM f GROUP BY 1""")
def _(spark, d):
    return lists.distinct_messages(tool_results(spark, d))


TRACES = ("ts, CASE event_type WHEN 'click' THEN 'answered' WHEN 'error' THEN 'refused' WHEN 'purchase' THEN 'retracted' WHEN 'view' THEN 'answered' ELSE 'absent' END AS outcome, "
          "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'p' || CAST(user_id % 3 AS STRING) END AS provider, event_id % 4 = 0 AS cached, CAST(event_id % 3 AS INT) AS fallbacks, "
          "event_id % 5 = 0 AS ranked, CAST(event_id % 6 AS INT) AS tool_calls, CAST(event_id % 2 AS INT) AS tool_failures, event_id % 97 = 0 AS timed_out, CAST(value AS DECIMAL(18,2)) AS seconds")


def traces(spark, d):
    return A.table(spark, d, "events").selectExpr(*[p.strip() for p in _split(TRACES)])


def joined_map(column):
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


ROLLUP = """round_even({x}, 3)"""


@query("A-14_trace_rollup", f"""WITH t AS (SELECT {TRACES} FROM events)
SELECT count(*) AS requests, round_even(count(*) FILTER (cached) / count(*), 3) AS cache_hit_rate, round_even(count(*) FILTER (fallbacks > 0) / count(*), 3) AS fallback_rate,
  round_even(count(*) FILTER (ranked) / count(*), 3) AS ranking_rate, round_even(count(*) FILTER (outcome IN ('refused', 'retracted', 'absent')) / count(*), 3) AS refusal_rate,
  round_even(count(*) FILTER (timed_out) / count(*), 3) AS timeout_rate, round_even(CAST(sum(seconds) AS DOUBLE) / count(*), 2) AS mean_seconds, sum(tool_calls) AS tool_calls, sum(tool_failures) AS tool_failures,
  (SELECT string_agg(outcome || '=' || CAST(n AS VARCHAR), ',' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n FROM t GROUP BY 1)) AS outcomes,
  (SELECT string_agg(provider || '=' || CAST(n AS VARCHAR), ',' ORDER BY provider) FROM (SELECT provider, count(*) AS n FROM t WHERE provider IS NOT NULL GROUP BY 1)) AS providers FROM t""")
def _(spark, d):
    out = X.trace_rollup(traces(spark, d))
    return out.withColumn("outcomes", joined_map("outcomes")).withColumn("providers", joined_map("providers"))


# Cache tables from the conversations.
CACHE = ("conv_id, turn, 'answer:' || role || ':' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS cache_key, CASE WHEN conv_id % 10 = 3 THEN '' ELSE text END AS response, "
         "CAST(conv_id % 7 AS BIGINT) AS hits, (conv_id % 10) / CAST(10 AS DOUBLE) AS score, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE date_add(DATE '2024-01-01', CAST((conv_id * 31 + turn) % 400 AS INT)) END AS expires_on")
CACHE_CTE = f"""cache AS (SELECT *, CAST(expires_on AS TIMESTAMP) AS expires_at FROM (SELECT {CACHE} FROM conversations))"""
NOW = dt.datetime(2024, 7, 1)


def cache_rows(spark, d):
    return A.table(spark, d, "conversations").selectExpr(*[p.strip() for p in _split(CACHE)]).withColumn(
        "expires_at", F.col("expires_on").cast("timestamp")).drop("expires_on")


def now():
    return F.lit(NOW).cast("timestamp")


@query("C-1_cache_keys", S.with_(S.FACTS) + r"""
, s AS (SELECT entity, indicator_code, count(*) AS n, max(date) AS last_date FROM facts WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT entity, indicator_code, 'forecast:' || entity || ':' || indicator_code || ':' || left(sha256('task=forecast|rev=6|cascade=a,b|country=' || entity || '|indicator=' || indicator_code
  || '|last_date=' || CAST(last_date AS VARCHAR) || '|observations=' || CAST(n AS VARCHAR)), 16) AS cache_key FROM s""")
def _(spark, d):
    key = X.cache_key("forecast", F.col("entity"), F.col("indicator_code"), {
        "last_date": F.col("last_date"), "observations": F.col("n"), "cascade": F.lit("a,b")})
    return R.coverage(A.facts(spark, d)).select("entity", "indicator_code", key.alias("cache_key"))


ASKED = "'answer:' || role || ':' || CAST(conv_id - conv_id % 2 AS STRING) || ':' || CAST(turn AS STRING) AS cache_key, conv_id * 1000 + turn AS request_id"


@query("C-2_lookup", f"WITH {CACHE_CTE}, r AS (SELECT {ASKED} FROM conversations)" + """
SELECT r.request_id, r.cache_key, c.response IS NOT NULL AS hit, c.score FROM r LEFT JOIN cache c ON c.cache_key = r.cache_key
  AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-07-01') AND coalesce(response, '') <> ''""")
def _(spark, d):
    req = A.table(spark, d, "conversations").selectExpr(*[p.strip() for p in _split(ASKED)])
    return X.cache_lookup(req, cache_rows(spark, d), now()).select("request_id", "cache_key", "hit", "score")


@query("C-2_hit_counts", f"WITH {CACHE_CTE}, r AS (SELECT {ASKED} FROM conversations)" + """
SELECT cache_key, hits + CASE WHEN (expires_at IS NULL OR expires_at > TIMESTAMP '2024-07-01') AND coalesce(response, '') <> '' THEN coalesce(n, 0) ELSE 0 END AS hits
FROM cache LEFT JOIN (SELECT cache_key, count(*) AS n FROM r GROUP BY 1) USING (cache_key)""")
def _(spark, d):
    req = A.table(spark, d, "conversations").selectExpr(*[p.strip() for p in _split(ASKED)])
    return X.count_hits(cache_rows(spark, d), req, now()).select("cache_key", "hits")


@query("C-3_store", f"WITH {CACHE_CTE}" + """
SELECT cache_key, CASE WHEN turn % 2 = 0 THEN 0 ELSE hits END AS hits, CASE WHEN turn % 2 = 0 THEN 'new' ELSE response END AS response,
  CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2024-10-01' ELSE expires_at END AS expires_at FROM cache""")
def _(spark, d):
    from panelmark.operators.sinks import upsert

    old = cache_rows(spark, d)
    new = old.where("turn % 2 = 0").withColumn("hits", F.lit(0).cast("long")).withColumn("response", F.lit("new")).withColumn(
        "expires_at", F.lit(dt.datetime(2024, 10, 1)).cast("timestamp"))
    return upsert(old, new, ["cache_key"]).select("cache_key", "hits", "response", "expires_at")


@query("C-4_prune", f"WITH {CACHE_CTE} SELECT cache_key FROM cache WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-07-01'")
def _(spark, d):
    return X.prune(cache_rows(spark, d), now()).select("cache_key")


@query("C-5_invalidate", f"WITH {CACHE_CTE} SELECT count(*) AS removed FROM cache WHERE starts_with(cache_key, 'answer:user:')")
def _(spark, d):
    return X.invalidate(cache_rows(spark, d), "answer:user:")[1]


STATS = f"WITH {CACHE_CTE}" + """
SELECT count(*) AS entries, coalesce(sum(hits), 0) AS hits, avg(score) AS mean_score, sum(hits) / (sum(hits) + count(*)) AS hit_rate FROM cache WHERE expires_at > TIMESTAMP '2024-07-01'"""


@query("A-13_cache_stats", STATS)
@query("C-6_stats", STATS)
def _(spark, d):
    return X.cache_stats(cache_rows(spark, d), now())


@query("ST-5_request_budget", """
WITH l AS (SELECT event_id, user_id % 20 AS client, date_trunc('second', ts) AS seen FROM events),
d AS (SELECT *, (SELECT count(*) FROM l m WHERE m.client = l.client AND m.seen > l.seen - INTERVAL 60 SECOND AND m.seen <= l.seen) AS last_minute,
  count(*) OVER (PARTITION BY client, CAST(seen AS DATE) ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS day_so_far FROM l)
SELECT event_id, last_minute, day_so_far, last_minute > 1 OR day_so_far > 12 AS over_budget FROM d""")
def _(spark, d):
    log = A.table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 20).alias("client"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    return X.request_budget(log, per_minute=1, per_day=12).select("event_id", "last_minute", "day_so_far", "over_budget")
