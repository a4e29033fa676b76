"""Read surface: projections, joins, aggregates, windows, sorted lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelmark.operators import latest as L
from panelmark.operators import lists
from panelmark.operators import query as Q
from panelmark.operators import ranking as R
from panelmark.operators.anomaly import detect_anomalies
from panelmark.plans import sql as S
from panelmark.plans.registry import query
from panelmark.sources import adapters as A
from panelmark.sources import reference as ref

TODAY = dt.date(2001, 8, 15)
KEYS = ["source", "indicator_code", "entity"]


def base(spark, d):
    return A.facts(spark, d), ref.catalog(spark), ref.sources(spark), A.profiles(spark, d)


def flagged(spark, d):
    return detect_anomalies(A.facts(spark, d), KEYS)


F_ = S.with_(S.FACTS)
FL = S.with_(S.FACTS, S.LATEST)
FA = S.with_(S.FACTS, S.anomalies())

@query("P-1_list_countries", S.with_(S.PROFILES) + "SELECT entity, entity_name, region FROM profiles ORDER BY entity_name")
def _(spark, d):
    return lists.list_countries(A.profiles(spark, d))


@query("P-2_list_sources", S.with_(S.FACTS, S.SOURCES) + """
SELECT s.source, s.is_active, s.last_run, coalesce(n, 0) AS observations FROM srcs s
LEFT JOIN (SELECT source, count(*) AS n FROM facts GROUP BY 1) USING (source) ORDER BY 1""")
def _(spark, d):
    return lists.list_sources(ref.sources(spark), A.facts(spark, d))


@query("P-3_series_rows", S.with_(S.FACTS, S.CATALOG, S.SOURCES, S.PROFILES) + """
SELECT f.entity, p.entity_name, f.indicator_code, f.source, c.indicator_name, c.unit, f.date, f.value
FROM facts f JOIN catalog c USING (source, indicator_code) JOIN srcs s USING (source) LEFT JOIN profiles p USING (entity)""")
def _(spark, d):
    return L.series_rows(*base(spark, d))


@query("P-4_history", F_ + "SELECT * FROM facts WHERE value IS NOT NULL")
def _(spark, d):
    return L.history(A.facts(spark, d))


@query("P-5_window", S.with_(S.FACTS, S.CATALOG, S.SOURCES, S.PROFILES, S.OBSERVATIONS) + """
SELECT entity, indicator_code, source, date, value FROM obs WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-01'""")
def _(spark, d):
    return (lists.in_window(L.describe(*base(spark, d)), dt.date(1996, 3, 1), dt.date(1998, 2, 1))
            .select("entity", "indicator_code", "source", "date", "value"))


@query("P-6_recency_cutoff", FL + """
SELECT entity, indicator_code, date, value,
  row_number() OVER (PARTITION BY indicator_code ORDER BY value DESC, entity) AS rank,
  count(*) OVER (PARTITION BY indicator_code) AS entity_count
FROM latest WHERE date >= DATE '2001-08-15' - 365""")
def _(spark, d):
    return R.rank_entities(L.latest(A.facts(spark, d)), max_age_years=1, today=TODAY).select(
        "entity", "indicator_code", "date", "value", "rank", "entity_count")


@query("P-7_recency_fallback", FL + """
, l2 AS (SELECT *, count(*) FILTER (date >= DATE '2002-08-20' - 365) OVER (PARTITION BY indicator_code) AS fresh FROM latest)
SELECT entity, indicator_code, date, value, fresh = 0 AS recency_dropped,
  row_number() OVER (PARTITION BY indicator_code ORDER BY value DESC, entity) AS rank
FROM l2 WHERE fresh = 0 OR date >= DATE '2002-08-20' - 365""")
def _(spark, d):
    return R.rank_entities(L.latest(A.facts(spark, d)), max_age_years=1, today=dt.date(2002, 8, 20), fallback=True).select(
        "entity", "indicator_code", "date", "value", "recency_dropped", "rank")


@query("J-1_observations", S.with_(S.FACTS, S.CATALOG, S.SOURCES, S.PROFILES_SOME, S.OBSERVATIONS) + "SELECT * FROM obs")
def _(spark, d):
    return L.describe(*base(spark, d)[:3], A.profiles(spark, d, missing="NAY"))


@query("J-2_latest_described", S.with_(S.FACTS, S.LATEST, S.CATALOG, S.SOURCES, S.PROFILES) + """
SELECT f.entity, f.indicator_code, f.source, f.date, f.value, c.indicator_name, c.unit, c.frequency, c.concept,
  c.is_primary, s.is_active, p.entity_name, p.region
FROM latest f JOIN catalog c USING (source, indicator_code) JOIN srcs s USING (source) LEFT JOIN profiles p USING (entity)""")
def _(spark, d):
    return L.describe_latest(*base(spark, d))


@query("J-3_displayed_flag", S.with_(S.FACTS, S.LATEST, S.anomalies()) + """
SELECT l.entity, l.indicator_code, l.date, l.value,
  EXISTS (SELECT 1 FROM anomalies a WHERE a.entity = l.entity AND a.indicator_code = l.indicator_code
          AND a.date = l.date) AS has_anomaly FROM latest l""")
def _(spark, d):
    _f, _, _, countries = base(spark, d)
    return L.map_points(_f, detect_anomalies(_f, KEYS), countries).select(
        "entity", "indicator_code", "date", "value", "has_anomaly")


@query("J-4_anomalies_described", S.with_(S.FACTS, S.anomalies(), S.CATALOG, S.PROFILES) + """
SELECT a.*, c.indicator_name, p.entity_name FROM anomalies a JOIN catalog c USING (source, indicator_code)
LEFT JOIN profiles p USING (entity)""")
def _(spark, d):
    _f, cat, _, countries = base(spark, d)
    return L.described_anomalies(detect_anomalies(_f, KEYS), cat, countries)


@query("J-11_chart_history", FA + """
SELECT f.source, f.indicator_code, f.entity, f.date, f.value, a.z_score, a.deviation_type, a.date IS NOT NULL AS flagged
FROM facts f LEFT JOIN anomalies a USING (source, indicator_code, entity, date) WHERE f.value IS NOT NULL""")
def _(spark, d):
    _f = A.facts(spark, d)
    return lists.chart_history(_f, detect_anomalies(_f, KEYS), KEYS)


@query("J-12_rank_map", S.with_(S.FACTS, S.LATEST, S.PROFILES) + """
SELECT p.entity, p.entity_name, 'ORD.CNT' AS indicator_code, l.value, l.rank FROM profiles p
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY value DESC, entity) AS rank FROM latest WHERE indicator_code = 'ORD.CNT') l ON l.entity = p.entity""")
def _(spark, d):
    _f, _, _, countries = base(spark, d)
    return R.rank_map(L.latest(_f), countries, "ORD.CNT")


@query("J-13_entity_series_order", S.with_(S.FACTS, S.CATALOG, S.META) + """
, held AS (SELECT DISTINCT entity, source, indicator_code FROM facts),
known AS (SELECT source, indicator_code, CASE WHEN is_primary THEN 1000000 ELSE 0 END + country_count AS sc FROM meta WHERE concept IS NOT NULL)
SELECT entity, source, indicator_code, coalesce(sc, -1) AS score,
  row_number() OVER (PARTITION BY entity ORDER BY coalesce(sc, -1) DESC, indicator_code, source) AS place
FROM held LEFT JOIN known USING (source, indicator_code)""")
@query("L-3_series_order", S.with_(S.FACTS, S.CATALOG, S.META) + """
, held AS (SELECT DISTINCT entity, source, indicator_code FROM facts),
known AS (SELECT source, indicator_code, CASE WHEN is_primary THEN 1000000 ELSE 0 END + country_count AS sc FROM meta WHERE concept IS NOT NULL)
SELECT entity, source, indicator_code, coalesce(sc, -1) AS score,
  row_number() OVER (PARTITION BY entity ORDER BY coalesce(sc, -1) DESC, indicator_code, source) AS place
FROM held LEFT JOIN known USING (source, indicator_code)""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.entity_series_order(_f, R.indicator_metadata(_f, cat.where("concept IS NOT NULL")))


@query("A-1_indicator_metadata", S.with_(S.FACTS, S.CATALOG, S.META) + "SELECT * FROM meta")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.indicator_metadata(_f, cat)


@query("A-2_indicator_options", S.with_(S.FACTS, S.CATALOG, S.META) + """
SELECT source, indicator_code, indicator_name, category, unit, frequency, country_count FROM meta""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.indicator_options(_f, cat)


@query("A-3_table_counts", S.with_(S.FACTS, S.PROFILES, S.CATALOG, S.anomalies()) + """
SELECT (SELECT count(*) FROM profiles) AS countries, (SELECT count(*) FROM catalog) AS indicators,
  (SELECT count(*) FROM facts) AS observations, (SELECT count(*) FROM anomalies) AS anomalies""")
def _(spark, d):
    _f, cat, _, countries = base(spark, d)
    return R.table_counts({"countries": countries, "indicators": cat, "observations": _f,
                           "anomalies": detect_anomalies(_f, KEYS)})


@query("A-4_coverage", F_ + """
SELECT entity, indicator_code, count(*) AS n, min(date) AS first_date, max(date) AS last_date
FROM facts WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return R.coverage(A.facts(spark, d))


SUMMARY = """
SELECT {k}, arg_max(value, date) AS latest_value, max(date) AS latest_date, min(value) AS min_value,
  min(date) FILTER (value = lo) AS min_date, max(value) AS max_value, min(date) FILTER (value = hi) AS max_date,
  count(*) AS n, min(date) AS first_date, max(date) AS last_date
FROM (SELECT *, min(value) OVER (PARTITION BY {k}) AS lo, max(value) OVER (PARTITION BY {k}) AS hi FROM {t} WHERE value IS NOT NULL)
GROUP BY {k}"""


@query("A-5_series_summary", F_ + SUMMARY.format(k="source, entity, indicator_code", t="facts"))
def _(spark, d):
    return R.series_summary(A.facts(spark, d), KEYS)


@query("A-5_event_series_summary", S.with_(S.EVENTS) + SUMMARY.format(k="source, entity, indicator_code", t="efacts"))
def _(spark, d):
    return R.series_summary(A.event_facts(spark, d), KEYS)


@query("A-6_concepts", S.with_(S.FACTS, S.CATALOG) + """
SELECT list_sort(list(DISTINCT concept)) AS concepts FROM catalog
WHERE concept IS NOT NULL AND (source, indicator_code) IN (SELECT source, indicator_code FROM facts)""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.distinct_concepts(cat.join(_f, ["source", "indicator_code"], "left_semi"))


@query("A-7_primaries", S.with_(S.FACTS, S.CATALOG) + """
SELECT concept, count(*) FILTER (is_primary) AS primaries FROM catalog
WHERE concept IS NOT NULL AND (source, indicator_code) IN (SELECT source, indicator_code FROM facts) GROUP BY 1""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.primaries_per_concept(cat.join(_f, ["source", "indicator_code"], "left_semi"))


@query("A-8_concept_groups", S.with_(S.FACTS, S.CATALOG, S.META) + """
, placed AS (SELECT source, indicator_code, coalesce(concept, 'other') AS concept, country_count,
  row_number() OVER (PARTITION BY coalesce(concept, 'other') ORDER BY is_primary DESC, country_count DESC, source, indicator_code) AS place FROM meta)
SELECT p.*, h.country_count AS group_coverage FROM placed p JOIN placed h ON h.concept = p.concept AND h.place = 1""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return R.concept_groups(R.indicator_metadata(_f, cat)).select(
        "source", "indicator_code", "concept", "country_count", "place", "group_coverage")


@query("W-1_latest", FL + "SELECT entity, indicator_code, source, date, value FROM latest")
def _(spark, d):
    return L.latest(A.facts(spark, d))


@query("W-1_latest_events", S.with_(S.EVENTS) + """
SELECT source, entity, indicator_code, max(date) AS date, arg_max(value, date) AS value FROM efacts GROUP BY 1, 2, 3""")
def _(spark, d):
    return L.latest(A.event_facts(spark, d))


@query("W-2_map", S.with_(S.FACTS, S.LATEST, S.PROFILES, S.anomalies()) + """
SELECT l.entity, l.indicator_code, l.source, l.date, l.value, p.entity_name,
  (l.entity, l.indicator_code, l.date) IN (SELECT entity, indicator_code, date FROM anomalies) AS has_anomaly
FROM latest l LEFT JOIN profiles p USING (entity)""")
def _(spark, d):
    _f, _, _, countries = base(spark, d)
    return L.map_points(_f, detect_anomalies(_f, KEYS), countries)


@query("W-3_entity_latest", S.with_(S.FACTS, S.CATALOG) + """
SELECT f.entity, f.indicator_code, f.source, f.date, f.value, c.indicator_name, c.unit FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, indicator_code ORDER BY date DESC, source) AS rn FROM facts) f
JOIN catalog c USING (source, indicator_code) WHERE rn = 1""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    return L.entity_latest(_f, cat)


RANKED = """
SELECT {cols}, row_number() OVER (PARTITION BY indicator_code ORDER BY value {dir}, entity) AS rank,
  count(*) OVER (PARTITION BY indicator_code) AS entity_count, min(date) OVER (PARTITION BY indicator_code) AS earliest,
  max(date) OVER (PARTITION BY indicator_code) AS newest"""


@query("W-4_ranking", S.with_(S.FACTS, S.LATEST, S.PROFILES) + RANKED.format(
    cols="entity, indicator_code, source, date, value, entity_name, region", dir="DESC")
    + ", false AS truncated FROM latest LEFT JOIN profiles USING (entity)")
def _(spark, d):
    _f, _, _, countries = base(spark, d)
    ranked = R.rank_entities(L.latest(_f))
    return ranked.join(countries.select("entity", "entity_name", "region"), "entity", "left")


@query("W-4_ranking_limited", FL + "SELECT *, entity_count > 10 AS truncated FROM (" + RANKED.format(
    cols="entity, indicator_code, source, date, value", dir="ASC") + " FROM latest) WHERE rank <= 10")
def _(spark, d):
    return R.rank_entities(L.latest(A.facts(spark, d)), order="asc", limit=10)


@query("W-4_ranking_wide", S.with_(S.EVENTS) + """
, l AS (SELECT source, entity, indicator_code, max(date) AS date, arg_max(value, date) AS value FROM efacts GROUP BY 1, 2, 3)""" + RANKED.format(
    cols="entity, indicator_code, source, date, value", dir="DESC") + ", false AS truncated FROM l")
def _(spark, d):
    return R.rank_entities(L.latest(A.event_facts(spark, d)))


@query("U-3_alternatives", S.with_(S.FACTS, S.CATALOG) + """
SELECT a.source, a.indicator_code, a.concept, b.source AS alt_source, b.indicator_code AS alt_code
FROM catalog a JOIN catalog b ON a.concept = b.concept AND a.indicator_code <> b.indicator_code
WHERE (b.source, b.indicator_code) IN (SELECT source, indicator_code FROM facts)""")
def _(spark, d):
    _f, cat, _, _ = base(spark, d)
    held = _f.select(F.col("source").alias("alt_source"), F.col("indicator_code").alias("alt_code"))
    return R.alternatives(cat).join(held, ["alt_source", "alt_code"], "left_semi")


RAIL = """
, r AS (SELECT entity, indicator_code, value, row_number() OVER (PARTITION BY indicator_code ORDER BY value DESC, entity) AS rank,
  count(*) OVER (PARTITION BY indicator_code) AS n FROM {t})
SELECT entity, indicator_code, value, rank, n, CASE WHEN rank <= 5 THEN 'top' ELSE 'bottom' END AS part,
  CASE WHEN n > 8 THEN n - 8 ELSE greatest(n - 5, 0) END AS gap
FROM r WHERE rank <= 5 OR (n > 8 AND rank > n - 3)"""


@query("W-5_rail", FL + RAIL.format(t="latest"))
def _(spark, d):
    return R.ranking_rail(L.latest(A.facts(spark, d))).drop("source", "date")


@query("W-5_rail_events", S.with_(S.EVENTS) + """
, l AS (SELECT entity, indicator_code, arg_max(value, date) AS value FROM efacts GROUP BY 1, 2)""" + RAIL.format(t="l"))
def _(spark, d):
    return R.ranking_rail(L.latest(A.event_facts(spark, d))).drop("source", "date")


FMT = "CASE WHEN abs({x}) >= 1000 THEN round_even({x}, 0) WHEN abs({x}) >= 10 THEN round_even({x}, 1) ELSE round_even({x}, 2) END"


@query("W-6_changes", F_ + """
, s AS (SELECT source, entity, indicator_code, date, value, row_number() OVER w AS rn FROM facts WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY source, entity, indicator_code ORDER BY date DESC)),
c AS (SELECT a.source, a.entity, a.indicator_code, a.date AS to_date, b.rn - 1 AS periods, b.date AS from_date, a.value - b.value AS x
  FROM s a JOIN s b USING (source, entity, indicator_code) WHERE a.rn = 1 AND b.rn IN (2, 6))
SELECT source, entity, indicator_code, to_date, periods, from_date, """ + FMT.format(x="x") + " AS delta, printf('%+g', "
    + FMT.format(x="x") + ") AS text FROM c")
def _(spark, d):
    return Q.changes(A.facts(spark, d), KEYS)


@query("W-7_anomaly_moves", FA + """
, s AS (SELECT source, entity, indicator_code, date, lag(date) OVER w AS previous_date, lag(value) OVER w AS previous_value
  FROM facts WHERE value IS NOT NULL WINDOW w AS (PARTITION BY source, entity, indicator_code ORDER BY date))
SELECT a.*, previous_date, previous_value, printf('%+g', """ + FMT.format(x="(value - previous_value)") + """) AS change_text
FROM anomalies a LEFT JOIN s USING (source, entity, indicator_code, date)""")
def _(spark, d):
    _f = A.facts(spark, d)
    return Q.anomaly_moves(detect_anomalies(_f, KEYS), _f, KEYS)


def recent_sql(n):
    return f"""SELECT source, indicator_code, entity, date, value FROM (SELECT *, row_number() OVER (
  PARTITION BY source, indicator_code, entity ORDER BY date DESC) AS rn FROM facts WHERE value IS NOT NULL) WHERE rn <= {n}"""


@query("W-8_recent_points", F_ + recent_sql(6))
def _(spark, d):
    return L.recent(A.facts(spark, d), 6, KEYS)


@query("W-9_anomaly_windows", FA + """
, s AS (SELECT source, entity, indicator_code, date, value, row_number() OVER w AS i
  FROM facts WHERE value IS NOT NULL WINDOW w AS (PARTITION BY source, entity, indicator_code ORDER BY date))
SELECT a.source, a.entity, a.indicator_code, a.date AS anomaly_date, count(*) AS points, min(p.date) AS first_date,
  max(p.date) AS last_date, round(sum(p.value), 4) AS total
FROM anomalies a JOIN s c ON (c.source, c.entity, c.indicator_code, c.date) = (a.source, a.entity, a.indicator_code, a.date)
JOIN s p ON (p.source, p.entity, p.indicator_code) = (a.source, a.entity, a.indicator_code)
  AND p.i >= greatest(c.i - 6, 1) AND p.i < greatest(c.i - 6, 1) + 12
GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    _f = A.facts(spark, d)
    rows = Q.anomaly_windows(detect_anomalies(_f, KEYS), _f, KEYS)
    return rows.select(
        *KEYS, "anomaly_date", F.size("window").alias("points"), F.array_min("window")["date"].alias("first_date"),
        F.array_max("window")["date"].alias("last_date"),
        F.round(F.aggregate("window", F.lit(0.0), lambda a, p: a + p["value"]), 4).alias("total"))


@query("W-10_severe_feed", FA + """
SELECT source, indicator_code, entity, date, value, z_score, deviation_type FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, indicator_code ORDER BY coalesce(abs(z_score), -1) DESC, date DESC, date) AS rn FROM anomalies)
WHERE rn = 1 ORDER BY coalesce(abs(z_score), -1) DESC, date DESC, entity, indicator_code LIMIT 9""")
def _(spark, d):
    return L.severe_feed(flagged(spark, d))


@query("W-13_plotted", F_ + """
SELECT source, indicator_code, entity, count(*) AS plotted, min(date) AS first_date FROM (""" + recent_sql(36) + ") GROUP BY 1, 2, 3")
def _(spark, d):
    return L.plotted_context(A.facts(spark, d), KEYS)


@query("L-1_newest_anomalies", FA + "SELECT * FROM anomalies ORDER BY date DESC, entity, indicator_code, source LIMIT 100")
def _(spark, d):
    return L.newest_anomalies(flagged(spark, d))


@query("L-1_pages", FA + """
, a AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY date DESC, entity, indicator_code, source) AS i FROM anomalies),
e AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY date DESC, entity, indicator_code, source) AS i FROM anomalies WHERE entity = 'NAB')
SELECT 'most' AS page, source, indicator_code, entity, date, n > 500 AS truncated FROM a WHERE i <= 500
UNION ALL SELECT 'few', source, indicator_code, entity, date, n > 7 FROM a WHERE i <= 7
UNION ALL SELECT 'one', source, indicator_code, entity, date, n > 500 FROM e WHERE i <= 500""")
def _(spark, d):
    found = flagged(spark, d)
    pages = {"most": L.newest_page(found, 10_000), "few": L.newest_page(found, 7), "one": L.newest_page(found, 500, entity="NAB")}
    out = [p.select(F.lit(n).alias("page"), *KEYS, "date", "truncated") for n, p in pages.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("L-2_notable_anomalies", FA + """
SELECT * FROM anomalies ORDER BY z_score IS NULL, abs(z_score) DESC, date DESC, entity, indicator_code, source LIMIT 10""")
def _(spark, d):
    return L.notable_anomalies(flagged(spark, d))


@query("L-4_bounded_series", S.with_(S.FACTS, S.PROFILES) + """
SELECT DISTINCT entity, indicator_code FROM facts WHERE entity IN (SELECT entity FROM profiles WHERE region = 'ASIA')
ORDER BY 1, 2 LIMIT 400""")
def _(spark, d):
    _f, _, _, countries = base(spark, d)
    return R.bounded_series(_f, countries.where("region = 'ASIA'"))
