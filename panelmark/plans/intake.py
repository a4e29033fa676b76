"""Raw rows, normalisation, validation, sinks and landed payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelmark.functions import codes as C
from panelmark.functions import labels as B
from panelmark.functions import periods as P
from panelmark.operators import ingest as I
from panelmark.operators import lists
from panelmark.operators import quality as Qy
from panelmark.operators import sinks as K
from panelmark.operators.anomaly import detect_anomalies
from panelmark.operators.ranking import clamp
from panelmark.plans import sql as S
from panelmark.plans.read import FMT, KEYS, TODAY
from panelmark.plans.registry import query
from panelmark.session import constant, fresh_dir
from panelmark.sources import adapters as A
from panelmark.sources import landed as Z
from panelmark.sources import payloads as Y
from panelmark.sources import raw as W
from panelmark.sources import reference as ref


def rules(spark, d, shape, cutoff=None):
    return I.Rules(shape, f"raw_{shape}", W.index(spark, d, shape), W.indicators(spark), cutoff)


def classified(spark, d, shape, cutoff=None):
    return I.classify(W.raw_rows(spark, d, shape), rules(spark, d, shape, cutoff), TODAY)


def raw_sql(shape):
    return f"raw AS (SELECT {', '.join(W.columns(shape))} FROM ({W.BASE}))"


PARSED = r"""
parsed AS (SELECT *, CASE WHEN regexp_full_match(p, '\d{4}-\d{2}-\d{2}') THEN try_cast(p AS DATE)
    WHEN regexp_full_match(p, '(?i)\d{4}-?Q[1-4]') THEN try_cast(left(p, 4) || '-' || lpad(CAST(CAST(right(p, 1) AS INT) * 3 - 2 AS VARCHAR), 2, '0') || '-01' AS DATE)
    WHEN regexp_full_match(p, '(?i)\d{4}-?M\d{1,2}') THEN try_cast(left(p, 4) || '-' || lpad(regexp_extract(p, '(\d{1,2})$', 1), 2, '0') || '-01' AS DATE)
    WHEN regexp_full_match(p, '\d{4}-\d{1,2}') THEN try_cast(left(p, 4) || '-' || lpad(regexp_extract(p, '-(\d{1,2})$', 1), 2, '0') || '-01' AS DATE)
    WHEN regexp_full_match(p, '\d{4}') THEN try_cast(p || '-01-01' AS DATE) END AS date,
  CASE WHEN regexp_full_match(p, '\d{4}-\d{2}-\d{2}') THEN 'daily' WHEN regexp_full_match(p, '(?i)\d{4}-?Q[1-4]') THEN 'quarterly'
    WHEN regexp_full_match(p, '(?i)\d{4}-?M\d{1,2}|\d{4}-\d{1,2}') THEN 'monthly' WHEN regexp_full_match(p, '\d{4}') THEN 'annual' END AS fq,
  try_cast(trim(value_raw) AS DOUBLE) AS value, trim(coalesce(indicator_raw, '')) AS code0
  FROM (SELECT *, trim(period_raw) AS p FROM raw))"""

DIMS = S.values("kinds", ["indicator_code", "kind", "unit", "frequency", "name"], W.INDICATORS) + ",\n" + S.values(
    "bounds", ["kind", "low", "high"], ref.BOUNDS)

INDEX = f"idx AS (SELECT {W.ISO3} AS entity, {W.ISO2} AS iso2 FROM (SELECT n_nationkey AS k FROM nation))"
KEYED_INDEX = f"""idx AS (SELECT 'S' || CAST(k AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS series_id, {W.ISO3} AS entity,
  CASE i WHEN 0 THEN 'R.CHG' WHEN 1 THEN 'R.SHARE' WHEN 2 THEN 'R.RATE' WHEN 3 THEN 'R.INDEX' WHEN 4 THEN 'R.CUR'
  WHEN 5 THEN 'R.COUNT' ELSE 'R.FREE' END AS series_indicator FROM (SELECT n_nationkey AS k FROM nation), range(7) r(i))"""

_TAIL = """
  WHEN date IS NULL THEN 'NormalizationError' {cut}
  WHEN value IS NULL OR code = '' THEN 'NormalizationError'
  WHEN isnan(value) OR isinf(value) THEN 'ValidationError'
  WHEN value < low OR value > high THEN 'ValidationError'
  WHEN year(date) > 2002 OR year(date) < 1900 THEN 'ValidationError' ELSE 'accepted' END AS verdict"""


def classify_sql(shape, cutoff=None):
    cut = f"WHEN year(date) > {cutoff} THEN 'skipped'" if cutoff else ""
    tail = _TAIL.format(cut=cut)
    if shape == "sdmx":
        head = f"""judged AS (SELECT p.*, i.entity, p.code0 AS code, low, high, k.unit AS dunit, k.frequency AS dfreq, CASE
  WHEN upper(trim(coalesce(entity_raw, ''))) = '' THEN 'NormalizationError'
  WHEN upper(trim(entity_raw)) IN ('XM', 'EU', 'XK', 'ZZ') THEN 'skipped' WHEN i.entity IS NULL THEN 'NormalizationError'
  WHEN trim(coalesce(value_raw, '')) = '' OR lower(trim(value_raw)) = 'nan' THEN 'skipped' {tail}
  FROM parsed p LEFT JOIN idx i ON i.iso2 = upper(trim(entity_raw)) LEFT JOIN kinds k ON k.indicator_code = code0 LEFT JOIN bounds b ON b.kind = k.kind)"""
        idx = INDEX
    elif shape == "keyed":
        head = f"""judged AS (SELECT p.*, i.entity, coalesce(i.series_indicator, '') AS code, low, high, k.unit AS dunit, k.frequency AS dfreq, CASE
  WHEN i.entity IS NULL THEN 'NormalizationError'
  WHEN trim(coalesce(value_raw, '')) IN ('', '.') THEN 'skipped' {tail}
  FROM parsed p LEFT JOIN idx i ON i.series_id = trim(entity_raw) LEFT JOIN kinds k ON k.indicator_code = i.series_indicator LEFT JOIN bounds b ON b.kind = k.kind)"""
        idx = KEYED_INDEX
    else:
        first = "WHEN c = '' THEN 'NormalizationError' " if shape == "paged" else ""
        head = f"""coded AS (SELECT *, CASE WHEN regexp_full_match(upper(trim(coalesce(entity_raw, ''))), '[A-Z]{{3}}') THEN upper(trim(entity_raw))
    ELSE upper(trim(coalesce(entity_alt, ''))) END AS c FROM parsed),
judged AS (SELECT p.*, i.entity, p.code0 AS code, low, high, k.unit AS dunit, k.frequency AS dfreq, CASE
  {first}WHEN i.entity IS NULL THEN 'skipped' WHEN code0 = '' THEN 'NormalizationError' WHEN value_raw IS NULL THEN 'skipped' {tail}
  FROM coded p LEFT JOIN idx i ON i.entity = c LEFT JOIN kinds k ON k.indicator_code = code0 LEFT JOIN bounds b ON b.kind = k.kind)"""
        idx = INDEX
    return S.with_(raw_sql(shape), PARSED, DIMS, idx, head, """classified AS (SELECT *, CASE WHEN verdict = 'accepted' AND row_number() OVER (
    PARTITION BY verdict, entity, code, date ORDER BY ordinal) > 1 THEN 'DuplicateRecord' ELSE verdict END AS outcome FROM judged)""")


OUTCOME = " SELECT ordinal, outcome FROM classified"


def outcome_of(rows):
    return rows.select("ordinal", F.coalesce("outcome.error_type", "outcome.status").alias("outcome"))


for _shape, _cut, _names in [
    ("paged", None, ["V-5_split_paged", "N-5_code_fallback"]), ("nested", 2000, ["V-5_split_nested", "N-7_projection_cutoff"]),
    ("sdmx", None, ["V-5_split_sdmx", "N-4_groupings_skipped"]), ("keyed", None, ["V-5_split_keyed", "N-6_sentinels"]),
]:
    for _name in _names[:1]:
        query(_name, classify_sql(_shape, _cut) + OUTCOME)(
            lambda spark, d, s=_shape, c=_cut: outcome_of(classified(spark, d, s, c)))


@query("N-1_parse_period", S.with_(raw_sql("paged"), PARSED) + """
SELECT ordinal, period_raw, date, CASE WHEN date IS NOT NULL THEN fq END AS frequency FROM parsed""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").withColumn("p", P.parse_period(F.col("period_raw"))).select(
        "ordinal", "period_raw", "p.date", "p.frequency")


@query("N-2_iso3", S.with_(raw_sql("paged")) + """
SELECT ordinal, CASE WHEN regexp_full_match(upper(trim(entity_raw)), '[A-Z]{3}') THEN upper(trim(entity_raw)) END AS entity FROM raw""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").select("ordinal", C.iso3(F.col("entity_raw")).alias("entity"))


@query("N-3_iso2_to_iso3", S.with_(raw_sql("sdmx"), INDEX) + """
SELECT ordinal, entity_raw, entity FROM raw LEFT JOIN idx ON iso2 = upper(trim(entity_raw))""")
def _(spark, d):
    return C.to_iso3(W.raw_rows(spark, d, "sdmx"), "entity_raw", W.index(spark, d, "sdmx")).select(
        "ordinal", "entity_raw", "entity")


@query("N-4_groupings_skipped", S.with_(raw_sql("sdmx")) + """
SELECT entity_raw, count(*) AS n, upper(trim(entity_raw)) IN ('XM', 'EU', 'XK', 'ZZ') AS is_grouping FROM raw GROUP BY 1""")
def _(spark, d):
    return W.raw_rows(spark, d, "sdmx").groupBy("entity_raw").agg(F.count("*").alias("n")).withColumn(
        "is_grouping", F.upper(F.trim("entity_raw")).isin(ref.GROUPING_ISO2))


@query("N-5_code_fallback", S.with_(raw_sql("paged")) + """
SELECT ordinal, CASE WHEN regexp_full_match(upper(trim(coalesce(entity_raw, ''))), '[A-Z]{3}') THEN upper(trim(entity_raw))
  ELSE upper(trim(coalesce(entity_alt, ''))) END AS code FROM raw""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").select(
        "ordinal", C.code_or_fallback(F.col("entity_raw"), F.col("entity_alt")).alias("code"))


@query("N-6_sentinels", S.with_(raw_sql("keyed")) + """
SELECT value_raw, count(*) AS n, trim(coalesce(value_raw, '')) IN ('', '.') AS dot, lower(trim(coalesce(value_raw, ''))) IN ('', 'nan') AS nan_word
FROM raw GROUP BY 1""")
def _(spark, d):
    v = F.col("value_raw")
    return W.raw_rows(spark, d, "keyed").groupBy("value_raw").agg(F.count("*").alias("n")).select(
        "value_raw", "n", C.is_missing(v, ".").alias("dot"), C.is_missing(v, "nan").alias("nan_word"))


@query("N-7_projection_cutoff", classify_sql("nested", 1998) + """
SELECT year(date) AS year, outcome, count(*) AS n FROM classified WHERE date IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return classified(spark, d, "nested", 1998).where("date IS NOT NULL").groupBy(
        F.year("date").alias("year"), F.coalesce("outcome.error_type", "outcome.status").alias("outcome")).agg(F.count("*").alias("n"))


@query("N-8_unit_fill", classify_sql("paged") + """
SELECT ordinal, coalesce(nullif(unit_raw, ''), dunit) AS unit FROM classified WHERE outcome = 'accepted'""")
def _(spark, d):
    return I.accepted(classified(spark, d, "paged")).select("ordinal", "unit")


@query("N-9_declared_frequency", classify_sql("keyed") + """
SELECT ordinal, code AS indicator_code, coalesce(dfreq, fq) AS frequency FROM classified WHERE outcome = 'accepted'""")
def _(spark, d):
    return I.accepted(classified(spark, d, "keyed")).select("ordinal", "indicator_code", "frequency")


@query("N-10_display_names", S.with_(raw_sql("paged"), DIMS) + """
SELECT r.indicator_raw AS indicator_code, coalesce(arg_max(name_raw, ordinal) FILTER (coalesce(name_raw, '') <> ''),
  any_value(k.name), r.indicator_raw) AS name FROM raw r LEFT JOIN kinds k ON k.indicator_code = r.indicator_raw
WHERE r.indicator_raw IS NOT NULL GROUP BY 1""")
def _(spark, d):
    rows = W.raw_rows(spark, d, "paged").where("indicator_raw IS NOT NULL")
    return Y.display_names(rows, W.indicators(spark), "ordinal")


INCOME = "CASE WHEN c_acctbal < 0 THEN 'Low income' WHEN c_acctbal < 2000 THEN 'Aggregates' WHEN c_acctbal < 4000 THEN 'Not classified' ELSE 'High income' END"
ANY3 = "CASE c_custkey % 5 WHEN 0 THEN 'JPN' WHEN 1 THEN 'TWN' WHEN 2 THEN 'AFG' ELSE 'NGA' END"


@query("N-11_imf_class", "WITH advanced AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in ref.ADVANCED) + f"""]) AS e)
SELECT c_custkey, CASE WHEN {ANY3} IN (SELECT e FROM advanced) THEN 'Advanced' WHEN {INCOME} = 'Low income' THEN 'Developing'
  ELSE 'Emerging' END AS imf_class FROM customer""")
def _(spark, d):
    rows = A.table(spark, d, "customer").selectExpr("c_custkey", f"{ANY3} AS entity", f"{INCOME} AS income")
    return rows.select("c_custkey", C.imf_class(F.col("entity"), C.income_group(F.col("income"))).alias("imf_class"))


@query("N-12_flags", S.with_(raw_sql("sdmx")) + """
, c AS (SELECT ordinal, upper(trim(entity_raw)) AS c FROM raw)
SELECT ordinal, CASE WHEN regexp_full_match(c, '[A-Z]{2}') THEN chr(127397 + ascii(c[1])) || chr(127397 + ascii(c[2])) ELSE '' END AS flag FROM c""")
def _(spark, d):
    return W.raw_rows(spark, d, "sdmx").select("ordinal", B.flag_emoji(F.col("entity_raw")).alias("flag"))


@query("N-13_income", f"""SELECT c_custkey, CASE WHEN {INCOME} NOT IN ('Aggregates', 'Not classified') THEN {INCOME} END AS income FROM customer""")
def _(spark, d):
    return A.table(spark, d, "customer").selectExpr("c_custkey", f"{INCOME} AS i").select(
        "c_custkey", C.income_group(F.col("i")).alias("income"))


TOKEN = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
PART = "p_name || ' (' || p_type || ') ' || CASE p_partkey % 4 WHEN 0 THEN 'Rate' WHEN 1 THEN 'INDEX ' WHEN 2 THEN 'rate-values' ELSE '' END"


@query("N-14_tokens", f"SELECT p_partkey, {TOKEN.format(x=PART)} AS token FROM part")
def _(spark, d):
    return A.table(spark, d, "part").selectExpr("p_partkey", f"{PART} AS t").select(
        "p_partkey", C.normalise_token(F.col("t")).alias("token"))


@query("N-15_qualifiers", f"""WITH t AS (SELECT p_partkey, {TOKEN.format(x=PART)} AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_extract(t, '^(.+)_([^_]*)$', 2) IN ({', '.join("'" + q + "'" for q in C.TRAILING_QUALIFIERS)})
  THEN regexp_extract(t, '^(.+)_([^_]*)$', 1) ELSE '' END AS head FROM t""")
def _(spark, d):
    return A.table(spark, d, "part").selectExpr("p_partkey", f"{PART} AS t").select(
        "p_partkey", C.strip_qualifier(C.normalise_token(F.col("t"))).alias("head"))


@query("N-16_lenient_date", S.with_(raw_sql("paged")) + r"""
, t AS (SELECT ordinal, left(trim(period_raw), 10) AS t FROM raw)
SELECT ordinal, CASE WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}') THEN try_cast(t AS DATE) WHEN regexp_full_match(t, '\d{4}-\d{2}')
  THEN try_cast(t || '-01' AS DATE) WHEN regexp_full_match(t, '\d{4}') THEN try_cast(t || '-01-01' AS DATE) END AS date FROM t""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").select("ordinal", P.lenient_date(F.col("period_raw")).alias("date"))


@query("N-17_fmt", S.with_(S.FACTS) + f"SELECT source, indicator_code, entity, date, {FMT.format(x='value')} AS shown FROM facts")
def _(spark, d):
    return A.facts(spark, d).select(*KEYS, "date", B.fmt(F.col("value")).alias("shown"))


@query("N-18_value_text", S.with_(S.FACTS, S.CATALOG) + """
, t AS (SELECT f.*, c.unit, CASE WHEN abs(value) >= 1000 THEN format('{:,.0f}', value + 0) WHEN abs(value) >= 10 THEN format('{:,.1f}', value)
  ELSE format('{:,.2f}', value) END AS n FROM facts f JOIN catalog c USING (source, indicator_code))
SELECT source, indicator_code, entity, date, CASE WHEN value IS NULL THEN 'No data' WHEN unit = '%' THEN n || '%'
  WHEN unit = 'US$' THEN '$' || n WHEN unit IS NULL THEN n ELSE n || ' ' || unit END AS text,
  CASE WHEN unit = '%' THEN '%' WHEN unit IS NULL THEN '' ELSE ' ' || unit END AS suffix FROM t""")
def _(spark, d):
    rows = A.facts(spark, d).join(ref.catalog(spark).select("source", "indicator_code", "unit"), ["source", "indicator_code"])
    return rows.select(*KEYS, "date", B.value_text(F.col("value"), F.col("unit")).alias("text"), B.unit_suffix(F.col("unit")).alias("suffix"))


@query("N-19_titles", S.with_(raw_sql("paged")) + r"""
SELECT ordinal, regexp_replace(coalesce(name_raw, ''), '[\s,;·-]+$', '') AS title FROM raw""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").select("ordinal", B.title(F.col("name_raw")).alias("title"))


@query("N-20_basis", S.with_(S.FACTS, S.CATALOG, S.values("words", ["token", "word"], list(B.BASIS_WORDS.items()))) + """
, w AS (SELECT source, indicator_code, 1 AS nr, price_basis AS t FROM catalog UNION ALL SELECT source, indicator_code, 2, transformation FROM catalog
  UNION ALL SELECT source, indicator_code, 3, observation_basis FROM catalog UNION ALL SELECT source, indicator_code, 4, coverage_definition FROM catalog
  UNION ALL SELECT source, indicator_code, 5, seasonal_adjustment FROM catalog)
SELECT f.source, f.indicator_code, n, (SELECT string_agg(word, ', ' ORDER BY nr) FROM w JOIN words ON token = t
  WHERE w.source = f.source AND w.indicator_code = f.indicator_code) AS basis
FROM (SELECT source, indicator_code, count(*) AS n FROM facts GROUP BY 1, 2) f""")
def _(spark, d):
    sizes = A.facts(spark, d).groupBy("source", "indicator_code").agg(F.count("*").alias("n"))
    words = ref.catalog(spark).select("source", "indicator_code", B.basis_summary().alias("b"))
    return sizes.join(words, ["source", "indicator_code"]).select(
        "source", "indicator_code", "n", F.nullif(F.concat_ws(", ", "b"), F.lit("")).alias("basis"))


FREQ = "CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'annual' ELSE NULL END"


@query("N-21_advance", f"""SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE) + to_months(CAST((o_orderkey % 9) *
  CASE lower({FREQ}) WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END AS INT))) AS DATE) AS date,
  CASE lower({FREQ}) WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 8 ELSE 5 END AS horizon FROM orders""")
def _(spark, d):
    rows = A.table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS d", f"{FREQ} AS f", "o_orderkey % 9 AS n")
    return rows.select("o_orderkey", P.advance(F.col("d"), F.col("f"), F.col("n")).alias("date"), P.horizon_for(F.col("f")).alias("horizon"))


AT = "CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) || ' 10:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ':00' END"


@query("N-22_elapsed", f"""WITH e AS (SELECT event_id, {AT} AS raw FROM events),
s AS (SELECT event_id, raw, try_cast(raw AS TIMESTAMP) AS seen, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(try_cast(raw AS TIMESTAMP)) AS x FROM e)
SELECT event_id, CASE WHEN raw = '' THEN 'no successful run on record' WHEN seen IS NULL THEN 'unreadable timestamp' WHEN x < 60 THEN 'just now'
  WHEN x < 3600 THEN CAST(CAST(floor(x / 60) AS INT) AS VARCHAR) || ' min ago' WHEN x < 172800 THEN CAST(CAST(floor(x / 3600) AS INT) AS VARCHAR) || ' hr ago'
  ELSE CAST(CAST(floor(x / 86400) AS INT) AS VARCHAR) || ' days ago' END AS elapsed FROM s""")
def _(spark, d):
    rows = A.table(spark, d, "events").selectExpr("event_id", f"{AT} AS raw")
    now = F.lit(dt.datetime(2024, 1, 30, 12)).cast("timestamp")
    return rows.select("event_id", B.elapsed(F.col("raw").try_cast("timestamp"), now, F.col("raw")).alias("elapsed"))


@query("N-26_utc_stamp", f"""WITH e AS (SELECT event_id, {AT} AS raw FROM events)
SELECT event_id, CASE WHEN raw = '' THEN 'never' WHEN try_cast(raw AS TIMESTAMP) IS NULL THEN 'unknown'
  ELSE strftime(try_cast(raw AS TIMESTAMP), '%-d %b %H:%Mz') END AS stamp FROM e""")
def _(spark, d):
    rows = A.table(spark, d, "events").selectExpr("event_id", f"{AT} AS raw")
    return rows.select("event_id", B.utc_stamp(F.col("raw").try_cast("timestamp"), F.col("raw")).alias("stamp"))


LAB = "CASE c_custkey % 6 WHEN 0 THEN 'gdp_growth' WHEN 1 THEN 'odd_concept' WHEN 2 THEN NULL WHEN 3 THEN 'fred' WHEN 4 THEN 'timesfm' ELSE 'mistral_agent' END"


@query("N-23_labels", S.with_(
    S.values("cl", ["t", "l"], list(B.CONCEPT_LABELS.items())), S.values("sl", ["t", "l"], list(B.SOURCE_LABELS.items())),
    S.values("ml", ["t", "l"], list(B.MODEL_LABELS.items()))) + f"""SELECT c_custkey,
  CASE WHEN x IS NULL THEN 'Other' ELSE coalesce(cl.l, replace(x, '_', ' ')) END AS concept, CASE WHEN x IS NULL THEN 'Unknown' ELSE coalesce(sl.l, x) END AS source,
  CASE WHEN x IS NULL THEN 'unknown' ELSE coalesce(ml.l, x) END AS model
FROM (SELECT c_custkey, {LAB} AS x FROM customer) LEFT JOIN cl ON cl.t = x LEFT JOIN sl ON sl.t = x LEFT JOIN ml ON ml.t = x""")
def _(spark, d):
    x = F.col("x")
    return A.table(spark, d, "customer").selectExpr("c_custkey", f"{LAB} AS x").select(
        "c_custkey", B.concept_label(x).alias("concept"), B.source_label(x).alias("source"), B.model_label(x).alias("model"))


@query("N-24_axis_labels", S.with_(S.FACTS) + """
, r AS (SELECT *, max(value) OVER w - min(value) OVER w AS span, CAST(value AS DECIMAL(38,6)) AS v FROM facts WINDOW w AS (PARTITION BY indicator_code))
SELECT source, indicator_code, entity, date, CASE WHEN value IS NULL THEN '' WHEN abs(value) >= 1e6 THEN CAST(CAST(round(value / 1e6, 1) AS DECIMAL(38,1)) AS VARCHAR) || 'M'
  WHEN abs(value) >= 1e4 THEN CAST(CAST(round(value / 1e3, 0) AS DECIMAL(38,0)) AS VARCHAR) || 'k' WHEN abs(value) >= 1e3 THEN CAST(CAST(round(value / 1e3, 1) AS DECIMAL(38,1)) AS VARCHAR) || 'k'
  WHEN span >= 12 THEN CAST(CAST(round(value, 0) AS DECIMAL(38,0)) AS VARCHAR) WHEN span >= 1.5 THEN CAST(CAST(round(value, 1) AS DECIMAL(38,1)) AS VARCHAR)
  ELSE CAST(CAST(round(value, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS label FROM r""")
def _(spark, d):
    f = A.facts(spark, d)
    spans = f.groupBy("indicator_code").agg((F.max("value") - F.min("value")).alias("span"))
    return f.join(spans, "indicator_code").select(*KEYS, "date", B.axis_label(F.col("value"), F.col("span")).alias("label"))


@query("N-25_anomaly_look", S.with_(S.FACTS, S.anomalies()) + """
SELECT source, indicator_code, entity, date, coalesce(abs(z_score) >= 3, false) AS severe,
  CASE deviation_type WHEN 'drop' THEN 'Drop' WHEN 'spike' THEN 'Spike' ELSE 'Structural break' END AS label,
  'z ' || CASE WHEN z_score > 0 THEN '+' ELSE '' END || CAST(CAST(round(z_score, 1) AS DECIMAL(38,1)) AS VARCHAR) AS z_text FROM anomalies""")
def _(spark, d):
    look = B.anomaly_look(F.col("deviation_type"), F.col("z_score"))
    return detect_anomalies(A.facts(spark, d), KEYS).select(*KEYS, "date", look.alias("l")).select(*KEYS, "date", "l.severe", "l.label", "l.z_text")


ACCEPTED = "SELECT entity, code AS indicator_code, date, value FROM classified WHERE outcome = 'accepted'"


@query("V-1_finite", classify_sql("paged") + """
SELECT ordinal, isnan(value) OR isinf(value) AS bad FROM classified WHERE value IS NOT NULL""")
def _(spark, d):
    return W.raw_rows(spark, d, "paged").select("ordinal", F.trim("value_raw").try_cast("double").alias("v")).where(
        "v IS NOT NULL").select("ordinal", (F.isnan("v") | (F.abs("v") == float("inf"))).alias("bad"))


@query("V-2_bounds", classify_sql("paged") + """
SELECT code AS indicator_code, outcome, count(*) AS n FROM classified WHERE outcome IN ('accepted', 'ValidationError') GROUP BY 1, 2""")
def _(spark, d):
    return outcome_counts(classified(spark, d, "paged"), ["accepted", "ValidationError"])


def outcome_counts(rows, kept):
    return rows.withColumn("outcome", F.coalesce("outcome.error_type", "outcome.status")).where(
        F.col("outcome").isin(kept)).groupBy("indicator_code", "outcome").agg(F.count("*").alias("n"))


@query("V-3_date_window", classify_sql("sdmx") + """
SELECT year(date) NOT BETWEEN 1900 AND 2002 AS outside, outcome, count(*) AS n FROM classified WHERE date IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return classified(spark, d, "sdmx").where("date IS NOT NULL").groupBy(
        (~F.year("date").between(1900, 2002)).alias("outside"),
        F.coalesce("outcome.error_type", "outcome.status").alias("outcome")).agg(F.count("*").alias("n"))


@query("V-4_duplicates", classify_sql("keyed") + """
SELECT entity, code AS indicator_code, date, count(*) AS copies, min(ordinal) FILTER (outcome = 'accepted') AS kept
FROM classified WHERE outcome IN ('accepted', 'DuplicateRecord') GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = classified(spark, d, "keyed").withColumn("o", F.coalesce("outcome.error_type", "outcome.status"))
    return rows.where(F.col("o").isin("accepted", "DuplicateRecord")).groupBy("entity", "indicator_code", "date").agg(
        F.count("*").alias("copies"), F.min(F.when(F.col("o") == "accepted", F.col("ordinal"))).alias("kept"))


@query("V-6_record_shape", classify_sql("paged") + """
SELECT outcome, count(*) AS n FROM classified WHERE outcome = 'NormalizationError' GROUP BY 1""")
def _(spark, d):
    return I.rejected(classified(spark, d, "paged")).where("error_type = 'NormalizationError'").groupBy(
        F.col("error_type").alias("outcome")).agg(F.count("*").alias("n"))


@query("V-7_run_status", classify_sql("paged") + """
, n AS (SELECT count(*) AS fetched, count(*) FILTER (outcome = 'accepted') AS inserted,
  count(*) FILTER (outcome NOT IN ('accepted', 'skipped')) + 1 AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM classified)
SELECT 'raw_paged' AS source, *, CASE WHEN failed > 0 AND inserted = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status, true AS has_run FROM n
UNION ALL SELECT 'raw_keyed', NULL, NULL, NULL, NULL, 'skipped', false
UNION ALL SELECT 'raw_lost', NULL, NULL, NULL, NULL, 'failed', false""")
def _(spark, d):
    ran = I.run_summary(classified(spark, d, "paged"), fetch_errors=1).withColumn("source", F.lit("raw_paged"))
    sources = constant(spark, "source string, configured boolean", [("raw_paged", True), ("raw_keyed", False), ("raw_lost", True)])
    return I.source_status(sources, ran)


@query("V-8_validated", classify_sql("sdmx") + ACCEPTED.replace(" FROM", ", true AS is_validated FROM"))
def _(spark, d):
    return I.accepted(classified(spark, d, "sdmx")).select("entity", "indicator_code", "date", "value", "is_validated")


@query("V-9_catalog_rules", S.with_(S.FACTS, S.CATALOG) + """
SELECT 'unclassified' AS rule, source || '/' || indicator_code AS subject,
  'concept,metric_type,transformation,observation_basis,price_basis,coverage_definition,seasonal_adjustment' AS detail
FROM catalog WHERE concept IS NULL AND (source, indicator_code) IN (SELECT source, indicator_code FROM facts)""")
def _(spark, d):
    return Qy.check_catalog(ref.catalog(spark), A.facts(spark, d))


@query("V-9_every_rule", S.with_(S.FACTS, S.CATALOG) + """
, found AS (SELECT * FROM (VALUES ('vocabulary', 'lines/LIN.QTY', 'metric_type=nonsense'), ('mixed_frequency', 'ORD.CNT', '2')) AS v(rule, subject, detail)
UNION ALL SELECT 'one_primary', concept, CAST(count(*) FILTER (is_primary AND NOT (source = 'orders' AND indicator_code = 'ORD.REV')) AS VARCHAR) FROM catalog WHERE concept IS NOT NULL GROUP BY concept
  HAVING count(*) FILTER (is_primary AND NOT (source = 'orders' AND indicator_code = 'ORD.REV')) <> 1
UNION ALL SELECT 'unclassified', source || '/' || indicator_code, 'concept,' || CASE WHEN indicator_code = 'LIN.QTY' THEN '' ELSE 'metric_type,' END
  || 'transformation,observation_basis,price_basis,coverage_definition,seasonal_adjustment'
FROM catalog WHERE concept IS NULL AND (source, indicator_code) IN (SELECT source, indicator_code FROM facts))
SELECT * FROM found""")
def _(spark, d):
    """The catalog with one word outside its vocabulary, one concept without its primary and one code of two frequencies."""
    at = lambda s, c: (F.col("source") == s) & (F.col("indicator_code") == c)
    spoilt = ref.catalog(spark).withColumn("metric_type", F.when(at("lines", "LIN.QTY"), "nonsense").otherwise(F.col("metric_type"))).withColumn(
        "is_primary", F.col("is_primary") & ~at("orders", "ORD.REV")).withColumn(
        "frequency", F.when(at("lines", "ORD.CNT"), "weekly").otherwise(F.col("frequency")))
    return Qy.check_catalog(spoilt, A.facts(spark, d))


@query("V-10_view_agreement", S.with_(S.FACTS, S.LATEST, S.CATALOG, S.SOURCES, S.PROFILES, S.OBSERVATIONS) + """
SELECT count(*) FILTER (value IS NOT NULL) AS facts, (SELECT count(*) FROM obs) AS observations,
  count(DISTINCT (entity, indicator_code)) FILTER (value IS NOT NULL) AS series, (SELECT count(*) FROM latest) AS latest, true AS agree FROM facts""")
def _(spark, d):
    return Qy.check_views(A.facts(spark, d), ref.catalog(spark), ref.sources(spark), A.profiles(spark, d))


# Sinks.
@query("K-1_upsert", S.with_(S.FACTS) + """
SELECT source, indicator_code, entity, date, CASE WHEN date >= DATE '1998-01-01' THEN value + 1 ELSE value END AS value FROM facts""")
def _(spark, d):
    f = A.facts(spark, d)
    new = f.where(F.col("date") >= "1998-01-01").withColumn("value", F.col("value") + 1)
    return K.upsert(f.where(F.col("date") < "2000-01-01"), new, K.NATURAL_KEY)


@query("K-2_upsert_catalog", classify_sql("paged") + ", " + S.CATALOG + """
, f AS (SELECT code, arg_min(coalesce(nullif(unit_raw, ''), dunit, '~'), ordinal) AS u, arg_min(coalesce(dfreq, fq), ordinal) AS q,
  arg_max(name_raw, ordinal) FILTER (coalesce(name_raw, '') <> '') AS nm FROM classified WHERE outcome = 'accepted' GROUP BY 1)
SELECT 'raw_paged' AS source, code AS indicator_code, coalesce(nm, code) AS indicator_name, nullif(u, '~') AS unit, q AS frequency FROM f
UNION ALL SELECT source, indicator_code, indicator_name, unit, frequency FROM catalog""")
def _(spark, d):
    batch = I.accepted(classified(spark, d, "paged")).withColumnRenamed("name_raw", "name")
    return K.upsert_catalog(ref.catalog(spark), batch).select("source", "indicator_code", "indicator_name", "unit", "frequency")


@query("K-1_stored", S.with_(S.FACTS) + """
SELECT source, indicator_code, entity, date, CASE WHEN year(date) >= 2000 THEN value + 1 ELSE value END AS value FROM facts""")
def _(spark, d):
    path, facts = fresh_dir(spark, "stored"), A.facts(spark, d)
    K.upsert_observations(spark, facts, path)  # an empty path at first
    K.upsert_observations(spark, facts.where(F.year("date") >= 2000).withColumn("value", F.col("value") + 1), path)
    return K.read_observations(spark, path).select("source", "indicator_code", "entity", "date", "value")


@query("K-3_error_ledger", classify_sql("paged") + """
SELECT 'run-1' AS run_id, outcome AS error_type, entity_raw, entity_alt, indicator_raw, period_raw, value_raw, unit_raw, name_raw
FROM classified WHERE outcome NOT IN ('accepted', 'skipped')""")
def _(spark, d):
    ledger = K.error_rows(I.rejected(classified(spark, d, "paged")), "run-1")
    raw = F.from_json("raw_record", ", ".join(f"{c} string" for c in I.RAW))
    return ledger.select("run_id", "error_type", raw.alias("r")).select("run_id", "error_type", "r.*")


@query("K-4_run_ledger", classify_sql("sdmx") + """
SELECT 'raw_sdmx' AS source, NULL AS base_url, true AS is_active, TIMESTAMP '2001-08-15 01:00:00' AS last_run FROM classified HAVING count(*) > 0""")
def _(spark, d):
    at = F.lit(dt.datetime(2001, 8, 15, 1)).cast("timestamp")
    runs = K.finish_run(I.run_summary(classified(spark, d, "sdmx")), "run-2", "raw_sdmx", at, at)
    known = runs.select("source", F.lit(None).cast("string").alias("base_url"), F.lit(False).alias("is_active"),
                        F.lit(None).cast("timestamp").alias("last_run"))
    return K.stamp_sources(known, runs)


@query("K-5_partitioned_layout", S.with_(S.FACTS) + "SELECT source, CAST(year(date) AS INT) AS year, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY 1, 2")
def _(spark, d):
    path = fresh_dir(spark, "facts")
    K.write_partitioned(A.facts(spark, d), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("source", "year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("K-6_register_sources", S.with_(S.SOURCES) + """
, o AS (SELECT DISTINCT lower(c_mktsegment) AS source, 'https://' || lower(c_mktsegment) || '.example' AS u FROM customer UNION SELECT 'lines', 'https://moved.example')
SELECT coalesce(s.source, o.source) AS source, coalesce(u, base_url) AS base_url, coalesce(is_active, false) AS is_active, last_run
FROM srcs s FULL JOIN o ON o.source = s.source""")
def _(spark, d):
    seg = A.table(spark, d, "customer").select(F.lower("c_mktsegment").alias("source")).distinct().withColumn(
        "base_url", F.concat(F.lit("https://"), "source", F.lit(".example")))
    offered = seg.unionAll(constant(spark, "source string, base_url string", [("lines", "https://moved.example")]))
    return K.register_sources(ref.sources(spark), offered)


@query("U-1_all_errors", classify_sql("paged") + """
SELECT error_type, count(*) AS n FROM (SELECT outcome AS error_type FROM classified WHERE outcome NOT IN ('accepted', 'skipped')
  UNION ALL SELECT 'SourceError' FROM nation WHERE n_nationkey % 5 = 0) GROUP BY 1""")
def _(spark, d):
    files = A.table(spark, d, "nation").select(
        F.col("n_name").alias("context"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("timeout")).alias("error"))
    merged = K.fetch_error_rows(files, "run-1").unionByName(K.error_rows(I.rejected(classified(spark, d, "paged")), "run-1"))
    return merged.groupBy("error_type").agg(F.count("*").alias("n"))


RECODED = "CASE WHEN substr(entity, 3, 1) = 'C' THEN 'WLD' WHEN substr(entity, 3, 1) = 'D' THEN 'EMU' WHEN substr(entity, 3, 1) = 'E' THEN 'TWN' ELSE entity END"


@query("P-8_purge_groupings", S.with_(S.FACTS, "codes AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in ref.GROUPING_CODES) + "]) AS c)") + f"""
SELECT source, indicator_code, {RECODED} AS entity, date, value FROM facts WHERE {RECODED} NOT IN (SELECT c FROM codes)""")
def _(spark, d):
    f = A.facts(spark, d).selectExpr("source", "indicator_code", f"{RECODED} AS entity", "date", "value")
    return K.purge_groupings(f, ref.grouping_codes(spark))


@query("P-8_purge_with_anomalies", S.with_(S.FACTS, "codes AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in ref.GROUPING_CODES) + "]) AS c)", S.anomalies()) + f"""
SELECT 'facts' AS kept, {RECODED} AS entity, count(*) AS n FROM facts WHERE {RECODED} NOT IN (SELECT c FROM codes) GROUP BY 2
UNION ALL SELECT 'anomalies', {RECODED}, count(*) FROM anomalies WHERE {RECODED} NOT IN (SELECT c FROM codes) GROUP BY 2""")
def _(spark, d):
    recoded = lambda df: df.withColumn("entity", F.expr(RECODED))
    f = A.facts(spark, d)
    kept = K.purge_everywhere(recoded(f), recoded(detect_anomalies(f, KEYS)), ref.grouping_codes(spark))
    counts = [df.groupBy(F.lit(label).alias("kept"), "entity").agg(F.count("*").alias("n")) for label, df in zip(("facts", "anomalies"), kept)]
    return counts[0].unionByName(counts[1])


@query("P-9_guarded_purge", S.with_(S.EVENTS) + """
SELECT * FROM efacts WHERE NOT (entity = '8' AND indicator_code = 'error' AND EXISTS (SELECT 1 FROM efacts
  WHERE entity = '8' AND indicator_code = 'error' AND day(date) <> 1))""")
def _(spark, d):
    return K.guarded_purge(A.event_facts(spark, d), "events", "error", "8")


@query("P-11_clamp", S.with_(raw_sql("paged")) + """
SELECT ordinal, coalesce(least(greatest(try_cast(CASE WHEN regexp_full_match(trim(value_raw), '[-+]?[0-9]+') THEN trim(value_raw) END AS BIGINT), 1), 50), 24) AS lim FROM raw""")
def _(spark, d):
    whole = F.when(F.trim("value_raw").rlike("^[-+]?[0-9]+$"), F.trim("value_raw"))
    return W.raw_rows(spark, d, "paged").select("ordinal", clamp(whole, 24, 50).alias("lim"))


@query("J-7_backfill_metadata", S.with_(S.FACTS, S.CATALOG) + """
, m AS (SELECT DISTINCT source, indicator_code FROM facts WHERE source = 'lines')
SELECT c.source, c.indicator_code, CASE WHEN m.source IS NOT NULL THEN 'shipping' ELSE concept END AS concept,
  CASE WHEN m.source IS NOT NULL THEN false ELSE is_primary END AS is_primary, unit FROM catalog c LEFT JOIN m USING (source, indicator_code)""")
def _(spark, d):
    meta = A.facts(spark, d).where("source = 'lines'").select("source", "indicator_code").distinct().select(
        "source", "indicator_code", F.lit("shipping").alias("concept"), F.lit(False).alias("is_primary"))
    return Qy.backfill_metadata(ref.catalog(spark), meta).select("source", "indicator_code", "concept", "is_primary", "unit")


@query("J-8_indicators_with_data", S.with_(S.FACTS, S.CATALOG) + """
SELECT source, indicator_code, indicator_name FROM catalog c WHERE EXISTS (SELECT 1 FROM facts f WHERE f.source = c.source AND f.indicator_code = c.indicator_code)""")
def _(spark, d):
    return lists.with_data(ref.catalog(spark), A.facts(spark, d))


@query("J-9_newest_of_copies", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, arg_max(o_orderkey, o_orderkey) AS id FROM orders GROUP BY 1, 2""")
def _(spark, d):
    rows = A.table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"))
    return K.dedupe_anomalies(rows, ["o_custkey", "date"]).select("o_custkey", "date", "id")


@query("J-10_anti_delete", S.with_(S.FACTS, S.PROFILES) + "SELECT * FROM facts WHERE entity NOT IN (SELECT entity FROM profiles WHERE region = 'ASIA')")
def _(spark, d):
    return K.purge_groupings(A.facts(spark, d), A.profiles(spark, d).where("region = 'ASIA'"))


# Landed payloads. The payload text is made from the orders; the readers parse it back.
PAGED_PAYLOAD = (
    "CASE WHEN id % 17 = 0 THEN '[{\"message\":[{\"id\":\"120\"}]}]' WHEN id % 19 = 0 THEN 'not json' ELSE "
    "'[{\"page\":1,\"pages\":' || CAST(id % 4 + 1 AS STRING) || ',\"total\":2},[{\"indicator\":{\"id\":\"R.CUR\",\"value\":\"Revenue\"},\"country\":"
    "{\"id\":\"' || " + W.ISO2 + " || '\",\"value\":\"x\"},\"countryiso3code\":\"' || " + W.ISO3 + " || '\",\"date\":\"' || y || 'M' || mm || '\",\"value\":' || v || '"
    ",\"unit\":\"\"},{\"indicator\":{\"id\":\"R.CUR\",\"value\":\"Revenue\"},\"country\":{\"id\":\"ZZ\"},\"countryiso3code\":\"\",\"date\":\"' || y || '\",\"value\":null}]]' END AS payload")


@query("S-1_paged_json", f"""WITH b AS ({W.BASE}) SELECT id AS page_key, id % 4 + 1 AS pages, 'Revenue' AS display_name, {W.ISO3} AS entity_raw, {W.ISO2} AS entity_alt,
  y || 'M' || mm AS period_raw, CAST(v AS DOUBLE) AS value FROM b WHERE id % 17 <> 0 AND id % 19 <> 0
UNION ALL SELECT id, id % 4 + 1, 'Revenue', '', 'ZZ', y, NULL FROM b WHERE id % 17 <> 0 AND id % 19 <> 0""")
def _(spark, d):
    payloads = W.base_rows(spark, d).selectExpr("id AS page_key", PAGED_PAYLOAD)
    return Y.parse_paged_json(payloads).select(
        "page_key", "pages", "display_name", "entity_raw", "entity_alt", "period_raw", F.col("value_raw").cast("double").alias("value"))


@query("S-5_monitor_json", f"""WITH b AS ({W.BASE}) SELECT id AS page_key, 'R.CUR' AS indicator_raw, 'US$' AS unit_raw FROM b, range(2) WHERE id % 17 <> 0 AND id % 19 <> 0""")
def _(spark, d):
    payloads = W.base_rows(spark, d).selectExpr("id AS page_key", PAGED_PAYLOAD)
    units = W.indicators(spark).select("indicator_code", F.col("unit").alias("default_unit"))
    return Y.with_default_units(Y.parse_paged_json(payloads), units).select("page_key", "indicator_raw", "unit_raw")


NESTED_PAYLOAD = (
    "'{\"values\":{\"R.CUR\":{\"' || " + W.ISO3 + " || '\":{\"' || y || '\":' || v || ',\"1990\":null},\"BAD\":3,\"WEOWORLD\":{\"2031\":1.5}}}}' AS payload")


@query("S-2_nested_map_json", f"""WITH b AS ({W.BASE}) SELECT id AS page_key, 'R.CUR' AS indicator_raw, {W.ISO3} AS entity_raw, y AS period_raw, CAST(v AS DOUBLE) AS value, 2000 AS cutoff FROM b
UNION ALL SELECT id, 'R.CUR', {W.ISO3}, '1990', NULL, 2000 FROM b UNION ALL SELECT id, 'R.CUR', 'WEOWORLD', '2031', 1.5, 2000 FROM b""")
def _(spark, d):
    payloads = W.base_rows(spark, d).selectExpr("id AS page_key", NESTED_PAYLOAD)
    rows = Y.parse_nested_map_json(payloads, 2000)
    return rows.select("page_key", "indicator_raw", "entity_raw", "period_raw", F.col("value_raw").cast("double").alias("value"), "cutoff")


# Landed files: one of each shape a nation, written to the shared folder and read back by the source.
NOTE = "CASE id % 3 WHEN 0 THEN '<' || CAST(id AS VARCHAR) || '>' ELSE 'Policy, rate' || chr(10) || 'item \"' || CAST(id AS VARCHAR) || '\"' END"
CSV_COLUMNS = ["REF_AREA", "TIME_PERIOD", "OBS_VALUE", "COMPILATION"]


def landed_csv(spark, d):
    """Notes first, so that a record may begin with a tag and the file not."""
    path = fresh_dir(spark, "sdmx")
    rows = W.base_rows(spark, d).selectExpr(
        f"{NOTE.replace('VARCHAR', 'STRING')} AS COMPILATION", f"{W.ISO2} AS REF_AREA", "y || '-' || mm AS TIME_PERIOD", "v AS OBS_VALUE")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


@query("S-3_sdmx_csv", f"""WITH b AS ({W.BASE}) SELECT {W.ISO2} AS "REF_AREA", y || '-' || mm AS "TIME_PERIOD", v AS "OBS_VALUE",
  {NOTE} AS "COMPILATION" FROM b""")
def _(spark, d):
    return Y.read_sdmx_csv(spark, landed_csv(spark, d), CSV_COLUMNS)


@query("S-8_csv_range", f"""WITH b AS ({W.BASE}) SELECT {W.ISO2} AS "REF_AREA", y || '-' || mm AS "TIME_PERIOD", v AS "OBS_VALUE" FROM b
WHERE d >= DATE '1996-04-01' AND d < DATE '1998-01-01'""")
def _(spark, d):
    return Y.read_sdmx_csv(spark, landed_csv(spark, d), ["REF_AREA", "TIME_PERIOD", "OBS_VALUE"], start="1996Q2", end="1997")


@query("S-8_csv_most_recent", f"""WITH b AS ({W.BASE}), r AS (SELECT {W.ISO2} AS a, y || '-' || mm AS p,
  row_number() OVER (PARTITION BY {W.ISO2} ORDER BY y || '-' || mm DESC) AS n FROM b) SELECT a AS "REF_AREA", p AS "TIME_PERIOD" FROM r WHERE n <= 4""")
def _(spark, d):
    return Y.read_sdmx_csv(spark, landed_csv(spark, d), ["REF_AREA", "TIME_PERIOD"], mrv=4, start="1992")


SERIES_PAYLOAD = "'{\"observations\":[{\"date\":\"' || CAST(d AS STRING) || '\",\"value\":\"' || v || '\"},{\"date\":\"1990-01-01\",\"value\":\".\"}]}' AS payload"


@query("S-4_series_observations", S.with_(KEYED_INDEX) + f"""
, b AS (SELECT * FROM ({W.BASE})), s AS (SELECT *, 'S' || CAST(k AS VARCHAR) || '-' || CAST(id % 9 AS VARCHAR) AS series_id FROM b),
o AS (SELECT series_id, CAST(d AS VARCHAR) AS period_raw, v AS value_raw FROM s UNION ALL SELECT series_id, '1990-01-01', '.' FROM s)
SELECT o.*, entity, series_indicator FROM o LEFT JOIN idx USING (series_id)""")
def _(spark, d):
    payloads = W.base_rows(spark, d).selectExpr("'S' || CAST(k AS STRING) || '-' || CAST(id % 9 AS STRING) AS series_id", SERIES_PAYLOAD)
    return Y.parse_series_observations(payloads, W.index(spark, d, "keyed"))


INDEX_PAYLOAD = (
    "'[{\"page\":1},[{\"id\":\"' || " + W.ISO3 + " || '\",\"iso2Code\":\"' || " + W.ISO2 + " || '\",\"name\":\" Customer ' || CAST(k AS STRING) || ' \",\"region\":{\"id\":\"R' || CAST(k % 5 AS STRING)"
    " || '\",\"value\":\"Region\"},\"incomeLevel\":{\"value\":\"' || CASE k % 3 WHEN 0 THEN 'Aggregates' ELSE 'High income' END || '\"}},{\"id\":\"WLD\",\"iso2Code\":\"1W\",\"name\":\"World\",\"region\":{\"id\":\"NA\",\"value\":\"Aggregates\"}}]]' AS payload")


@query("S-6_country_index", f"""SELECT DISTINCT {W.ISO3} AS entity, {W.ISO2} AS iso2, 'Customer ' || CAST(k AS VARCHAR) AS entity_name, 'Region' AS region,
  CASE k % 3 WHEN 0 THEN NULL ELSE 'High income' END AS income FROM (SELECT c_nationkey AS k FROM customer)""")
def _(spark, d):
    payloads = A.table(spark, d, "customer").selectExpr("c_nationkey AS k").selectExpr(INDEX_PAYLOAD)
    return Y.parse_country_index(payloads)


@query("S-7_reference_dims", S.with_(S.PROFILES) + "SELECT entity, entity_name, region FROM profiles UNION ALL "
       + " UNION ALL ".join(f"SELECT '{c}', '{n}', '{r}'" for c, n, r, _i, _m in ref.SEED_TERRITORIES))
def _(spark, d):
    dims = ref.reference_dims(spark, A.profiles(spark, d).select("entity", "entity_name", "region"))
    return dims["countries"].select("entity", "entity_name", "region")


@query("S-7_reference_rows", S.with_(S.PROFILES) + f""",
{S.values("seeds", ["code", "name", "category", "unit"], ref.SEED_INDICATORS)}, {S.values("hosts", ["source", "url", "active"], ref.SEED_SOURCES)}
SELECT 'indicator' AS dim, 'world_bank/' || code AS key, name || '|' || category || '|' || unit || '|annual' AS content FROM seeds
UNION ALL SELECT 'source', source, url || '|' || CAST(active AS VARCHAR) FROM hosts
UNION ALL SELECT 'country', entity, entity_name || '|' || region FROM profiles WHERE entity <> 'NAB'
UNION ALL SELECT 'country', 'TWN', 'Held already|HERE'
""" + "".join(f"UNION ALL SELECT 'country', '{c}', '{n}|{r}' " for c, n, r, _i, _m in ref.SEED_TERRITORIES if c != "TWN"))
def _(spark, d):
    """All three dimensions; a territory that the registry holds keeps what it says there."""
    held = A.profiles(spark, d).select("entity", "entity_name", "region").where("entity <> 'NAB'").unionByName(
        constant(spark, "entity string, entity_name string, region string", [("TWN", "Held already", "HERE")]))
    dims = ref.reference_dims(spark, held)
    row = lambda dim, key, *parts: (F.lit(dim).alias("dim"), key.alias("key"), F.concat_ws("|", *parts).alias("content"))
    return (
        dims["indicators"].select(*row("indicator", F.concat_ws("/", "source", "indicator_code"), "indicator_name", "category", "unit", "frequency"))
        .unionByName(dims["sources"].select(*row("source", F.col("source"), F.col("base_url"), F.col("is_active").cast("string"))))
        .unionByName(dims["countries"].select(*row("country", F.col("entity"), "entity_name", "region"))))


# One series a nation and spelling; several rows of a period count once.
SPELLING = ("CASE id % 5 WHEN 0 THEN y || 'M' || m WHEN 1 THEN y || 'Q' || q WHEN 2 THEN y WHEN 3 THEN y || '-' || mm ELSE CAST(d AS STRING) END")
CALENDAR = "CASE id % 5 WHEN 1 THEN 'quarter' WHEN 2 THEN 'year' WHEN 4 THEN 'day' ELSE 'month' END"
SPELT_ROWS = f"""WITH b AS ({W.BASE}), r AS (SELECT {W.ISO3} AS entity_raw, 'R' || CAST(id % 5 AS VARCHAR) AS indicator_raw, {SPELLING} AS period_raw,
  CAST(date_trunc({CALENDAR}, d) AS DATE) AS day, v AS value_raw FROM b),
s AS (SELECT entity_raw, indicator_raw, period_raw, day, max(value_raw) AS value_raw FROM r GROUP BY ALL)
"""


def spelt_rows(spark, d):
    rows = W.base_rows(spark, d).selectExpr(f"{W.ISO3} AS entity_raw", "'R' || CAST(id % 5 AS STRING) AS indicator_raw", f"{SPELLING} AS period_raw", "v AS value_raw")
    return rows.groupBy("entity_raw", "indicator_raw", "period_raw").agg(F.max("value_raw").alias("value_raw"))


@query("S-8_most_recent", SPELT_ROWS + """SELECT entity_raw, indicator_raw, period_raw, value_raw FROM s
QUALIFY row_number() OVER (PARTITION BY entity_raw, indicator_raw ORDER BY day DESC) <= 3""")
def _(spark, d):
    return Y.slice_rows(spelt_rows(spark, d), ["entity_raw", "indicator_raw"], mrv=3, start="1999")


@query("S-8_range", SPELT_ROWS + """SELECT entity_raw, indicator_raw, period_raw, value_raw FROM s WHERE day BETWEEN DATE '1999-04-01' AND DATE '2000-12-31'""")
def _(spark, d):
    return Y.slice_rows(spelt_rows(spark, d), ["entity_raw", "indicator_raw"], start="1999Q2", end="2000")


def landed_parts(spark, d, shape):
    """A file for each nation: every sixth blank, the next an error document, the next cut short, the others whole."""
    spelt = spelt_rows(spark, d).join(A.table(spark, d, "nation").selectExpr(f"{W.ISO3.replace('k', 'n_nationkey')} AS entity_raw", "n_nationkey AS k", "n_name AS context"), "entity_raw")
    by = ["k", "context"]
    if shape == "csv":
        line = F.concat_ws(",", "entity_raw", "indicator_raw", "period_raw", "value_raw", F.lit('"a, ""note"""'))
        body = F.concat(F.lit("AREA,INDICATOR,TIME_PERIOD,OBS_VALUE,NOTE\n"), F.concat_ws("\n", F.sort_array(F.collect_list(line))))
        cut = F.concat("whole", F.lit('\nZZZ,R9,2000,1,"cut'))
    elif shape == "paged":
        row = F.struct(F.col("entity_raw").alias("countryiso3code"), F.struct(F.col("indicator_raw").alias("id")).alias("indicator"),
                       F.col("period_raw").alias("date"), F.col("value_raw").alias("value"))
        body = F.concat(F.lit('[{"pages":1},'), F.to_json(F.collect_list(row)), F.lit("]"))
        cut = F.expr("left(whole, length(whole) - 1)")
    elif shape == "map":
        spelt = spelt.groupBy(*by, "indicator_raw", "entity_raw").agg(F.map_from_entries(F.collect_list(F.struct("period_raw", "value_raw"))).alias("m"))
        areas = F.map_from_arrays(F.array("entity_raw"), F.array("m"))
        body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("indicator_raw", areas.alias("a")))).alias("values")))
        cut = F.expr("left(whole, length(whole) - 1)")
    else:
        spelt = spelt.where("indicator_raw = 'R2'")
        body = F.to_json(F.struct(F.collect_list(F.struct(F.col("period_raw").alias("date"), F.col("value_raw").alias("value"))).alias("observations")))
        cut = F.expr("left(whole, length(whole) - 1)")
    path = fresh_dir(spark, f"landed-{shape}")
    whole = spelt.groupBy(*by).agg(body.alias("whole"))
    text = F.when(F.col("k") % 6 == 0, F.lit(" ")).when(F.col("k") % 6 == 1, F.lit("<html>busy")).when(F.col("k") % 6 == 2, cut).otherwise(F.col("whole"))
    whole.select("context", text.alias("value")).write.partitionBy("context").text(path)
    return path


CSV_ROLES = ("TIME_PERIOD", "OBS_VALUE", "INDICATOR", ["AREA", "INDICATOR"])
LANDED_CSV = ["AREA", "INDICATOR", "TIME_PERIOD", "OBS_VALUE"]


def landed(spark, d, shape, **slices):
    named = (LANDED_CSV, CSV_ROLES) if shape == "csv" else ()
    return Z.read_landed(spark, landed_parts(spark, d, shape), shape, *named, **slices)


@query("S-9_partial_fetch", """SELECT 'run-3' AS run_id, shape, CASE n_nationkey % 6 WHEN 0 THEN 'SourceError' ELSE 'PayloadError' END AS error_type,
  CASE WHEN n_nationkey % 6 = 0 THEN 'no answer' WHEN shape = 'csv' THEN 'ends inside a quoted field' ELSE 'not a JSON document' END AS message,
  '{"fetch_context":"' || n_name || '"}' AS raw_record
FROM nation, (VALUES ('paged'), ('map'), ('series'), ('csv')) AS t(shape)
WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey)
  AND (n_nationkey % 6 = 2 OR n_nationkey % 6 IN (0, 1) AND shape <> 'csv')
  AND (shape <> 'series' OR n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 5 = 2))""")
def _(spark, d):
    out = None
    for shape in ("paged", "map", "series", "csv"):
        failed = K.fetch_error_rows(K.require_some(Z.parts(landed(spark, d, shape))), "run-3").withColumn("shape", F.lit(shape))
        out = failed if out is None else out.unionByName(failed)
    return out


@query("S-9_states", S.with_("n AS (SELECT n_name AS context, n_nationkey AS k FROM nation)", SPELT_ROWS.replace("WITH ", "", 1)) + f"""
SELECT context, CASE k % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'error document' WHEN 2 THEN 'failed' ELSE 'ok' END AS state,
  CASE WHEN k % 6 IN (0, 1) THEN 0 ELSE count(*) END AS n_rows FROM n JOIN s ON entity_raw = {W.ISO3} GROUP BY context, k""")
def _(spark, d):
    return Z.parts(landed(spark, d, "csv")).select("context", "state", "n_rows")


SHAPES_SQL = SPELT_ROWS.rstrip() + f""",
n AS (SELECT n_nationkey % 6 AS p, {W.ISO3} AS entity_raw FROM (SELECT n_nationkey, n_nationkey AS k FROM nation)),
w AS (SELECT s.*, p FROM s JOIN n USING (entity_raw) WHERE p > 1)
"""


@query("S-8_shapes_most_recent", SHAPES_SQL + """, t AS (SELECT shape, w.*,
    row_number() OVER (PARTITION BY shape, entity_raw, indicator_raw ORDER BY day DESC) AS turn
  FROM w, (VALUES ('paged'), ('map'), ('csv')) AS t(shape) WHERE p > 2 OR shape = 'csv')
SELECT shape, entity_raw, indicator_raw, period_raw, value_raw FROM t WHERE turn <= 3""")
def _(spark, d):
    out = None
    for shape in ("paged", "map", "csv"):
        rows = Z.observations(landed(spark, d, shape, mrv=3, start="1999"))
        named = LANDED_CSV if shape == "csv" else ["entity_raw", "indicator_raw", "period_raw", "value_raw"]
        rows = rows.select(F.lit(shape).alias("shape"), *(F.col(c).alias(n) for c, n in zip(named, ["entity_raw", "indicator_raw", "period_raw", "value_raw"])))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("S-8_shapes_range", SHAPES_SQL + """SELECT shape, period_raw, value_raw FROM w, (VALUES ('paged'), ('map'), ('series'), ('csv')) AS t(shape)
WHERE indicator_raw = 'R2' AND day BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND (p > 2 OR shape = 'csv')""")
def _(spark, d):
    out = None
    for shape in ("paged", "map", "series", "csv"):
        only = {} if shape == "series" else {"indicators": ["R2"]}
        rows = Z.observations(landed(spark, d, shape, start="1994", end="1997M12", **only))
        period, value = ("TIME_PERIOD", "OBS_VALUE") if shape == "csv" else ("period_raw", "value_raw")
        rows = rows.select(F.lit(shape).alias("shape"), F.col(period).alias("period_raw"), F.col(value).alias("value_raw"))
        out = rows if out is None else out.unionByName(rows)
    return out
