"""Forecast queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelmark.operators import forecast as P
from panelmark.operators import models as M
from panelmark.operators import query as Q
from panelmark.operators.anomaly import detect_anomalies
from panelmark.plans import sql as S
from panelmark.plans.read import FMT, KEYS
from panelmark.plans.registry import query
from panelmark.session import constant
from panelmark.sources import adapters as A
from panelmark.sources import reference as ref

KEY_SQL = "source, indicator_code, entity"


def with_frequency(spark, d):
    freq = ref.catalog(spark).select("source", "indicator_code", "frequency")
    return A.facts(spark, d).join(freq, ["source", "indicator_code"])


def events_with_frequency(spark, d):
    return A.event_facts(spark, d).withColumn("frequency", F.lit("daily"))


def inputs(spark, d, **kw):
    return P.series_inputs(with_frequency(spark, d), KEYS, **kw)


INPUTS = """
h AS (SELECT source, indicator_code, entity, date, value, row_number() OVER (PARTITION BY source, indicator_code, entity ORDER BY date DESC) AS back,
  row_number() OVER (PARTITION BY source, indicator_code, entity ORDER BY date) AS i,
  count(*) OVER (PARTITION BY source, indicator_code, entity) AS n FROM facts WHERE value IS NOT NULL),
inp AS (SELECT source, indicator_code, entity, count(*) AS observations, max(date) AS last_date, arg_max(value, date) AS last, arg_min(value, date) AS first,
  stddev_pop(value) AS sd, max(value) AS hi, min(value) AS lo, 12 AS horizon FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 16)"""
BASE = S.with_(S.FACTS, INPUTS)
DRIFT = """
drift AS (SELECT source, indicator_code, entity, last_date, s AS step, last + s * ((last - first) / (observations - 1)) AS median, sd FROM inp, range(1, 13) r(s))"""
NAIVE = """
naive AS (SELECT p.source, p.indicator_code, p.entity, p.last_date, s AS step, h.value AS median, p.sd FROM inp p, range(1, 13) r(s)
  JOIN h ON h.source = p.source AND h.indicator_code = p.indicator_code AND h.entity = p.entity AND h.back = CASE WHEN p.observations >= 24 THEN 12 - (s - 1) % 12 ELSE 1 END)"""


def rounded():
    return [F.round(c, 3).alias(c) for c in ("median", "lower", "upper")]


@query("F-1_eligible", BASE + "SELECT source, indicator_code, entity, observations, last_date FROM inp")
def _(spark, d):
    return inputs(spark, d).select(*KEYS, "observations", "last_date")


@query("F-1_eligible_events", S.with_(S.EVENTS) + """
SELECT source, indicator_code, entity, count(*) AS observations, 5 AS horizon FROM efacts GROUP BY 1, 2, 3 HAVING count(*) >= 16""")
def _(spark, d):
    return P.series_inputs(events_with_frequency(spark, d), KEYS).select(*KEYS, "observations", "horizon")


FREQ = "CASE substr(entity, 3, 1) WHEN 'A' THEN 'monthly' WHEN 'B' THEN 'Quarterly' WHEN 'C' THEN 'annual' WHEN 'D' THEN 'daily' END"


@query("F-2_horizons", BASE + f"""SELECT source, indicator_code, entity, CASE lower({FREQ}) WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 8 ELSE 5 END AS horizon,
  CASE lower({FREQ}) WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 ELSE 1 END AS season FROM inp""")
def _(spark, d):
    rows = A.facts(spark, d).withColumn("frequency", F.expr(FREQ))
    return P.series_inputs(rows, KEYS).select(*KEYS, "horizon", "season")


@query("F-3_context", BASE + "SELECT source, indicator_code, entity, least(n, 30) AS kept, round(sum(value), 3) AS total FROM h WHERE back <= 30 AND n >= 16 GROUP BY ALL")
def _(spark, d):
    return inputs(spark, d, max_context=30).select(
        *KEYS, F.size("history").alias("kept"), F.round(F.aggregate("history", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


def _broken(history, horizon, season):
    raise RuntimeError("unreachable")


def _blow_up(history, horizon, season):
    return [1e30] * horizon, [0.0] * horizon, [1e31] * horizon


def _flat(history, horizon, season):
    return [history[-1]] * horizon, [min(history)] * horizon, [max(history)] * horizon


@query("F-4_cascade", BASE + """SELECT source, indicator_code, entity, 'flat' AS model, last AS first_median, lo AS lower, hi AS upper,
  'broken: RuntimeError: unreachable;blow_up: drifts too far' AS attempts FROM inp""")
def _(spark, d):
    out = P.forecast(inputs(spark, d), [("broken", _broken), ("blow_up", _blow_up), ("flat", _flat)])
    return out.select(*KEYS, "model", F.get("median", F.lit(0)).alias("first_median"), F.get("lower", F.lit(0)).alias("lower"),
                      F.get("upper", F.lit(0)).alias("upper"), F.concat_ws(";", "attempts").alias("attempts"))


@query("F-4_closed_cascade", S.with_(S.FACTS, INPUTS, DRIFT) + """
, g AS (SELECT source, indicator_code, entity, max(abs(median - last)) > 20 * greatest(any_value(hi) - any_value(lo), abs(any_value(last)), 1) AS bad FROM drift JOIN inp USING (source, indicator_code, entity) GROUP BY 1, 2, 3)
SELECT source, indicator_code, entity, CASE WHEN bad THEN 'seasonal_naive' ELSE 'drift' END AS model, CASE WHEN bad THEN 1 ELSE 0 END AS attempts FROM g""")
def _(spark, d):
    return P.forecast_closed(inputs(spark, d), ["drift", "seasonal_naive"]).select(*KEYS, "model", F.size("attempts").alias("attempts"))


def _weights(name: str, column: str, values: tuple) -> str:
    return f"(VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in enumerate(values))}) AS {name}({name}_i, {column})"


# Every weight of every form runs along its series; states are the elements of the reduced list.
_ERROR = "(x.y - (acc.l + acc.s + acc.p[x.t % m + 1]))"
SMOOTHING = f"""
hist AS (SELECT {KEY_SQL}, list(value ORDER BY date) AS y, count(*) AS n, max(date) AS last_date FROM facts WHERE value IS NOT NULL GROUP BY {KEY_SQL} HAVING count(*) >= 16),
forms AS (SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 12, 0), (3, 12, 1)) AS f(form, m, trend)),
grid AS (SELECT form, m, trend, row_number() OVER (PARTITION BY form ORDER BY wa_i, wb_i, wg_i) AS idx, a, b, g * (1 - a) AS g
  FROM forms, {_weights('wa', 'a', M.ALPHAS)}, {_weights('wb', 'b', (*M.BETAS, 0.0))}, {_weights('wg', 'g', (*M.GAMMAS, 0.0))}
  WHERE (trend = 1) = (b > 0) AND (m > 1) = (g > 0)),
begun AS (SELECT h.*, form, m, trend, CASE WHEN m > 1 THEN list_sum(y[1:m]) / m ELSE y[1] END AS l0,
    CASE WHEN trend = 0 THEN 0.0 WHEN m > 1 THEN (list_sum(y[m + 1:2 * m]) / m - list_sum(y[1:m]) / m) / m ELSE y[2] - y[1] END AS s0
  FROM hist h, forms WHERE m = 1 OR n >= 2 * m),
fits AS (SELECT {KEY_SQL}, y, n, last_date, form, m, trend, idx, a, b, g, list_reduce(list_prepend(
    {{'l': l0, 's': s0, 'p': CASE WHEN m > 1 THEN list_transform(y[1:m], lambda v: v - l0) ELSE [0.0::DOUBLE] END, 'e': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 't': -1::BIGINT}},
    list_transform(y, lambda v, i: {{'l': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'p': [0.0::DOUBLE], 'e': 0.0::DOUBLE, 'y': v, 't': i - 1}})),
    lambda acc, x: {{'l': acc.l + acc.s + a * {_ERROR}, 's': acc.s + a * b * {_ERROR},
      'p': list_transform(acc.p, lambda q, j: CASE WHEN j = x.t % m + 1 THEN q + g * {_ERROR} ELSE q END),
      'e': acc.e + {_ERROR} * {_ERROR}, 'y': x.y, 't': x.t}}) AS st
  FROM begun JOIN grid USING (form, m, trend)),
best AS (SELECT *, 2 + 2 * trend + CASE WHEN m > 1 THEN m + 1 ELSE 0 END AS k FROM fits QUALIFY row_number() OVER (PARTITION BY {KEY_SQL}, form ORDER BY st.e, idx) = 1),
won AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY {KEY_SQL}
  ORDER BY n * ln(greatest(st.e / n, 1e-300)) + CASE WHEN n - k - 1 > 0 THEN 2 * k + 2 * k * (k + 1) / (n - k - 1) ELSE 'infinity'::DOUBLE END, form) = 1),
steps AS (SELECT *, st.l + st.s * step + st.p[(n + step - 1) % m + 1] AS median, step - 1 AS h, CASE WHEN m > 1 THEN (step - 1) // m ELSE 0 END AS c
  FROM won, range(1, 13) AS r(step)),
bands AS (SELECT *, 1.2816 * sqrt(st.e / greatest(n - k, 1) * (1 + h * (a * a + a * a * b * (h + 1) + (a * b) * (a * b) * (h + 1) * (2 * h + 1) / 6)
  + g * c * (2 * a + g + a * b * m * (c + 1)))) AS wide FROM steps),
answers AS (SELECT *, CASE WHEN max(wide) OVER (PARTITION BY {KEY_SQL}) = 0 THEN 1.2816 * list_stddev_pop(y) ELSE wide END AS band,
  max(abs(median - y[-1])) OVER (PARTITION BY {KEY_SQL}) > 20 * greatest(list_max(y) - list_min(y), abs(y[-1]), 1) AS bad FROM bands)
"""


@query("F-5_smoothing", S.with_(S.FACTS, SMOOTHING) + f"""
SELECT {KEY_SQL}, 'smoothing' AS model, CAST(step AS INT) AS step, CAST(date_trunc('month', last_date) + to_months(CAST(step AS INT)) AS DATE) AS date,
  round(median, 3) AS median, round(median - band, 3) AS lower, round(median + band, 3) AS upper FROM answers WHERE NOT bad""")
def _(spark, d):
    out = P.forecast_points(P.forecast(inputs(spark, d)), KEYS)
    return out.select(*KEYS, "model", "step", "date", *rounded())


@query("F-5_seasonal_baseline", S.with_(S.FACTS, INPUTS, NAIVE) + """
SELECT source, indicator_code, entity, step, round(median, 3) AS median, round(median - 1.2816 * sd, 3) AS lower, round(median + 1.2816 * sd, 3) AS upper FROM naive""")
def _(spark, d):
    out = P.forecast_points(P.closed_form(inputs(spark, d), "seasonal_naive"), KEYS)
    return out.select(*KEYS, "step", *rounded())


@query("F-6_guard", S.with_(S.FACTS, INPUTS) + """
, m AS (SELECT *, last + (hi - lo + abs(last) + 1) * CASE ascii(substr(entity, 3, 1)) % 3 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 0 END AS mid FROM inp)
SELECT source, indicator_code, entity, CASE WHEN abs(mid - last) > 20 * greatest(hi - lo, abs(last), 1) THEN 'drifts too far' END AS rejected FROM m""")
def _(spark, d):
    rows = inputs(spark, d)
    last = F.element_at("history", -1)
    room = F.array_max("history") - F.array_min("history") + F.abs(last) + 1
    by = F.ascii(F.substr("entity", F.lit(3), F.lit(1))) % 3
    mid = last + room * F.when(by == 0, 1).when(by == 1, 50).otherwise(0)
    rows = rows.withColumn("median", F.array(mid)).withColumn("lower", F.array(mid)).withColumn("upper", F.array(mid))
    return P.guard(rows).select(*KEYS, "rejected")


PAYLOAD = """CASE ascii(substr(entity, 3, 1)) % 4 WHEN 0 THEN '{"model":"remote","median":[' || CAST(observations AS STRING) || ',2],"lower":[0,1],"upper":[3,"4"]}'
 WHEN 1 THEN '{"median":[1,2],"lower":[0],"upper":[3,4]}' WHEN 2 THEN '{"median":["x",2],"lower":[0,1],"upper":[3,4]}' ELSE 'oops' END"""


@query("F-7_answer_shape", BASE + """SELECT source, indicator_code, entity, CASE ascii(substr(entity, 3, 1)) % 4 WHEN 0 THEN 'remote' ELSE 'expected' END AS model,
  CASE ascii(substr(entity, 3, 1)) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ragged' ELSE 'malformed' END AS rejected,
  CASE ascii(substr(entity, 3, 1)) % 4 WHEN 0 THEN CAST(observations AS DOUBLE) END AS first FROM inp""")
def _(spark, d):
    rows = inputs(spark, d).select(*KEYS, F.expr(PAYLOAD).alias("payload"))
    out = P.parse_answers(rows, "expected")
    return out.select(*KEYS, "model", "rejected", F.when(F.col("rejected").isNull(), F.get("median", F.lit(0))).alias("first"))


@query("F-8_band_clamp", S.with_(S.FACTS) + """
SELECT source, indicator_code, entity, date, least(value * 1.1::DOUBLE, value) AS lower, greatest(value * 0.9::DOUBLE, value) AS upper FROM facts WHERE value IS NOT NULL""")
def _(spark, d):
    rows = A.facts(spark, d).where("value IS NOT NULL").select(
        *KEYS, "date", F.col("value").alias("median"), (F.col("value") * 1.1).alias("lower"), (F.col("value") * 0.9).alias("upper"))
    return P.clamp_bands(rows).drop("median")


POINTS = """SELECT source, indicator_code, entity, 'drift' AS model, step, CAST(date_trunc('month', last_date + to_months(CAST(step AS INT))) AS DATE) AS date,
  round(median, 3) AS median, round(median - 1.2816 * sd, 3) AS lower, round(median + 1.2816 * sd, 3) AS upper FROM drift"""


@query("F-9_points", S.with_(S.FACTS, INPUTS, DRIFT) + POINTS)
def _(spark, d):
    out = P.forecast_points(P.closed_form(inputs(spark, d), "drift"), KEYS)
    return out.select(*KEYS, "model", "step", "date", *rounded())


KEY = """'forecast:' || entity || ':' || indicator_code || ':' || left(sha256('task=forecast|rev=6|cascade=drift,seasonal_naive|country=' || entity || '|horizon=12|indicator=' || indicator_code
  || '|last_date=' || CAST(last_date AS VARCHAR) || '|observations=' || CAST(observations AS VARCHAR) || '|source=' || source), 16)"""


@query("F-10_keys", BASE + f"SELECT source, indicator_code, entity, {KEY} AS cache_key FROM inp")
def _(spark, d):
    return inputs(spark, d).select(*KEYS, P.series_key(["drift", "seasonal_naive"]).alias("cache_key"))


CUT = "(entity > 'NAD' OR date >= DATE '2001-01-01')"


@query("F-11_refresh", S.with_(S.FACTS, INPUTS.replace("FROM facts WHERE value IS NOT NULL)", f"FROM facts WHERE value IS NOT NULL AND {CUT})")) + f"""
, short AS (SELECT source, indicator_code, entity FROM facts WHERE {CUT} GROUP BY ALL HAVING count(value) < 16)
SELECT count(*) + (SELECT count(*) FROM short) AS series_considered, count(*) FILTER (entity > 'NAJ' OR entity < 'NAG') AS computed,
  count(*) FILTER (entity BETWEEN 'NAG' AND 'NAJ') AS already_cached, (SELECT count(*) FROM short) AS skipped, 0 AS failed FROM inp""")
def _(spark, d):
    models = ["drift", "seasonal_naive"]
    facts = with_frequency(spark, d).where(CUT)
    rows = P.series_inputs(facts, KEYS)
    at = F.lit(dt.datetime(2001, 9, 1)).cast("timestamp")
    held = rows.where("entity <= 'NAJ'").withColumn("cache_key", P.series_key(models)).select(
        "cache_key", F.when(F.col("entity") < "NAG", F.lit(dt.datetime(2001, 8, 1)).cast("timestamp")).alias("expires_at"))
    _fresh, outcomes = P.refresh_forecasts(rows, held, at, models, short=P.short_series(facts, KEYS))
    return P.refresh_summary(outcomes)


@query("F-12_context_forecast", S.with_(S.FACTS, INPUTS, DRIFT) + f"""
SELECT source, indicator_code, entity, count(*) AS points, {FMT.format(x='max(median) FILTER (step = 12)')} AS last_median FROM drift GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = inputs(spark, d)
    points = P.forecast_points(P.closed_form(rows, "drift"), KEYS)
    out = Q.with_forecast(rows.select(*KEYS), points, KEYS)
    return out.select(*KEYS, F.size("forecast").alias("points"), F.element_at("forecast", -1)["median"].alias("last_median"))


@query("F-12_points", S.with_(S.FACTS, INPUTS, DRIFT) + f"""
SELECT source, indicator_code, entity, step - 1 AS position, CAST(step AS INT) AS step, CAST(date_trunc('month', last_date) + to_months(CAST(step AS INT)) AS DATE) AS date,
  {FMT.format(x='median')} AS median, {FMT.format(x='(median - 1.2816 * sd)')} AS lower, {FMT.format(x='(median + 1.2816 * sd)')} AS upper FROM drift""")
def _(spark, d):
    rows = inputs(spark, d)
    out = Q.with_forecast(rows.select(*KEYS), P.forecast_points(P.closed_form(rows, "drift"), KEYS), KEYS)
    return out.select(*KEYS, F.posexplode("forecast").alias("position", "p")).select(*KEYS, "position", "p.*")


@query("U-2_chart_frame", S.with_(S.FACTS, INPUTS, DRIFT, S.anomalies(), f"pts AS ({POINTS})") + """
SELECT f.source, f.indicator_code, f.entity, f.date, strftime(f.date, '%Y-%m') AS label, f.value,
  CASE WHEN f.date = p.last_date THEN f.value END AS median, a.date IS NOT NULL AS flagged, a.z_score, a.deviation_type
FROM facts f LEFT JOIN inp p USING (source, indicator_code, entity) LEFT JOIN anomalies a USING (source, indicator_code, entity, date) WHERE f.value IS NOT NULL
UNION ALL SELECT source, indicator_code, entity, date, strftime(date, '%Y-%m'), NULL, median, false, NULL, NULL FROM pts""")
def _(spark, d):
    f = A.facts(spark, d)
    points = P.forecast_points(P.closed_form(inputs(spark, d), "drift"), KEYS).select(*KEYS, "date", *rounded())
    out = Q.chart_frame(f, detect_anomalies(f, KEYS), points, KEYS)
    return out.select(*KEYS, "date", "label", "value", "median", "flagged", "z_score", "deviation_type")
