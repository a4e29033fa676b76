"""Anomalies kept in a store that three arrivals of observations bring up to date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.operators import anomaly_store as N
from panelmark.operators import forecast as P
from panelmark.operators import latest as L
from panelmark.operators import query as Q
from panelmark.operators.latest import newest
from panelmark.operators.versioned import VersionedTable
from panelmark.plans import derived, forecasts, read  # noqa: F401  their SQL is registered first
from panelmark.plans.read import KEYS
from panelmark.plans.registry import oracle, query
from panelmark.session import fresh_dir
from panelmark.sources import adapters as A
from panelmark.sources import reference as ref

#: Rows of each arrival: the first lacks an economy and holds wrong values, the second mends and goes on, the third brings the rest.
ARRIVALS = (
    ("date < '1995-01-01' AND entity <> 'NAC'", "CASE WHEN month(date) = 6 THEN value * 1.5 + 1 ELSE value END"),
    ("date < '1997-01-01' AND (date >= '1995-01-01' AND entity <> 'NAC' OR month(date) = 6 AND entity <> 'NAC')", "value"),
    ("date >= '1997-01-01' OR entity = 'NAC'", "value"),
)


def arrived(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """(facts, path of the store) after three arrivals, each scored as it came."""
    facts, path, store = A.facts(spark, d), fresh_dir(spark, "arrived"), fresh_dir(spark, "anomalies")
    table, natural = VersionedTable(spark, path), [*KEYS, "date"]
    for batch, (which, value) in enumerate(ARRIVALS):
        rows = facts.where(which).withColumn("value", F.expr(value)).withColumn("batch_id", F.lit(batch).cast("long"))
        table.append(rows, batch)
        now = newest(table.read(), natural, [-F.col("batch_id")])
        N.refresh_store(spark, now, store, KEYS, dt.datetime(2001, 8, 1 + batch))
        N.refresh_store(spark, now, store, KEYS, dt.datetime(2001, 9, 1))  # nothing new: nothing happens
    return newest(table.read(), natural, [-F.col("batch_id")]).drop("batch_id"), store


@query("AN-8_arrivals", oracle("AN-7_detect"))
def _(spark, d):
    _facts, store = arrived(spark, d)
    return N.read_anomalies(spark, store, KEYS).select(*KEYS, "date", "value", "z_score", "deviation_type")


@query("W-2_map_stored", oracle("W-2_map"))
def _(spark, d):
    facts, store = arrived(spark, d)
    return L.map_points(facts, N.read_anomalies(spark, store, KEYS), A.profiles(spark, d))


@query("J-3_displayed_flag_stored", oracle("J-3_displayed_flag"))
def _(spark, d):
    facts, store = arrived(spark, d)
    rows = L.map_points(facts, N.read_anomalies(spark, store, KEYS), A.profiles(spark, d))
    return rows.select("entity", "indicator_code", "date", "value", "has_anomaly")


@query("J-4_described_stored", oracle("J-4_anomalies_described"))
def _(spark, d):
    _facts, store = arrived(spark, d)
    rows = N.read_anomalies(spark, store, KEYS).drop("explanation", "detected_at")
    return L.described_anomalies(rows, ref.catalog(spark), A.profiles(spark, d))


@query("U-2_chart_frame_stored", oracle("U-2_chart_frame"))
def _(spark, d):
    facts, store = arrived(spark, d)
    points = P.forecast_points(P.closed_form(forecasts.inputs(spark, d), "drift"), KEYS).select(*KEYS, "date", *forecasts.rounded())
    out = Q.chart_frame(facts, N.read_anomalies(spark, store, KEYS), points, KEYS)
    return out.select(*KEYS, "date", "label", "value", "median", "flagged", "z_score", "deviation_type")
