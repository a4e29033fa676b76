"""Streaming runs over landed files, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmark.operators import ingest as I
from panelmark.operators.versioned import VersionedTable
from panelmark.plans.derived import TRACES, traces
from panelmark.plans.intake import ACCEPTED, classify_sql, rules
from panelmark.plans.read import TODAY
from panelmark.plans.registry import query
from panelmark.session import fresh_dir
from panelmark.sources import adapters as A
from panelmark.sources import raw as W
from panelmark.streaming import jobs as J


def landed(spark, df, label, files=4):
    """Write ``df`` as landed files and open them as a stream."""
    path = fresh_dir(spark, label)
    df.repartition(files).write.parquet(path)
    return path, df.schema


@query("ST-1_ingest", classify_sql("keyed") + ACCEPTED)
def _(spark, d):
    raw, known, tables = W.raw_rows(spark, d, "keyed"), rules(spark, d, "keyed"), fresh_dir(spark, "tables")
    # earlier batches land other values of the same observations; the last one puts them right
    good = I.accepted(I.classify(raw, known, TODAY)).select("ordinal")
    path, schema = landed(spark, raw.join(good, "ordinal", "left_semi").select(*raw.columns).withColumn("value_raw", F.lit("1.00")), "landing")
    J.stream_ingest(J.landing_stream(spark, path, schema, max_files=2), tables, known, TODAY)
    raw.write.mode("append").parquet(path)
    J.stream_ingest(J.landing_stream(spark, path, schema), tables, known, TODAY)
    return J.read_facts(spark, tables).select("entity", "indicator_code", "date", "value")


@query("ST-2_first_wins", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, count(*) - 1 AS duplicates FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    path, schema = landed(spark, rows, "landing", files=3)
    tables = fresh_dir(spark, "tables")
    J.stream_first_wins(J.landing_stream(spark, path, schema, max_files=1), tables, ["o_custkey", "date"], "o_orderkey", month_of="date")
    return VersionedTable(spark, f"{tables}/duplicates").read().groupBy("o_custkey", "date").agg(F.count("*").alias("duplicates"))


@query("ST-3_running_latest", """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS indicator_code, CAST(ts AS DATE) AS date,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)
SELECT entity, indicator_code, max(date) AS date, arg_max(value, date) AS value FROM f GROUP BY 1, 2""")
def _(spark, d):
    path, schema = landed(spark, A.event_facts(spark, d), "landing")
    out = fresh_dir(spark, "latest")
    J.write_updates(J.stream_latest(J.landing_stream(spark, path, schema, max_files=2)), out, ["entity", "indicator_code"])
    return J.read_updates(spark, out, ["entity", "indicator_code"])


@query("ST-4_trace_windows", f"""WITH t AS (SELECT {TRACES} FROM events)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS requests, round_even(count(*) FILTER (cached) / count(*), 3) AS cache_hit_rate,
  round_even(count(*) FILTER (fallbacks > 0) / count(*), 3) AS fallback_rate, round_even(count(*) FILTER (ranked) / count(*), 3) AS ranking_rate,
  round_even(count(*) FILTER (outcome IN ('refused', 'retracted', 'absent')) / count(*), 3) AS refusal_rate, round_even(count(*) FILTER (timed_out) / count(*), 3) AS timeout_rate,
  round_even(CAST(sum(seconds) AS DOUBLE) / count(*), 2) AS mean_seconds FROM t GROUP BY 1""")
def _(spark, d):
    rows = traces(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path, schema = landed(spark, rows, "landing")
    out = fresh_dir(spark, "counters")
    J.stream_counters(J.landing_stream(spark, path, schema, max_files=1), out)
    return J.counter_rates(J.read_counters(spark, out))


@query("ST-5_sliding_budget", """WITH l AS (SELECT user_id % 20 AS client, date_trunc('second', ts) AS seen FROM events),
w AS (SELECT client, CAST(to_timestamp(floor(epoch(seen) / 10) * 10 - k * 10) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_start FROM l, range(6) r(k))
SELECT client, window_start, count(*) AS n, count(*) > 1 AS over_budget FROM w GROUP BY 1, 2""")
def _(spark, d):
    rows = A.table(spark, d, "events").select((F.col("user_id") % 20).alias("client"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    path, schema = landed(spark, rows, "landing")
    out = fresh_dir(spark, "budget")
    J.stream_budget(J.landing_stream(spark, path, schema, max_files=1), out)
    return J.read_budget(spark, out, per_minute=1)
