"""Star-schema tables as observation panels (the facts every query reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISO2 = "concat(char(65 + {k} div 26), char(65 + {k} % 26))"
ENTITY = "concat('N', char(65 + {k} div 26), char(65 + {k} % 26))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(column: str):
    return F.trunc(F.col(column).cast("date"), "MM")


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and order count per nation and month, reduced before any dimension joins."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", month_of("o_orderdate").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("k", "date")
        .agg(F.sum("price").cast("double").alias("rev"), F.count("*").cast("double").alias("cnt"))
    )


def lines_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", month_of("l_shipdate").alias("date"),
        (F.col("l_discount") * 100).cast("decimal(18,2)").alias("disc"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy("k", "date")
        .agg(
            F.sum("disc").cast("double").alias("disc"), F.sum("qty").cast("double").alias("qty"),
            F.count("*").cast("double").alias("cnt"),
        )
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, indicator_code, entity, date, value: unique on all but the value."""
    orders = orders_monthly(spark, sf_dir).selectExpr(
        ENTITY.format(k="k") + " AS entity", "date",
        """stack(3, 'ORD.REV', rev, 'ORD.CNT', cnt, 'ORD.AOV',
             CASE WHEN (year(date) * 12 + month(date) + k) % 23 = 0 THEN NULL
                  ELSE rev / nullif(cnt, 0) END) AS (indicator_code, value)""",
    )
    lines = lines_monthly(spark, sf_dir).selectExpr(
        ENTITY.format(k="k") + " AS entity", "date",
        "stack(3, 'LIN.DISC', disc / nullif(cnt, 0), 'LIN.QTY', qty, 'ORD.CNT', cnt)"
        " AS (indicator_code, value)",
    )
    return (
        orders.select(F.lit("orders").alias("source"), "indicator_code", "entity", "date", "value")
        .unionAll(lines.select(F.lit("lines").alias("source"), "indicator_code", "entity", "date", "value"))
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals per user and event type: many short series."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(
            F.col("user_id").cast("string").alias("entity"),
            F.col("event_type").alias("indicator_code"),
            F.col("ts").cast("date").alias("date"),
        )
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
        .select(F.lit("events").alias("source"), "indicator_code", "entity", "date", "value")
    )


def profiles(spark: SparkSession, sf_dir: str, missing: str | None = None) -> DataFrame:
    """Country dimension; ``missing`` names an economy without a profile, as the real registry has some."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .selectExpr(
            ENTITY.format(k="n_nationkey") + " AS entity",
            ISO2.format(k="n_nationkey") + " AS iso2",
            "n_name AS entity_name", "r_name AS region", "n_nationkey",
        )
        .where(F.lit(True) if missing is None else F.col("entity") != missing)
    )
