"""Raw provider-like rows derived from orders, with defects placed by order key.

The expressions are plain SQL text, so the check SQL uses the very same words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.session import constant
from panelmark.sources.adapters import table

ISO2 = "chr(65 + CAST(floor(k / 26) AS INT)) || chr(65 + k % 26)"
ISO3 = "'N' || " + ISO2

BASE = ("SELECT o_orderkey AS id, c_nationkey AS k, CAST(o_orderdate AS DATE) AS d, "
        "CAST(CAST(floor(o_totalprice / 200) AS DECIMAL(18,2)) AS STRING) AS v, "
        "CAST(year(CAST(o_orderdate AS DATE)) AS STRING) AS y, CAST(month(CAST(o_orderdate AS DATE)) AS STRING) AS m, "
        "lpad(CAST(month(CAST(o_orderdate AS DATE)) AS STRING), 2, '0') AS mm, "
        "CAST(quarter(CAST(o_orderdate AS DATE)) AS STRING) AS q "
        "FROM orders JOIN customer ON o_custkey = c_custkey")

PERIOD = ("CASE WHEN id % 61 = 0 THEN NULL WHEN id % 53 = 0 THEN '1850' WHEN id % 59 = 0 THEN '2050-01' ELSE "
          "CASE id % 11 WHEN 0 THEN y || '-' || mm || '-15' WHEN 1 THEN y || 'Q' || q WHEN 2 THEN y || '-q' || q "
          "WHEN 3 THEN y || 'M' || mm WHEN 4 THEN y || '-m' || m WHEN 5 THEN y || '-' || m WHEN 6 THEN y "
          "WHEN 7 THEN 'garbage' WHEN 8 THEN y || 'M13' WHEN 9 THEN y || '-02-30' "
          "ELSE '  ' || y || '-' || mm || '-01 ' END END")

VALUE = ("CASE id % 29 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL WHEN 4 THEN 'abc' "
         "WHEN 5 THEN '1e13' WHEN 6 THEN '-5' WHEN 7 THEN 'Infinity' ELSE v END")

INDICATOR = ("CASE WHEN id % 41 = 5 THEN NULL WHEN id % 43 = 5 THEN '' ELSE CASE id % 7 WHEN 0 THEN 'R.CHG' "
             "WHEN 1 THEN 'R.SHARE' WHEN 2 THEN 'R.RATE' WHEN 3 THEN 'R.INDEX' WHEN 4 THEN 'R.CUR' "
             "WHEN 5 THEN 'R.COUNT' ELSE 'R.FREE' END END")

UNIT = "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'raw unit' END"
NAME = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Name ' || CAST(id % 10 AS STRING) || ',, ' END"

ENTITY = {
    "sdmx": (f"CASE id % 37 WHEN 0 THEN 'XM' WHEN 1 THEN 'zz' WHEN 2 THEN '' WHEN 3 THEN '??' "
             f"WHEN 4 THEN ' ' || lower({ISO2}) || ' ' WHEN 5 THEN NULL ELSE {ISO2} END", "CAST(NULL AS STRING)"),
    "paged": (f"CASE id % 37 WHEN 0 THEN 'WLD' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'X1' "
              f"WHEN 4 THEN ' ' || lower({ISO3}) || ' ' WHEN 5 THEN '' ELSE {ISO3} END",
              f"CASE id % 37 WHEN 1 THEN lower({ISO3}) WHEN 2 THEN NULL WHEN 3 THEN 'XD' WHEN 5 THEN '' ELSE {ISO2} END"),
    "nested": (f"CASE id % 37 WHEN 0 THEN 'WEOWORLD' WHEN 1 THEN 'AFR' ELSE {ISO3} END", "CAST(NULL AS STRING)"),
    "keyed": ("CASE id % 37 WHEN 0 THEN 'DGS10' WHEN 1 THEN NULL ELSE 'S' || CAST(k AS STRING) || '-' || CAST(id % 7 AS STRING) END",
              "CAST(NULL AS STRING)"),
}

INDICATORS = [
    ("R.CHG", "percent_change", "%", "monthly", "Change"), ("R.SHARE", "percent_share", "%", None, "Share"),
    ("R.RATE", "rate", "%", None, None), ("R.INDEX", "index", "index", None, None),
    ("R.CUR", "currency", "US$", None, None), ("R.COUNT", "count", None, None, "Count"),
    ("R.FREE", None, None, None, None),
]


def columns(shape: str) -> list[str]:
    entity, other = ENTITY[shape]
    return ["id AS ordinal", f"{entity} AS entity_raw", f"{other} AS entity_alt", f"{INDICATOR} AS indicator_raw",
            f"{PERIOD} AS period_raw", f"{VALUE} AS value_raw", f"{UNIT} AS unit_raw", f"{NAME} AS name_raw"]


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
        *[part.strip() for part in
          ["o_orderkey AS id", "c_nationkey AS k", "CAST(o_orderdate AS DATE) AS d",
           "CAST(CAST(floor(o_totalprice / 200) AS DECIMAL(18,2)) AS STRING) AS v",
           "CAST(year(CAST(o_orderdate AS DATE)) AS STRING) AS y", "CAST(month(CAST(o_orderdate AS DATE)) AS STRING) AS m",
           "lpad(CAST(month(CAST(o_orderdate AS DATE)) AS STRING), 2, '0') AS mm",
           "CAST(quarter(CAST(o_orderdate AS DATE)) AS STRING) AS q"]])


def raw_rows(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    return base_rows(spark, sf_dir).selectExpr(*columns(shape))


def indicators(spark: SparkSession) -> DataFrame:
    return constant(spark, "indicator_code string, kind string, unit string, frequency string, name string", INDICATORS)


def index(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))
    if shape == "keyed":
        kinds = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")
        code = ("CASE i WHEN 0 THEN 'R.CHG' WHEN 1 THEN 'R.SHARE' WHEN 2 THEN 'R.RATE' WHEN 3 THEN 'R.INDEX' "
                "WHEN 4 THEN 'R.CUR' WHEN 5 THEN 'R.COUNT' ELSE 'R.FREE' END AS series_indicator")
        return nations.select("k", kinds).selectExpr(
            "'S' || CAST(k AS STRING) || '-' || CAST(i AS STRING) AS series_id", f"{ISO3} AS entity", code)
    return nations.selectExpr(f"{ISO3} AS entity", f"{ISO2} AS iso2")
