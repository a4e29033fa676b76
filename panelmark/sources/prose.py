"""Answers and their evidence, written from each customer's orders.

Plain SQL text, shared with the check SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.sources.adapters import table

# Aggregated columns: id, n orders, x highest and p lowest price, c their difference, d last date.
BASE = ("SELECT o_custkey AS id, count(*) AS n, max(CAST(o_totalprice AS DECIMAL(18,2))) AS x, min(CAST(o_totalprice AS DECIMAL(18,2))) AS p, "
        "max(CAST(o_totalprice AS DECIMAL(18,2))) - min(CAST(o_totalprice AS DECIMAL(18,2))) AS c, max(CAST(o_orderdate AS DATE)) AS d "
        "FROM orders GROUP BY o_custkey")

_X, _P, _C, _D = ("CAST(x AS STRING)", "CAST(p AS STRING)", "CAST(c AS STRING)", "CAST(d AS STRING)")
_Y = "CAST(year(d) AS STRING)"
UNIT = "CASE WHEN id % 3 = 0 THEN '%' ELSE 'US$' END"
KIND = "CASE id % 5 WHEN 0 THEN 'spike' WHEN 1 THEN 'drop' WHEN 2 THEN 'spike' WHEN 3 THEN 'structural_break' ELSE 'drop' END"
NOTE = "CASE WHEN id % 4 = 0 THEN 'Fares per mile fell from 18211.0% in 1989-03-01 to 64.5% later, a fall of 18146.5 points.' ELSE 'Measured \"as is\" in 12 steps.' END"
PAYLOAD = (  # up to twelve objects around what a tool gave
    "repeat('{\"within\":', CAST(id % 13 AS INT)) || '{\"tool_results\":[{\"tool\":\"query\",\"ok\":true,\"payload\":{\"entity\":\"C1\",\"unit\":\"' || " + UNIT + " || '\",\"latest\":{\"date\":\"' || " + _D
    + " || '\",\"value\":' || " + _X + " || '},\"changes\":{\"change over 5 periods\":\"+' || " + _C + " || '\"},\"anomalies\":[{\"date\":\"' || " + _D
    + " || '\",\"value\":' || " + _X + " || ',\"deviation_type\":\"' || " + KIND + " || '\",\"previous_value\":' || " + _P
    + " || '}],\"extremes\":{\"min_value\":' || " + _P + " || ',\"max_value\":' || " + _X + " || '},\"observation_count\":' || CAST(n AS STRING)"
    " || '}},{\"tool\":\"note\",\"ok\":false,\"payload\":{\"note\":\"' || replace(" + NOTE + ", '\"', '\\\\\"') || '\"}}]}' || repeat('}', CAST(id % 13 AS INT))")

TEMPLATES = [
    f"'The value reached ' || {_X} || ' in ' || {_Y} || '.'",
    f"'It rose to ' || {_X} || ' from ' || {_P} || '.'",
    f"'It fell to ' || {_X} || '. A change of ' || {_C} || ' followed.'",
    f"'It was ' || {_X} || ', before that ' || {_P} || '. Both make ' || CAST(x + p AS STRING) || ' together.'",
    f"'An invented 987654.3 appears in 2031, beside ' || {_X} || '.'",
    f"{_X} || ' is roughly double the ' || {_P} || ' seen before.'",
    f"'A drop of ' || {_X} || ' was seen.' || chr(10) || 'A rise of ' || {_C} || ' too.'",
    f"'In the second half of ' || {_Y} || ' it was ' || {_X} || '!'",
    "'It climbed to 64.5 in 1989. It dropped to 64.5% later.'",
    "'The peak of 18,211% was extraordinary. The 1990s ended.'",
    "'A high of 18,211% was seen in 12 steps.'",
    "'From 18211% it fell to 64.5%.'",
    f"'It is ' || CAST(CAST(floor(x / 1000) AS BIGINT) AS STRING) || ' thousand, or ' || CAST(CAST(round(x) AS BIGINT) AS STRING) || '.'",
    f"'Only half of that, ' || {_P} || '.'",
    f"'No country in the world has a higher figure than ' || {_X} || ' [1] [7].'",
    f"'# Head' || chr(10) || '- **Bold** and `code` at ' || {_X} || ' \\\\[2\\\\]' || chr(10) || '-5 and 3.5.6, Q1 of 2025Q2.'",
]
TEXT = "CASE id % 16 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES)) + " END"


def duck(text: str) -> str:
    """The same words for an engine without backslash escapes in literals."""
    return text.replace("\\\\", "\\")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("n"), F.max(price).alias("x"), F.min(price).alias("p"), (F.max(price) - F.min(price)).alias("c"),
        F.max(F.col("o_orderdate").cast("date")).alias("d"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).selectExpr("id AS answer_id", f"{TEXT} AS text")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).selectExpr("id AS answer_id", f"{PAYLOAD} AS payload")
