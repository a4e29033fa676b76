"""Short lists around the observations: countries, sources, windows, pages of readings and messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.operators.latest import SERIES, history


def list_countries(profiles: DataFrame) -> DataFrame:
    """(entity, entity_name, region) by name."""
    return profiles.select("entity", "entity_name", "region").orderBy("entity_name")


def list_sources(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Each source with the number of observations held, 0 without any."""
    held = facts.groupBy("source").agg(F.count("*").alias("n"))
    return (sources.join(held, "source", "left")
            .select("source", "is_active", "last_run", F.coalesce("n", F.lit(0)).alias("observations")).orderBy("source"))


def in_window(rows: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The rows dated from ``first`` to ``last``, both included."""
    return rows.where(F.col("date").between(first, last))


def with_data(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """The indicators of ``catalog`` that have observations."""
    held = facts.select("source", "indicator_code")
    return catalog.join(held, ["source", "indicator_code"], "left_semi").select("source", "indicator_code", "indicator_name")


def chart_history(facts: DataFrame, anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """Every reading with the score and kind of its anomaly, and whether it has one."""
    hits = anomalies.select(*keys, "date", "z_score", "deviation_type", F.lit(True).alias("flagged"))
    return history(facts).join(hits, [*keys, "date"], "left").withColumn("flagged", F.col("flagged").isNotNull())


def newest_readings(facts: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The ``n`` newest readings of a series, and whether it has more (``truncated``). One more is read to tell."""
    keys = keys or SERIES
    newest_first = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    extra = facts.withColumn("n", F.row_number().over(newest_first)).where(F.col("n") <= n + 1)
    more = extra.groupBy(*keys).agg((F.max("n") > n).alias("truncated"))
    return extra.where(F.col("n") <= n).join(more, keys).select(*keys, "date", "value", "truncated")


def recent_messages(turns: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` last turns of each conversation that say anything, trimmed."""
    last_first = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = turns.withColumn("content", F.trim(F.coalesce("text", F.lit("")))).where("content <> ''")
    return rows.withColumn("n", F.row_number().over(last_first)).where(F.col("n") <= n).select("conv_id", "turn", "role", "content")


def distinct_messages(results: DataFrame) -> DataFrame:
    """Each answer's messages once, in the order they first came, as one text."""
    firsts = results.where("message IS NOT NULL").groupBy("answer_id", "message").agg(F.min("ordinal").alias("o"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "message"))), lambda s: s["message"])
    return firsts.groupBy("answer_id").agg(F.concat_ws(" ", lines).alias("detail"))
