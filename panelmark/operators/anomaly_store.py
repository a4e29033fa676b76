"""Stored anomalies, brought up to date by what has arrived.

A score looks only back, so an observation that arrives, late or corrected, changes the scores of
its series from its own date on and no others. Facts carry the number of the batch that brought
them; the store remembers the last batch it has taken in. A refresh reads the series with
newer rows, scores them from the first date that arrived, and appends what became of each
anomaly there: found (again) or retracted. Changes are numbered by the version of the store they
were made on; merged by level, the newest of an observation stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.operators.anomaly import detect_anomalies, refresh_anomalies
from panelmark.operators.latest import newest
from panelmark.operators.versioned import VersionedTable


def _newest_change(rows: DataFrame, keys: list[str]) -> DataFrame:
    return newest(rows, [*keys, "date"], [-F.col("as_of")])


def read_anomalies(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The anomalies that hold now, None before the first refresh."""
    rows = VersionedTable(spark, path).read()
    return None if rows is None else _newest_change(rows, keys).where("change <> 'retracted'").drop("change", "as_of")


def refresh_store(spark: SparkSession, facts: DataFrame, path: str, keys: list[str], now, batch: str = "batch_id", **detector) -> int:
    """Take in the rows of ``facts`` (one an observation, the newest) whose ``batch`` is later than the store's;
    returns the batch the store is at. Without such rows nothing is scored or written."""
    table = VersionedTable(spark, path)
    mark = table.state()["batch"]
    arrived = facts if mark is None else facts.where(F.col(batch) > mark)
    last = arrived.agg(F.max(batch)).first()[0]
    if last is None:
        return mark
    begins = arrived.groupBy(*keys).agg(F.min("date").alias("_since"))
    found = detect_anomalies(facts.join(begins, keys), keys, since="_since", **detector)
    held = read_anomalies(spark, path, keys)
    if held is None:
        held = found.limit(0).withColumn("explanation", F.lit(None).cast("string")).withColumn("detected_at", F.lit(now).cast("timestamp"))
    tail = held.join(begins, keys).where(F.col("date") >= F.col("_since")).drop("_since")
    changes = refresh_anomalies(tail, found, keys, now).withColumn("as_of", F.lit(table.version()).cast("long"))
    table.append(changes.withColumn("detected_at", F.col("detected_at").cast("timestamp")), last, merge=lambda rows: _newest_change(rows, keys))
    return last


def explain(spark: SparkSession, path: str, explanations: DataFrame, keys: list[str]) -> None:
    """Keep explanations (keys, date, explanation) with the anomalies they are about; others are left out."""
    held = read_anomalies(spark, path, keys).drop("explanation").join(explanations.select(*keys, "date", "explanation"), [*keys, "date"])
    table = VersionedTable(spark, path)
    schema = [f.name for f in table.read().schema]
    rows = held.withColumn("change", F.lit("updated")).withColumn("as_of", F.lit(table.version()).cast("long"))
    table.append(rows.select(*schema), merge=lambda rows: _newest_change(rows, keys))
