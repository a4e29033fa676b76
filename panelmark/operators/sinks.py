"""Upserts, ledgers and partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.operators.latest import newest
from panelmark.operators.versioned import VersionedTable

NATURAL_KEY = ["source", "indicator_code", "entity", "date"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of both sides, the new one (the latest ``order_by`` of several) winning per key.

    One aggregate with map-side combine; no join and no ordered window, so a key with
    many copies reaches its reducer as one row per task.
    """
    rows = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    order = [F.col("_age")] + ([-F.col(order_by).cast("double")] if order_by else [])
    return newest(rows, keys, order).drop("_age")


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows by source and year, sorted so that a reader of one indicator skips row groups; rebalancing
    splits a large partition into files of the advised size and leaves a small one whole."""
    rows = rows.sparkSession.sql("SELECT /*+ REBALANCE(source, year) */ * FROM {rows}", rows=rows)
    return rows.sortWithinPartitions("source", "year", "indicator_code", "entity", "date")


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Facts in folders by source and year."""
    rows = _laid_out(df.withColumn("year", F.year("date")))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source", "year").parquet(path)


def upsert_observations(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Merge a batch into the versioned facts at ``path``: the partitions it touches are written once, as
    new versions beside the old ones, and readers see them all at once (``read_observations``)."""
    table = VersionedTable(spark, path)
    stored = table.read()
    batch = new.withColumn("year", F.year("date"))
    if stored is None:
        merged = newest(batch, NATURAL_KEY, [F.lit(0)])
    else:
        touched = batch.select(F.col("source").alias("_source"), F.col("year").alias("_year")).distinct()
        same = F.col("source").eqNullSafe(F.col("_source")) & F.col("year").eqNullSafe(F.col("_year"))
        merged = upsert(stored.join(touched, same, "left_semi"), batch, NATURAL_KEY).select(*stored.columns)
    table.replace_partitions(_laid_out(merged), ["source", "year"])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(spark, path).read()


def upsert_catalog(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """Register the codes of a batch (source, indicator_code, ordinal, unit, frequency, name).

    The first record of a code gives unit and frequency, where it has none the stored
    value stays; the name is always the batch's; metadata columns are left alone.
    """
    keys = ["source", "indicator_code"]
    found = batch.groupBy(*keys).agg(
        F.min(F.struct("ordinal", "unit", "frequency")).alias("_first"),
        F.max(F.when(F.coalesce("name", F.lit("")) != "", F.struct("ordinal", "name"))).alias("_named"),
    ).select(*keys, F.col("_first.unit").alias("_unit"), F.col("_first.frequency").alias("_freq"),
             F.coalesce("_named.name", "indicator_code").alias("_name"))
    merged = catalog.join(found, keys, "full")
    return merged.select(
        *keys, F.coalesce("_name", "indicator_name").alias("indicator_name"),
        F.coalesce("_unit", "unit").alias("unit"), F.coalesce("_freq", "frequency").alias("frequency"),
        *[c for c in catalog.columns if c not in (*keys, "indicator_name", "unit", "frequency")],
    )


def error_rows(rejects: DataFrame, run_id: str, raw: str = "raw") -> DataFrame:
    """Ledger form of rejects. Records become JSON, bare values ``{"value": ...}``, null stays null."""
    kind = dict(rejects.dtypes)[raw]
    if kind.startswith(("struct", "map")):
        text = F.to_json(raw)
    else:
        text = F.to_json(F.struct(F.col(raw).cast("string").alias("value")))
    return rejects.select(
        F.lit(run_id).alias("run_id"), F.when(F.col(raw).isNotNull(), text).alias("raw_record"), "error_type", "message")


def fetch_error_rows(files: DataFrame, run_id: str) -> DataFrame:
    """files(context, error[, kind]): one ledger row per part of a fetch that failed, with the kind of its failure."""
    kind = F.col("kind") if "kind" in files.columns else F.lit(None).cast("string")
    return files.where("error IS NOT NULL").select(
        F.lit(run_id).alias("run_id"), F.to_json(F.struct(F.col("context").alias("fetch_context"))).alias("raw_record"),
        F.coalesce(kind, F.lit("SourceError")).alias("error_type"), F.col("error").alias("message"))


def require_some(files: DataFrame) -> DataFrame:
    """files(context, error) unchanged; all of them failing ends the run."""
    counts = files.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if counts["n"] and counts["n"] == counts["bad"]:
        raise RuntimeError(f"all {counts['n']} parts of the fetch failed")
    return files


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def finish_run(summary: DataFrame, run_id: str, source: str, started, finished) -> DataFrame:
    return summary.select(
        F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.lit(started).alias("started_at"),
        F.lit(finished).alias("finished_at"), "fetched", "inserted", "failed", "skipped", "status")


def stamp_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources marked active with the end of their last successful or partial run."""
    done = runs.where(F.col("status").isin("success", "partial")).groupBy("source").agg(
        F.max("finished_at").alias("_at"))
    return sources.join(done, "source", "left").select(
        "source", "base_url", F.coalesce(F.col("_at").isNotNull() | F.col("is_active"), F.lit(False)).alias("is_active"),
        F.greatest("last_run", "_at").alias("last_run"))


def register_sources(sources: DataFrame, offered: DataFrame) -> DataFrame:
    """Insert unknown sources, update the address of known ones."""
    new = offered.select("source", F.col("base_url").alias("_url"))
    return sources.join(new, "source", "full").select(
        "source", F.coalesce("_url", "base_url").alias("base_url"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"), "last_run")


def purge_groupings(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose entity is not on the explicit list of groupings. Codes that merely
    lack a profile are kept."""
    return df.join(codes.select("entity"), "entity", "left_anti")


def purge_everywhere(facts: DataFrame, anomalies: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and anomalies without the listed groupings: an anomaly does not outlive the series it was found in."""
    return purge_groupings(facts, codes), purge_groupings(anomalies, codes)


def guarded_purge(facts: DataFrame, source: str, indicator_code: str, entity: str) -> DataFrame:
    """Without one series while it still holds rows off the first of a month; a clean
    series is left alone, so running it again changes nothing."""
    mine = (F.col("source") == source) & (F.col("indicator_code") == indicator_code) & (F.col("entity") == entity)
    dirty = facts.where(mine & (F.dayofmonth("date") != 1)).select("source", "indicator_code", "entity").distinct()
    return facts.join(dirty, ["source", "indicator_code", "entity"], "left_anti")


def dedupe_anomalies(anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per natural key, the latest detected (then the highest id)."""
    return newest(anomalies, keys, [-F.unix_micros("detected_at"), -F.col("id")])
