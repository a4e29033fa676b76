"""Incremental runs of the batch operators over landing folders.

Every micro-batch is one write to a versioned table that takes a batch number once, so a
restarted stream counts nothing twice; what batches left is merged level by level, so that
reading costs what the table holds, not how often it was written to. The checkpoint lies
beside the tables, since batch numbers mean something only together with it.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.operators import ingest as I
from panelmark.operators import sinks as K
from panelmark.operators.latest import newest
from panelmark.operators.versioned import VersionedTable

NATURAL = ["entity", "indicator_code", "date"]


def _append(path: str, rows: DataFrame, batch_id: int, by: list[str] | None = None, merge=None) -> None:
    VersionedTable(rows.sparkSession, path).append(rows, batch_id, by, merge)


def _newest_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    return newest(rows, keys, [-F.col("batch_id")])


def landing_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_ingest(raw: DataFrame, tables: str, rules: I.Rules, today: dt.date) -> None:
    """Raw rows to facts, error and run ledgers, one classified batch at a time.

    Duplicates inside a batch are rejected; a later batch overwrites an earlier one when
    the facts are read (``read_facts``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = I.classify(batch, rules, today).persist()
        try:
            run_id = f"{rules.source}-{batch_id}"
            facts = I.accepted(rows).withColumn("batch_id", F.lit(batch_id).cast("long"))
            _append(f"{tables}/facts", facts, batch_id, merge=lambda old: _newest_batch(old, ["source", *NATURAL]))
            _append(f"{tables}/errors", K.error_rows(I.rejected(rows), run_id), batch_id)
            _append(f"{tables}/runs", I.run_summary(rows).withColumn("run_id", F.lit(run_id)), batch_id)
        finally:
            rows.unpersist()

    _run(raw.writeStream.foreachBatch(handle), f"{tables}/_checkpoint")


def read_facts(spark: SparkSession, tables: str) -> DataFrame:
    return _newest_batch(VersionedTable(spark, f"{tables}/facts").read(), ["source", *NATURAL])


def stream_first_wins(rows: DataFrame, tables: str, keys: list[str], order: str, month_of: str) -> None:
    """First copy of each key is kept, every other one is written out as a reject.

    Inside a batch the first is found by an aggregate and matched back on ``order``,
    which is unique, so a key with very many copies is not gathered. Kept keys are
    stored by the month of their column ``month_of``; a batch reads only the months it
    has rows of, not all keys ever kept.
    """
    spark = rows.sparkSession
    kept_path = f"{tables}/kept"
    month = F.coalesce(F.date_format(month_of, "yyyy-MM"), F.lit("none"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # keys of earlier batches; those of this one, if it was cut short after noting them, don't count
        earlier = VersionedTable(spark, kept_path).read()
        firsts = batch.groupBy(*keys).agg(F.min(order).alias(order))
        if earlier is not None:
            months = [r[0] for r in batch.select(month).distinct().collect()]  # as many as the calendar has
            earlier = earlier.where((F.col("batch_id") < batch_id) & F.col("month").isin(months)).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            firsts = firsts.join(earlier, same, "left_anti")
        marked = batch.join(firsts.select(order, F.lit(True).alias("_first")), order, "left").persist()
        try:
            rejects = marked.where(F.col("_first").isNull()).drop("_first").withColumn("error_type", F.lit(I.DUPLICATE))
            _append(f"{tables}/duplicates", rejects, batch_id)
            kept = marked.where("_first").select(*keys, F.lit(batch_id).cast("long").alias("batch_id"), month.alias("month"))
            _append(kept_path, kept, batch_id, by=["month"])
        finally:
            marked.unpersist()

    _run(rows.writeStream.foreachBatch(handle), f"{tables}/_checkpoint")


def stream_latest(rows: DataFrame) -> DataFrame:
    """Running latest reading per series; an older-dated arrival never replaces it.

    A streaming aggregate: partial results combine before the state is touched."""
    held = rows.where(F.col("value").isNotNull())
    best = held.groupBy("entity", "indicator_code").agg(F.max(F.struct("date", "value")).alias("_b"))
    return best.select("entity", "indicator_code", "_b.date", "_b.value")


def _stream_partials(rows: DataFrame, path: str, keys: list[str], summarise) -> None:
    """Partial counts of every batch under its id. They add up to the same totals however
    the rows are cut into batches and however late a row comes, so nothing is dropped."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _append(path, summarise(batch), batch_id, merge=lambda parts: _added_up(parts, keys))

    _run(rows.writeStream.foreachBatch(handle), f"{path}/_checkpoint")


def _added_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(parts.dtypes)
    return parts.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in parts.columns if c not in keys])


def _totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return _added_up(VersionedTable(spark, path).read(), keys)


def stream_counters(traces: DataFrame, path: str, at: str = "ts", width: str = "1 day") -> None:
    """Request counters per tumbling window; ``read_counters`` adds them up, ``counter_rates`` gives rates."""
    _stream_partials(traces, path, ["window_start"], lambda batch: batch.groupBy(F.window(at, width)).agg(
        F.count("*").alias("requests"), F.count_if("cached").alias("cache_hits"),
        F.count_if(F.col("fallbacks") > 0).alias("fallbacks"), F.count_if("ranked").alias("rankings"),
        F.count_if(F.col("outcome").isin("refused", "retracted", "absent")).alias("refusals"),
        F.count_if("timed_out").alias("timeouts"), F.sum("seconds").alias("seconds"),
    ).select(F.col("window.start").alias("window_start"), "requests", "cache_hits", "fallbacks", "rankings", "refusals",
             "timeouts", "seconds"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return _totals(spark, path, ["window_start"])


def counter_rates(counters: DataFrame) -> DataFrame:
    n = F.col("requests")
    rate = lambda c: F.rint(F.col(c) / n * 1000) / 1000
    return counters.select(
        "window_start", "requests", rate("cache_hits").alias("cache_hit_rate"), rate("fallbacks").alias("fallback_rate"),
        rate("rankings").alias("ranking_rate"), rate("refusals").alias("refusal_rate"), rate("timeouts").alias("timeout_rate"),
        (F.rint(F.col("seconds").cast("double") / n * 100) / 100).alias("mean_seconds"))


def stream_budget(log: DataFrame, path: str, client: str = "client", at: str = "at") -> None:
    """Requests per client over the trailing minute, in sliding windows of ten seconds."""
    _stream_partials(log, path, [client, "window_start"], lambda batch: batch.groupBy(client, F.window(at, "60 seconds", "10 seconds")).agg(
        F.count("*").alias("n")).select(client, F.col("window.start").alias("window_start"), "n"))


def read_budget(spark: SparkSession, path: str, per_minute: int, client: str = "client") -> DataFrame:
    return _totals(spark, path, [client, "window_start"]).withColumn("over_budget", F.col("n") > per_minute)


def write_updates(updates: DataFrame, path: str, keys: list[str]) -> None:
    """Changed rows of a streaming aggregate; merging keeps the newest update of every key."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        _append(path, rows, batch_id, merge=lambda old: _newest_batch(old, keys))

    _run(updates.writeStream.outputMode("update").foreachBatch(handle), f"{path}/_checkpoint")


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest update of every key."""
    return _newest_batch(VersionedTable(spark, path).read(), keys).drop("batch_id")
