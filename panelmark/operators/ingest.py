"""One raw batch into accepted, rejected and skipped rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.functions.codes import code_or_fallback, is_missing, to_iso3
from panelmark.functions.periods import parse_period
from panelmark.session import settled, staged
from panelmark.sources.reference import GROUPING_ISO2, bounds

NORMALIZATION, VALIDATION, DUPLICATE = "NormalizationError", "ValidationError", "DuplicateRecord"


@dataclass(frozen=True)
class Rules:
    """What a source means by its rows.

    shape: ``paged`` (three-letter codes, index of real countries), ``nested`` (the same
    with a projection cutoff), ``sdmx`` (two-letter codes) or ``keyed`` (series registry).
    index: entity, iso2. indicators: indicator_code, kind, unit, frequency, name.
    """

    shape: str
    source: str
    index: DataFrame
    indicators: DataFrame
    cutoff_year: int | None = None


@dataclass(frozen=True)
class Check:
    """A condition and what a row that meets it becomes; ``subject`` is quoted in the message."""

    bad: Column
    error: str | None = None
    text: str | None = None
    subject: str | None = None


def _skip(bad: Column) -> Check:
    return Check(bad)


def _first_failing(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """Adds ``outcome`` from the first check a row meets, else accepted.

    The position of the check is found first and everything else is looked up by it:
    small generated code, where a chain of conditional structs outgrows the compiler.
    """
    hits = F.array(*[F.coalesce(c.bad, F.lit(False)) for c in checks])
    rows = settled(rows.withColumn("_at", F.array_position(hits, F.lit(True)).cast("int")), "_at")
    subjects = sorted({c.subject for c in checks if c.subject})
    look = lambda words: F.get(F.array(*[F.lit(w).cast("string") for w in words]), F.col("_at"))
    where = F.get(F.array(*[F.lit(subjects.index(c.subject) if c.subject else -1) for c in [Check(F.lit(True)), *checks]]), F.col("_at"))
    quoted = F.get(F.array(*[F.col(n).cast("string") for n in subjects]), where)
    text = look([None, *[c.text for c in checks]])
    return rows.withColumn("outcome", F.struct(
        look(["accepted", *["rejected" if c.error else "skipped" for c in checks]]).alias("status"),
        look([None, *[c.error for c in checks]]).alias("error_type"),
        F.when(where >= 0, F.concat(text, F.lit(": "), F.coalesce(quoted, F.lit("null")))).otherwise(text).alias("message"),
    )).drop("_at")


def _entity(raw: DataFrame, rules: Rules) -> tuple[DataFrame, list[Check]]:
    """The entity column and the checks on it, in the order the source makes them."""
    code, unknown = F.col("_code"), F.col("entity").isNull()
    if rules.shape == "sdmx":
        rows = to_iso3(raw.withColumn("_code", F.upper(F.trim(F.coalesce("entity_raw", F.lit(""))))), "_code", rules.index)
        return rows, [
            Check(code == "", NORMALIZATION, "missing area"), _skip(code.isin(GROUPING_ISO2)),
            Check(unknown, NORMALIZATION, "unmapped two-letter code", "_code"),
        ]
    if rules.shape == "keyed":
        registry = rules.index.select(F.col("series_id").alias("_code"), F.col("entity"), F.col("series_indicator"))
        rows = raw.withColumn("_code", F.trim(F.coalesce("entity_raw", F.lit("")))).join(registry, "_code", "left")
        rows = rows.withColumn("indicator_raw", F.col("series_indicator")).drop("series_indicator")
        return rows, [Check(unknown, NORMALIZATION, "unregistered series", "_code")]
    known = rules.index.select(F.col("entity").alias("_code"), F.col("entity"))
    named = code_or_fallback(F.col("entity_raw"), F.col("entity_alt"))
    rows = raw.withColumn("_code", named).join(known, "_code", "left")
    checks = [_skip(unknown)]
    if rules.shape == "paged":
        checks.insert(0, Check(code == "", NORMALIZATION, "missing country code"))
    return rows, checks


def judge(raw: DataFrame, rules: Rules, today: dt.date) -> DataFrame:
    """raw(ordinal, entity_raw, entity_alt, indicator_raw, period_raw, value_raw, unit_raw, name_raw)
    with one ``outcome`` per row, before duplicates are looked for."""
    rows, checks = _entity(raw, rules)
    spark = raw.sparkSession
    dims = rules.indicators.select(
        F.col("indicator_code").alias("_ind"), "kind", F.col("unit").alias("_unit"), F.col("frequency").alias("_freq"),
    ).join(bounds(spark), "kind", "left")
    rows = (
        rows.withColumn("indicator_code", F.trim(F.coalesce("indicator_raw", F.lit(""))))
        .join(dims, F.col("indicator_code") == F.col("_ind"), "left").drop("_ind")
        .withColumn("_period", parse_period(F.col("period_raw")))
        .withColumn("date", F.col("_period.date"))
        .withColumn("frequency", F.coalesce("_freq", "_period.frequency"))
        .withColumn("value", F.trim("value_raw").try_cast("double"))
        .withColumn("unit", F.coalesce(F.nullif(F.col("unit_raw"), F.lit("")), F.col("_unit")))
        .drop("_period", "_freq", "_unit")
    )
    rows = settled(rows, "date", "frequency", "value")
    sentinels = {"sdmx": ("nan",), "keyed": (".",)}.get(rules.shape)
    empty = F.col("value_raw").isNull() if sentinels is None else is_missing(F.col("value_raw"), *sentinels)
    if rules.shape != "sdmx":
        checks.append(Check(F.col("indicator_code") == "", NORMALIZATION, "missing indicator code"))
    checks += [_skip(empty), Check(F.col("date").isNull(), NORMALIZATION, "unreadable period", "period_raw")]
    if rules.cutoff_year is not None:
        checks.append(_skip(F.year("date") > rules.cutoff_year))
    value = F.col("value")
    shape = (F.col("indicator_code") == "") | ~F.col("entity").rlike("^[A-Z]{3}$")
    checks += [
        Check(value.isNull(), NORMALIZATION, "unreadable value", "value_raw"),
        Check(shape, NORMALIZATION, "bad record shape"),
        Check(F.isnan(value) | (F.abs(value) == float("inf")), VALIDATION, "value is not finite", "value_raw"),
        Check(~value.between(F.col("low"), F.col("high")), VALIDATION, "implausible value", "value_raw"),
        Check(F.year("date") > today.year + 1, VALIDATION, "date too far ahead", "period_raw"),
        Check(F.year("date") < 1900, VALIDATION, "date too early", "period_raw"),
    ]
    judged = _first_failing(rows, checks).withColumn("source", F.lit(rules.source)).drop("low", "high", "kind", "_code")
    return settled(judged, "outcome")


def reject_duplicates(judged: DataFrame) -> DataFrame:
    """Second and later valid copies of an observation become rejects.

    The first ordinal of each key is found by an aggregate that combines on the map
    side, then matched back on the ordinal itself. Ordinals are unique, so a key that
    repeats through a third of the batch is spread evenly in both steps.
    """
    good = F.col("outcome.status") == "accepted"
    firsts = judged.where(good).groupBy("entity", "indicator_code", "date").agg(F.min("ordinal").alias("ordinal"))
    marked = judged.join(firsts.select("ordinal", F.lit(True).alias("_first")), "ordinal", "left")
    repeat = good & F.col("_first").isNull()
    key = F.concat_ws("/", "entity", "indicator_code", F.col("date").cast("string"))
    return marked.withColumn(
        "outcome", F.when(repeat, F.struct(
            F.lit("rejected").alias("status"), F.lit(DUPLICATE).alias("error_type"),
            F.concat(F.lit("duplicate observation: "), key).alias("message"))).otherwise(F.col("outcome"))
    ).drop("_first")


#: Columns of a raw record, all kept with a reject.
RAW = ["entity_raw", "entity_alt", "indicator_raw", "period_raw", "value_raw", "unit_raw", "name_raw"]


def classify(raw: DataFrame, rules: Rules, today: dt.date) -> DataFrame:
    """Every raw row with exactly one outcome: accepted, rejected or skipped."""
    return reject_duplicates(judge(raw, rules, today))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("outcome.status = 'accepted'").select(
        "ordinal", "source", "indicator_code", "entity", "date", "value", "unit", "frequency", "name_raw",
        F.lit(True).alias("is_validated"))


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where("outcome.status = 'rejected'").select(
        "ordinal", "outcome.error_type", "outcome.message",
        F.struct(*[c for c in RAW if c in classified.columns]).alias("raw"))


def run_summary(classified: DataFrame, fetch_errors: int = 0) -> DataFrame:
    """Counters and status of one run; failed fetches count as failures."""
    is_ = lambda s: F.count_if(F.col("outcome.status") == s)
    counts = classified.agg(
        F.count("*").alias("fetched"), is_("accepted").alias("inserted"),
        (is_("rejected") + fetch_errors).alias("failed"), is_("skipped").alias("skipped"))
    return counts.withColumn("status", run_status(F.col("inserted"), F.col("failed")))


def run_status(inserted: Column, failed: Column) -> Column:
    return F.when((failed > 0) & (inserted == 0), "failed").when(failed > 0, "partial").otherwise("success")


def source_status(sources: DataFrame, summaries: DataFrame) -> DataFrame:
    """sources(source, configured) with the summary of each one's run and ``has_run``. A source that
    is not configured is skipped and has no run; one that is, but has no summary, failed."""
    rows = sources.join(summaries.withColumn("_ran", F.lit(True)), "source", "left")
    status = F.when(~F.col("configured"), "skipped").otherwise(F.coalesce("status", F.lit("failed")))
    return rows.withColumn("status", status).withColumn("has_run", F.col("configured") & F.col("_ran").isNotNull()).drop("_ran", "configured")


def ingest_batch(raw: DataFrame, rules: Rules, today: dt.date, fetch_errors: int = 0):
    """(accepted, rejected, skipped, run summary) of one batch, classified once: the rows are
    written to the shared folder, and all four read them from there."""
    rows = staged(classify(raw, rules, today), "classified")
    return (accepted(rows), rejected(rows), rows.where("outcome.status = 'skipped'").select("ordinal"),
            run_summary(rows, fetch_errors))
