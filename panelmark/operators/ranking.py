"""Whole-field rankings, rails, coverage and series summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.operators.latest import SERIES
from panelmark.operators.positions import split_row_number
from panelmark.operators.resolve import resolve_indicators

#: The ceiling a service sets on the limit of a ranking it is asked for.
MAX_ENTRIES = 300


def recency_cutoff(today: dt.date, max_age_years: int) -> dt.date:
    return today - dt.timedelta(days=365 * max_age_years)


def clamp(column: Column, default: int, ceiling: int) -> Column:
    """Whole number in [1, ceiling]; anything unreadable becomes the default."""
    wanted = F.expr("try_cast(NULL AS bigint)") if column is None else column.try_cast("bigint")
    return F.coalesce(F.least(F.greatest(wanted, F.lit(1)), F.lit(ceiling)), F.lit(default))


def rank_entities(
    newest_rows: DataFrame, order: str = "desc", limit: int | None = None,
    max_age_years: int | None = None, today: dt.date | None = None, fallback: bool = False,
    by: str = "indicator_code", ceiling: int | None = None,
) -> DataFrame:
    """Position of every entity on its latest value; ties go to the lower code.

    Counts and date range describe the whole ranking, not the returned part. They
    come from an aggregate, so a limited ranking never gathers an indicator in one
    task: the ``<= limit`` filter keeps that many rows per task before the shuffle.
    A full ranking is numbered run by run of like values (``split_row_number``), so an
    indicator may hold any share of the rows. A service that answers requests sets a
    ``ceiling`` on the limit; ``truncated`` says that there is more.
    """
    rows = newest_rows
    widened = F.lit(False)
    if max_age_years is not None:
        fresh = F.col("date") >= F.lit(recency_cutoff(today, max_age_years))
        if fallback:
            share = rows.groupBy(by).agg(F.count_if(fresh).alias("_fresh"), F.max("date").alias("_newest"))
            rows = rows.join(share, by).where(fresh | (F.col("_fresh") == 0))
            widened = F.col("_fresh") == 0
        else:
            rows = rows.where(fresh)
    direction = F.col("value").asc() if order == "asc" else F.col("value").desc()
    stats = rows.groupBy(by).agg(
        F.count("*").alias("entity_count"), F.min("date").alias("earliest"), F.max("date").alias("newest"),
        *( [F.max(widened).alias("recency_dropped")] if fallback and max_age_years is not None else [] ),
    )
    rows = rows.drop("_fresh", "_newest")
    if limit is None:
        ranked = split_row_number(rows, [by], "value", ["entity"], "rank", descending=order != "asc")
        truncated = F.lit(False)
    else:
        most = max(1, limit if ceiling is None else min(limit, ceiling))
        numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(direction, F.col("entity").asc())))
        ranked = numbered.where(F.col("rank") <= most)
        truncated = F.col("entity_count") > most
    return ranked.join(stats, by).withColumn("truncated", truncated)


def answer_rankings(
    requests: DataFrame, metadata: DataFrame, aliases: DataFrame, not_held: DataFrame, newest_rows: DataFrame, countries: DataFrame,
    max_age_years: int | None = None, today: dt.date | None = None, ceiling: int = MAX_ENTRIES,
) -> DataFrame:
    """requests(request_id, token, order, limit) answered in one call: a row for each entry of its ranking.

    The token is resolved first; one that names no single indicator has no entries here (``resolve_indicators``
    says why). Each entry carries the size and date range of the whole field, whether the request's limit
    (at most ``ceiling``; null asks for all) cut it, and the other indicators of the same concept. Requests for one
    indicator in one order share one ranking, numbered run by run of like values.
    """
    held = resolve_indicators(requests, metadata, aliases, not_held).withColumn("indicator_code", F.col("resolution.code")).where("indicator_code IS NOT NULL")
    way = F.when(F.lower("order") == "asc", "asc").otherwise("desc")
    held = held.select("request_id", "indicator_code", way.alias("order"), F.when(F.col("limit").isNotNull(), F.least(F.greatest("limit", F.lit(1)), F.lit(ceiling))).alias("_most"))
    rows = newest_rows if max_age_years is None else newest_rows.where(F.col("date") >= F.lit(recency_cutoff(today, max_age_years)))
    shapes = held.select("indicator_code", "order").distinct()
    asked = rows.join(shapes, "indicator_code").withColumn("_key", F.when(F.col("order") == "asc", -F.col("value")).otherwise(F.col("value")))
    by = ["indicator_code", "order"]
    ranked = split_row_number(asked, by, "_key", ["entity"], "rank").drop("_key")
    stats = asked.groupBy(*by).agg(F.count("*").alias("entity_count"), F.min("date").alias("earliest"), F.max("date").alias("newest"))
    pairs = metadata.where("concept IS NOT NULL").select("concept", "indicator_code").distinct()
    others = pairs.join(pairs.withColumnRenamed("indicator_code", "_other"), "concept").where(F.col("_other") != F.col("indicator_code"))
    others = others.groupBy("indicator_code").agg(F.array_sort(F.collect_set("_other")).alias("alternatives"))
    entries = ranked.join(held, by).where(F.col("_most").isNull() | (F.col("rank") <= F.col("_most")))
    return (
        entries.join(stats, by).join(others, "indicator_code", "left").join(countries.select("entity", "entity_name", "region"), "entity", "left")
        .withColumn("truncated", F.coalesce(F.col("entity_count") > F.col("_most"), F.lit(False)))
        .withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>"))).drop("_most"))


def rank_map(newest_rows: DataFrame, countries: DataFrame, indicator_code: str) -> DataFrame:
    """Every map point with its value and rank on the chosen indicator, null where it has none."""
    chosen = rank_entities(newest_rows.where(F.col("indicator_code") == indicator_code))
    return countries.select("entity", "entity_name").join(
        chosen.select("entity", "value", "rank"), "entity", "left").withColumn("indicator_code", F.lit(indicator_code))


def alternatives(catalog: DataFrame) -> DataFrame:
    """Other series of the same concept, per indicator row of the catalog."""
    left = catalog.select("source", "indicator_code", "concept")
    right = catalog.select(
        F.col("source").alias("alt_source"), F.col("indicator_code").alias("alt_code"), "concept"
    )
    return left.join(right, "concept").where(F.col("alt_code") != F.col("indicator_code"))


def ranking_rail(newest_rows: DataFrame, by: str = "indicator_code", top: int = 5, bottom: int = 3) -> DataFrame:
    """First five and, when more than eight entities exist, last three, with the gap between."""
    counts = newest_rows.groupBy(by).agg(F.count("*").cast("int").alias("n"))
    down = Window.partitionBy(by).orderBy(F.col("value").desc(), F.col("entity").asc())
    up = Window.partitionBy(by).orderBy(F.col("value").asc(), F.col("entity").desc())
    head = (
        newest_rows.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= top)
        .join(counts, by).withColumn("rank", F.col("_n")).withColumn("part", F.lit("top"))
    )
    tail = (
        newest_rows.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= bottom)
        .join(counts, by).where(F.col("n") > top + bottom)
        .withColumn("rank", F.col("n") - F.col("_n") + 1).withColumn("part", F.lit("bottom"))
    )
    gap = F.when(F.col("n") > top + bottom, F.col("n") - top - bottom).otherwise(
        F.greatest(F.col("n") - top, F.lit(0)))
    return head.unionByName(tail).drop("_n").withColumn("gap", gap)


def indicator_metadata(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows with coverage; an indicator without observations is absent.

    Distinct entities are found by reducing to (indicator, entity) first, which
    combines on the map side; the second step adds up those small rows.
    """
    per_entity = facts.groupBy("source", "indicator_code", "entity").agg(
        F.count("value").alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    coverage = per_entity.groupBy("source", "indicator_code").agg(
        F.count("*").alias("country_count"), F.sum("_n").alias("observation_count"),
        F.min("_first").alias("earliest_date"), F.max("_last").alias("latest_date"),
    )
    return coverage.join(catalog, ["source", "indicator_code"]).orderBy(
        F.col("is_primary").desc(), F.col("country_count").desc(), "source", "indicator_code"
    )


def indicator_options(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Same coverage for a picker, widest first."""
    seen = facts.select("source", "indicator_code", "entity").distinct()
    coverage = seen.groupBy("source", "indicator_code").agg(F.count("*").alias("country_count"))
    return coverage.join(
        catalog.select("source", "indicator_code", "indicator_name", "category", "unit", "frequency"),
        ["source", "indicator_code"],
    ).orderBy(F.col("country_count").desc(), "source", "indicator_code")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of table sizes."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()]
    merged = counted[0]
    for part in counted[1:]:
        merged = merged.unionAll(part)
    return merged.agg(*[F.max(F.when(F.col("t") == name, F.col("n"))).alias(name) for name in tables])


def coverage(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return facts.where(F.col("value").isNotNull()).groupBy(*(keys or SERIES)).agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def series_summary(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latest, lowest and highest reading with dates. Equal readings take the earliest date."""
    rows = facts.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    out = rows.groupBy(*(keys or SERIES)).agg(
        F.max(F.struct("date", "value")).alias("_l"),
        F.min(F.struct("value", "date")).alias("_lo"),
        F.min(F.struct((-F.col("value")).alias("v"), "date")).alias("_hi"),
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return out.select(
        *(keys or SERIES), F.col("_l.value").alias("latest_value"), F.col("_l.date").alias("latest_date"),
        F.col("_lo.value").alias("min_value"), F.col("_lo.date").alias("min_date"),
        (-F.col("_hi.v")).alias("max_value"), F.col("_hi.date").alias("max_date"), "n", "first_date", "last_date",
    )


def concept_groups(metadata: DataFrame) -> DataFrame:
    """Indicators by concept, primary first inside; groups by their leading series' coverage."""
    rows = metadata.withColumn("concept", F.coalesce("concept", F.lit("other")))
    inside = Window.partitionBy("concept").orderBy(
        F.col("is_primary").desc(), F.col("country_count").desc(), "source", "indicator_code"
    )
    placed = rows.withColumn("place", F.row_number().over(inside))
    heads = placed.where("place = 1").select("concept", F.col("country_count").alias("group_coverage"))
    return placed.join(heads, "concept").orderBy(F.col("group_coverage").desc(), "concept", "place")


def distinct_concepts(catalog: DataFrame) -> DataFrame:
    return catalog.where("concept IS NOT NULL").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def primaries_per_concept(catalog: DataFrame) -> DataFrame:
    return catalog.where("concept IS NOT NULL").groupBy("concept").agg(F.count_if("is_primary").alias("primaries"))


def entity_series_order(facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Series an entity holds, primaries first, then coverage; unknown series stay, last."""
    held = facts.select("entity", "source", "indicator_code").distinct()
    scores = metadata.select(
        "source", "indicator_code",
        (F.when(F.col("is_primary"), 1_000_000).otherwise(0) + F.coalesce("country_count", F.lit(0))).alias("score"),
    )
    w = Window.partitionBy("entity").orderBy(F.col("score").desc(), "indicator_code", "source")
    return (
        held.join(scores, ["source", "indicator_code"], "left")
        .withColumn("score", F.coalesce("score", F.lit(-1)).cast("long"))
        .withColumn("place", F.row_number().over(w))
    )


def bounded_series(facts: DataFrame, entities: DataFrame, limit: int = 400) -> DataFrame:
    return facts.join(entities.select("entity"), "entity", "left_semi").select(*SERIES).distinct().orderBy(
        *SERIES).limit(limit)


def cited_series(results: DataFrame) -> DataFrame:
    """Distinct (entity, indicator) of successful results, numbered by first appearance."""
    first = results.where("ok").groupBy("answer_id", "entity", "indicator_code").agg(F.min("ordinal").alias("first_at"))
    w = Window.partitionBy("answer_id").orderBy("first_at", "entity", "indicator_code")
    return first.withColumn("citation", F.row_number().over(w))


def request_counters(results: DataFrame) -> DataFrame:
    return results.groupBy("answer_id").agg(
        F.sum("rows_read").alias("rows_read"), F.max("entities_ranked").alias("entities_ranked"),
        F.count_if(~F.col("ok")).alias("tool_failures"), F.bool_or("ranked").alias("called_ranking"),
        F.count("*").alias("tool_calls"),
    )

