"""Latest reading per series, described rows, series histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["entity", "indicator_code"]


def newest(df: DataFrame, keys: list[str], by: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The row with the smallest ``by`` per key, as one aggregate.

    An aggregate combines on the map side, so a key that holds a third of the rows
    sends one candidate per task instead of all of its rows.
    """
    rest = [c for c in df.columns if c not in keys] if keep is None else keep
    order = [b.alias(f"_o{i}") for i, b in enumerate(by)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(*keys, "_best._row.*")


def latest(facts: DataFrame, keys: list[str] | None = None, drop_null: bool = True) -> DataFrame:
    """Newest observation per series; of two sources on one date the lower name wins."""
    keys = keys or SERIES
    rows = facts.where(F.col("value").isNotNull()) if drop_null else facts
    return newest(rows, keys, [-F.unix_date("date"), F.col("source")]).select(*facts.columns)


def describe(facts: DataFrame, catalog: DataFrame, sources: DataFrame, countries: DataFrame) -> DataFrame:
    """Every non-null observation with its catalog, source and country columns.

    The country join is left, so an economy without a profile keeps its rows.
    """
    described = catalog.select(
        "source", "indicator_code", "indicator_name", "unit", "frequency", "concept", "is_primary"
    )
    return (
        facts.where(F.col("value").isNotNull())
        .join(described, ["source", "indicator_code"])
        .join(sources.select("source", "is_active"), "source")
        .join(countries.select("entity", "entity_name", "region"), "entity", "left")
    )


def describe_latest(facts, catalog, sources, countries) -> DataFrame:
    """Reduce to the newest rows first, describe the survivors after."""
    return describe(latest(facts), catalog, sources, countries)


def entity_latest(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Newest row per series with NULL values kept, for one-entity pages."""
    return latest(facts, drop_null=False).join(
        catalog.select("source", "indicator_code", "indicator_name", "unit"), ["source", "indicator_code"]
    )


def series_rows(facts, catalog, sources, countries, entity=None, indicator_code=None) -> DataFrame:
    """History with metadata. NULL values are kept."""
    rows = facts
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if indicator_code is not None:
        rows = rows.where(F.col("indicator_code") == indicator_code)
    return (
        rows.join(catalog.select("source", "indicator_code", "indicator_name", "unit"), ["source", "indicator_code"])
        .join(sources.select("source"), "source")
        .join(countries.select("entity", "entity_name"), "entity", "left")
    )


def history(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("value").isNotNull())


def recent(facts: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` non-null rows per series. The ``<= n`` filter on a row number lets
    Spark keep n rows per key and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*(keys or SERIES)).orderBy(F.col("date").desc(), F.col("source"))
    return (
        history(facts).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    )


def plotted_context(facts: DataFrame, keys: list[str] | None = None, n: int = 36) -> DataFrame:
    keys = keys or SERIES
    return recent(facts, n, keys).groupBy(*keys).agg(
        F.count("*").alias("plotted"), F.min("date").alias("first_date")
    )


def map_points(facts: DataFrame, anomalies: DataFrame, countries: DataFrame) -> DataFrame:
    """Latest value per entity and indicator, flagged when that very row is anomalous."""
    flags = anomalies.select("entity", "indicator_code", "date").distinct().withColumn("_hit", F.lit(True))
    return (
        latest(facts)
        .join(flags, ["entity", "indicator_code", "date"], "left")
        .join(countries.select("entity", "entity_name"), "entity", "left")
        .withColumn("has_anomaly", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def described_anomalies(anomalies: DataFrame, catalog: DataFrame, countries: DataFrame) -> DataFrame:
    return anomalies.join(
        catalog.select("source", "indicator_code", "indicator_name"), ["source", "indicator_code"]
    ).join(countries.select("entity", "entity_name"), "entity", "left")


def newest_anomalies(anomalies: DataFrame, limit: int = 100, entity=None, indicator_code=None, ceiling: int = 500) -> DataFrame:
    """The newest ``limit``; requests are held to ``ceiling``, which a caller may raise. ``newest_page`` says whether there are more."""
    return newest_page(anomalies, limit, entity, indicator_code, ceiling).drop("truncated")


def newest_page(anomalies: DataFrame, limit: int = 100, entity=None, indicator_code=None, ceiling: int = 500) -> DataFrame:
    """``newest_anomalies`` with ``truncated``: whether one more was there. Only limit + 1 rows are ever brought together."""
    rows = anomalies
    if entity:
        rows = rows.where(F.col("entity") == entity)
    if indicator_code:
        rows = rows.where(F.col("indicator_code") == indicator_code)
    most = max(1, min(limit, ceiling))
    order = [F.col("date").desc(), F.col("entity"), F.col("indicator_code"), F.col("source")]
    top = rows.orderBy(*order).limit(most + 1)
    whole = Window.partitionBy(F.lit(1))
    return top.withColumn("truncated", F.count("*").over(whole) > most).orderBy(*order).limit(most)


def notable_anomalies(anomalies: DataFrame, limit: int = 10, ceiling: int | None = None) -> DataFrame:
    """The ``limit`` most severe; a service that answers requests sets a ``ceiling``."""
    return anomalies.orderBy(
        F.col("z_score").isNull(), F.abs("z_score").desc(), F.col("date").desc(), "entity", "indicator_code", "source"
    ).limit(max(1, limit if ceiling is None else min(limit, ceiling)))


def severe_feed(anomalies: DataFrame, keys: list[str] | None = None, limit: int = 9) -> DataFrame:
    """One most severe reading per series, then the first ``limit`` of them."""
    keys = keys or SERIES
    size = F.coalesce(F.abs("z_score"), F.lit(-1.0))
    best = newest(anomalies.withColumn("_size", size), keys, [-F.col("_size"), -F.unix_date("date")])
    return best.orderBy(F.col("_size").desc(), F.col("date").desc(), *keys).limit(limit).drop("_size")
