"""Requested slices, changes, windows around anomalies, series context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.labels import fmt, signed_general, unit_suffix
from panelmark.operators.latest import SERIES, recent

RECENT_POINTS = 6
CONTEXT_ANOMALIES = 6
WINDOW_POINTS = 12
#: Limits of requests are served in classes that are powers of 2**4 apart; larger ones than 2**16 are one class.
CLASS_BITS, CLASSES = 4, 5


def query_observations(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests(request_id, entity, indicator_code, start, end, latest_only, limit).

    One row per request: newest points first, whether more exist, the coverage of the
    whole series, and the outcome: rows, none in the requested window, or no series.

    Requests of one shape (series, window, limit) share one slice. Facts of series nobody
    asked for are dropped first, the window is a condition of the join, and a slice
    gathers ``limit + 1`` points at most, which each task holds to before the shuffle; coverage is an aggregate.
    """
    shape = [*SERIES, "start", "end", "latest_only", "limit"]
    marked = requests.withColumn("_shape", F.to_json(F.struct(*shape), {"ignoreNullFields": "false"}))
    shapes = marked.select("_shape", *shape).distinct()
    asked = facts.where(F.col("value").isNotNull()).join(shapes.select(*SERIES).distinct(), SERIES, "left_semi")
    coverage = asked.groupBy(*SERIES).agg(
        F.count("*").alias("series_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    only_latest = F.col("latest_only") & F.col("start").isNull() & F.col("end").isNull()
    inside = (F.col("start").isNull() | (F.col("date") >= F.col("start"))) & (F.col("end").isNull() | (F.col("date") <= F.col("end")))
    newest_first = Window.partitionBy("_shape").orderBy(F.col("date").desc(), F.col("value").desc(), F.col("source").desc())
    most = F.when(only_latest, F.lit(1)).otherwise(F.col("limit") + 1)
    # requests of like limits are served together: a limit that is a constant is applied before the shuffle, per task
    classes = F.least(F.ceil(F.log2(F.greatest(most, F.lit(1))) / CLASS_BITS), F.lit(CLASSES)).cast("int")
    sized = shapes.withColumn("_most", most).withColumn("_class", classes)
    held = None
    for row in sized.groupBy("_class").agg(F.max("_most").alias("most")).collect():  # CLASSES rows at most
        mine = asked.join(sized.where(F.col("_class") == row["_class"]), SERIES).where(inside)
        mine = mine.withColumn("_n", F.row_number().over(newest_first)).where((F.col("_n") <= row["most"]) & (F.col("_n") <= F.col("_most")))
        held = mine if held is None else held.unionByName(mine)
    if held is None:
        held = asked.join(sized, SERIES).withColumn("_n", F.lit(1)).limit(0)
    slices = held.groupBy("_shape").agg(F.array_sort(F.collect_list(F.struct("_n", "date", "value", "source"))).alias("_found"))
    none = F.array().cast("array<struct<_n:int,date:date,value:double,source:string>>")
    return (
        marked.join(coverage, SERIES, "left").join(slices, "_shape", "left")
        .withColumn("_found", F.coalesce("_found", none))
        .withColumn("series_count", F.coalesce("series_count", F.lit(0)))
        .withColumn("truncated", ~only_latest & (F.size("_found") > F.col("limit")))
        .withColumn("observations", F.transform(F.slice("_found", F.lit(1), F.col("limit").cast("int")), lambda p: F.struct(
            p["date"].alias("date"), p["value"].alias("value"), p["source"].alias("source"))))
        .withColumn(
            "outcome",
            F.when(F.size("observations") > 0, "rows").when(F.col("series_count") > 0, "none_in_window").otherwise("no_series"),
        )
        .drop("_shape", "_found")
    )


def changes(facts: DataFrame, keys: list[str] | None = None, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Movement of the latest value against the 1st and 5th reading before it."""
    keys = keys or SERIES
    tail = recent(facts, max(lags) + 1, keys).groupBy(*keys).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("date", "value")))).alias("_p"))
    point = lambda i: F.get("_p", F.lit(i))
    rows = tail.select(
        *keys, point(0)["date"].alias("to_date"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("periods"), point(n)["date"].alias("from_date"),
                     (point(0)["value"] - point(n)["value"]).alias("delta")) for n in lags
        ])).alias("c"),
    )
    return rows.where(F.col("c.from_date").isNotNull()).select(
        *keys, "to_date", "c.periods", "c.from_date", fmt(F.col("c.delta")).alias("delta"),
        signed_general(fmt(F.col("c.delta"))).alias("text"),
    )


def previous_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return facts.where(F.col("value").isNotNull()).select(
        *keys, "date", F.lag("date").over(w).alias("previous_date"), F.lag("value").over(w).alias("previous_value"))


def anomaly_moves(anomalies: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Each anomaly with the reading before it and the signed change."""
    return anomalies.join(previous_values(facts, keys), [*keys, "date"], "left").withColumn(
        "change_text", signed_general(fmt(F.col("value") - F.col("previous_value"))))


def anomaly_windows(anomalies: DataFrame, facts: DataFrame, keys: list[str], span: int = WINDOW_POINTS) -> DataFrame:
    """``span`` points around each anomaly; an unknown date takes the last ``span``.

    Each row sees its neighbours through one ordered window; the frame reaches far enough
    back that the first ``span`` points of a series can be cut from it, too."""
    w = Window.partitionBy(*keys).orderBy("date")
    half = span // 2
    point = F.struct("date", "value", "source")
    rows = facts.where(F.col("value").isNotNull()).select(
        *keys, F.col("date").alias("anomaly_date"), F.row_number().over(w).alias("_at"),
        F.collect_list(point).over(w.rowsBetween(-half, span - 1)).alias("_near"))
    # up to ``half`` points stand before the row: the window begins with the first of them
    around = rows.select(*keys, "anomaly_date", F.slice("_near", F.lit(1), F.lit(span)).alias("window"))
    asked = anomalies.select(*keys, F.col("date").alias("anomaly_date"))
    known = asked.join(around, [*keys, "anomaly_date"], "left")
    strange = known.where(F.col("window").isNull()).drop("window")
    last = recent(facts.join(strange.select(*keys).distinct(), keys, "left_semi"), span, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(point)).alias("window"))
    return known.where(F.col("window").isNotNull()).unionByName(strange.join(last, keys))


def series_context(facts: DataFrame, anomalies: DataFrame, catalog: DataFrame, countries: DataFrame,
                   keys: list[str]) -> DataFrame:
    """Everything a reader needs about one series as one row: latest, six recent
    points, extremes, changes and its six newest anomalies."""
    held = facts.where(F.col("value").isNotNull())
    tail = recent(facts, RECENT_POINTS, keys).groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("date", "value"))), lambda p: F.struct(p["date"].alias("date"), fmt(p["value"]).alias("value"))
    ).alias("recent"))
    whole = held.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), F.min("date").alias("first_date"), F.max(F.struct("date", "value")).alias("_last"),
        F.min(F.struct("value", "date")).alias("_low"), F.min(F.struct((-F.col("value")).alias("v"), "date")).alias("_high"))
    base = whole.join(tail, keys).select(
        *keys, "observation_count", "first_date", F.col("_last.date").alias("last_date"), fmt(F.col("_last.value")).alias("latest_value"), "recent",
        fmt(F.col("_low.value")).alias("min_value"), F.col("_low.date").alias("min_date"),
        fmt(-F.col("_high.v")).alias("max_value"), F.col("_high.date").alias("max_date"),
    )
    change_rows = changes(facts, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("periods", "from_date", "text"))).alias("changes"))
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    flagged = (
        anomaly_moves(anomalies, facts, keys).withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= CONTEXT_ANOMALIES)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
            "_n", "date", fmt(F.col("value")).alias("value"), fmt(F.col("z_score")).alias("z_score"), "deviation_type",
            "previous_date", fmt(F.col("previous_value")).alias("previous_value"), "change_text"))).alias("anomalies"))
    )
    return (
        base.join(change_rows, keys, "left").join(flagged, keys, "left")
        .join(catalog.select("source", "indicator_code", "indicator_name", "unit", "frequency"),
              [k for k in keys if k in ("source", "indicator_code")])
        .join(countries.select("entity", F.col("entity_name"), "region"), "entity", "left")
        .withColumn("entity_name", F.coalesce("entity_name", "entity"))
        .withColumn("unit_suffix", unit_suffix(F.col("unit")))
    )


def with_forecast(context: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Attach rounded forecast points; a series without a forecast keeps a null."""
    rolled = points.groupBy(*keys, "model").agg(F.array_sort(F.collect_list(F.struct(
        "step", "date", fmt(F.col("median")).alias("median"), fmt(F.col("lower")).alias("lower"),
        fmt(F.col("upper")).alias("upper")))).alias("forecast"))
    return context.join(rolled, keys, "left")


def chart_frame(facts: DataFrame, anomalies: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """History with its flags, then the forecast, pinned to the last observation."""
    flags = anomalies.select(*keys, "date", "z_score", "deviation_type", F.lit(True).alias("_hit"))
    has = points.select(*keys).distinct().withColumn("_fc", F.lit(True))
    last = facts.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.max("date").alias("_last"))
    past = (
        facts.where(F.col("value").isNotNull()).select(*keys, "date", "value")
        .join(flags, [*keys, "date"], "left").join(last, keys).join(has, keys, "left")
        .withColumn("_pin", F.coalesce("_fc", F.lit(False)) & (F.col("date") == F.col("_last")))
        .select(
            *keys, "date", F.date_format("date", "yyyy-MM").alias("label"), "value",
            F.when(F.col("_pin"), F.col("value")).alias("median"), F.when(F.col("_pin"), F.col("value")).alias("lower"),
            F.when(F.col("_pin"), F.col("value")).alias("upper"), F.col("_hit").isNotNull().alias("flagged"),
            "z_score", "deviation_type",
        )
    )
    held = last.select(*keys)
    ahead = points.join(held, keys, "left_semi").select(
        *keys, "date", F.date_format("date", "yyyy-MM").alias("label"), "median", "lower", "upper",
        F.lit(False).alias("flagged"))
    return past.unionByName(ahead, allowMissingColumns=True)
