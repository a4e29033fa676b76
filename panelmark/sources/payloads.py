"""Landed provider payloads as raw rows.

Parsers take a text column with one payload per row, such as a message or a table brings it;
file readers go through the data source of ``sources/landed.py``. A payload is one provider
page, so its size is the provider's page size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmark.functions.codes import income_group
from panelmark.functions.periods import parse_period, period_end
from panelmark.sources.reference import KEYED_SERIES, MONITOR_INDICATORS
from panelmark.session import constant, settled
from panelmark.sources import landed

PAGED_ROW = ("array<struct<countryiso3code:string,indicator:struct<id:string,value:string>,"
             "country:struct<id:string,value:string>,date:string,value:string,unit:string>>")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def parse_paged_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``[meta, rows]`` pages to rows. Anything of another shape yields no rows."""
    keep = [c for c in payloads.columns if c != payload]
    pair = settled(payloads.withColumn("_v", F.from_json(F.col(payload), "array<string>")).drop(payload), "_v")
    pair = pair.where((F.size("_v") == 2) & F.ltrim(F.get("_v", F.lit(1))).startswith("["))
    pages = F.coalesce(F.get_json_object(F.get("_v", F.lit(0)), "$.pages").try_cast("int"), F.lit(1))
    rows = pair.select(*keep, pages.alias("pages"), F.from_json(F.get("_v", F.lit(1)), PAGED_ROW).alias("_rows"))
    rows = settled(rows, "_rows")
    return rows.select(
        *keep, "pages", F.get("_rows", F.lit(0))["indicator"]["value"].alias("display_name"),
        F.posexplode("_rows").alias("position", "r"),
    ).select(
        *keep, "pages", "display_name", "position", F.col("r.countryiso3code").alias("entity_raw"),
        F.col("r.country.id").alias("entity_alt"), F.col("r.indicator.id").alias("indicator_raw"),
        F.col("r.date").alias("period_raw"), F.col("r.value").alias("value_raw"),
        F.col("r.unit").alias("unit_raw"), F.col("r.indicator.value").alias("name_raw"),
    )


def read_paged_json(spark: SparkSession, path: str, **slices) -> DataFrame:
    return landed.observations(landed.read_landed(spark, path, "paged", **slices))


def parse_nested_map_json(payloads: DataFrame, cutoff: int, payload: str = "payload") -> DataFrame:
    """``{"values": {code: {area: {year: value}}}}`` to rows; areas that hold no map are skipped."""
    keep = [c for c in payloads.columns if c != payload]
    codes = payloads.select(
        *keep, F.explode(F.from_json(F.col(payload), "values map<string,map<string,string>>")["values"])
        .alias("indicator_raw", "areas"))
    areas = codes.select(*keep, "indicator_raw", F.explode("areas").alias("entity_raw", "_series"))
    return areas.select(
        *keep, "indicator_raw", "entity_raw",
        F.explode(F.from_json("_series", "map<string,string>")).alias("period_raw", "value_raw"),
    ).withColumn("cutoff", F.lit(cutoff))


def read_nested_map_json(spark: SparkSession, path: str, cutoff: int, **slices) -> DataFrame:
    return landed.observations(landed.read_landed(spark, path, "map", **slices)).withColumn("cutoff", F.lit(cutoff))


def read_sdmx_csv(spark: SparkSession, path: str, columns: list[str], period: str = "TIME_PERIOD", value: str = "OBS_VALUE",
                  indicator: str | None = None, series: tuple[str, ...] = ("REF_AREA",), **slices) -> DataFrame:
    """Quoted CSV with commas and line breaks in fields. Blank files and XML error
    documents yield nothing; ``period``, ``value``, ``indicator`` and ``series`` say what slices look at."""
    asked = [*columns, *(c for c in (period, value, indicator, *series) if slices and c and c not in columns)]
    named = [c if c in asked else None for c in (period, value, indicator)]
    rows = landed.read_landed(spark, path, "csv", asked, (*named, [c for c in series if c in asked]), **slices)
    return landed.observations(rows).select(*columns)


def keyed_registry(spark: SparkSession) -> DataFrame:
    return constant(
        spark, "series_id string, entity string, series_indicator string, name string, unit string, kind string, "
        "frequency string", KEYED_SERIES)


def monitor_indicators(spark: SparkSession) -> DataFrame:
    return constant(spark, "indicator_code string, name string, default_unit string, kind string", MONITOR_INDICATORS)


def parse_series_observations(payloads: DataFrame, registry: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """payloads(series_id, payload) to observations tagged with their series and registry row."""
    keep = [c for c in payloads.columns if c != payload]
    rows = payloads.select(
        *keep, F.explode(F.from_json(F.col(payload), "observations array<struct<date:string,value:string>>")["observations"])
        .alias("o")).select(*keep, F.col("o.date").alias("period_raw"), F.col("o.value").alias("value_raw"))
    return rows if registry is None else rows.join(registry, "series_id", "left")


def read_series_observations(spark: SparkSession, path: str, registry: DataFrame | None = None, **slices) -> DataFrame:
    """One file per series, named after it."""
    rows = landed.observations(landed.read_landed(spark, path, "series", **slices))
    return rows if registry is None else rows.join(registry, "series_id", "left")


def with_default_units(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Monthly monitor rows: a blank unit takes the indicator's declared one."""
    dims = indicators.select(F.col("indicator_code").alias("indicator_raw"), "default_unit")
    return rows.join(dims, "indicator_raw", "left").withColumn(
        "unit_raw", F.coalesce(F.nullif(F.col("unit_raw"), F.lit("")), "default_unit")).drop("default_unit")


def read_monitor_json(spark: SparkSession, path: str, **slices) -> DataFrame:
    return with_default_units(read_paged_json(spark, path, **slices), monitor_indicators(spark))


def parse_country_index(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Registry pages to real countries: groupings (no region) are left out."""
    row = ("array<struct<id:string,iso2Code:string,name:string,region:struct<id:string,value:string>,"
           "incomeLevel:struct<value:string>>>")
    rows = payloads.select(F.explode(F.try_variant_get(F.try_parse_json(F.col(payload)), "$[1]", row)).alias("r"))
    return rows.where(F.coalesce(F.trim("r.region.id"), F.lit("")).isin("", "NA") == F.lit(False)).select(
        F.upper(F.trim("r.id")).alias("entity"), F.upper(F.trim("r.iso2Code")).alias("iso2"),
        F.trim("r.name").alias("entity_name"), F.trim("r.region.value").alias("region"),
        income_group(F.col("r.incomeLevel.value")).alias("income")).distinct()


def read_country_index(spark: SparkSession, path: str) -> DataFrame:
    """Abort rather than run without an index: groupings would pass as countries."""
    index = parse_country_index(_texts(spark, path))
    if index.isEmpty():
        raise RuntimeError(f"no countries in the index at {path}")
    return index


def parse_area_index(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"countries": {code: ...}}`` to codes; an empty result means: fall back to a shape check."""
    return payloads.select(
        F.explode(F.map_keys(F.from_json(F.col(payload), "countries map<string,string>")["countries"])).alias("_c")
    ).select(F.upper(F.trim("_c")).alias("entity")).distinct()


def slice_rows(rows: DataFrame, series: list[str], mrv: int | None = None, start: str | None = None,
               end: str | None = None, max_year: int | None = None, indicators: list[str] | None = None,
               period: str = "period_raw") -> DataFrame:
    """Read-time slices. The most recent N values per series beat a period range.

    Periods are compared as the days they begin on, however they are spelt; ``end``
    takes in whole periods, so '2001' ends with that year. Unreadable periods come last
    among the most recent and lie in no range.
    """
    out = rows if indicators is None else rows.where(F.col("indicator_raw").isin(indicators))
    out = out.withColumn("_day", parse_period(F.col(period))["date"])
    if max_year is not None:
        out = out.where(F.substr(period, F.lit(1), F.lit(4)).try_cast("int") <= max_year)
    if mrv is not None:
        w = Window.partitionBy(*series).orderBy(F.col("_day").desc_nulls_last(), F.col(period).desc())
        held = out.where(F.col("value_raw").isNotNull())
        return held.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= mrv).drop("_n", "_day")
    if start is not None:
        out = out.where(F.col("_day") >= parse_period(F.lit(start))["date"])
    if end is not None:
        out = out.where(F.col("_day") <= period_end(F.lit(end)))
    return out.drop("_day")


def display_names(rows: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Last non-empty provider name of each code, else the registry's, else the code."""
    named = rows.groupBy(F.col("indicator_raw").alias("indicator_code")).agg(
        F.max(F.when(F.coalesce("name_raw", F.lit("")) != "", F.struct(F.col(order).alias("o"), "name_raw"))).alias("_n"))
    return named.join(registry.select("indicator_code", F.col("name").alias("_r")), "indicator_code", "left").select(
        "indicator_code", F.coalesce("_n.name_raw", "_r", "indicator_code").alias("name"))


def known_or_shaped(code: Column, index_empty: Column) -> Column:
    """Accept any well-formed code when no index could be loaded."""
    return index_empty & code.rlike("^[A-Z]{3}$")
