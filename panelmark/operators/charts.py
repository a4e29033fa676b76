"""Colour and axis domains, legend stops, freshness placement, map anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.functions.labels import elapsed
from panelmark.operators.positions import values_at

# Axis steps and indicators that are signed by meaning.
STEPS = [1.0, 2.0, 2.5, 5.0, 10.0]
SIGNED_INDICATORS = ["NY.GDP.MKTP.KD.ZG", "NGDP_RPCH", "BN.CAB.XOKA.GD.ZS", "BCA_NGDPD"]


def robust_domain(newest_rows: DataFrame, signed: list[str] | None = None, by: str = "indicator_code") -> DataFrame:
    """Nearest-rank 5 % and 95 % of the values per indicator; symmetric for signed
    indicators and never of zero width."""
    finite = newest_rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    ends = values_at(finite, by, "value", {"_lo": 0.05, "_hi": 0.95})
    is_signed = F.col(by).isin(signed if signed is not None else SIGNED_INDICATORS)
    widest = F.greatest(F.abs("_lo"), F.abs("_hi"))
    bound = F.when(widest == 0, F.lit(1.0)).otherwise(widest)
    low = F.when(is_signed, -bound).otherwise(F.col("_lo"))
    high = F.when(is_signed, bound).otherwise(F.col("_hi"))
    return ends.select(
        by, low.alias("low"), F.when(low == high, low + 1).otherwise(high).alias("high"),
        F.when(is_signed, "diverging").otherwise("sequential").alias("scale"))


def nice_domain(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Axis ends on round steps; a flat series gets ten percent of room."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    ends = finite.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    target = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / 6)
    rows = ends.withColumn("_target", target).withColumn("_mag", F.pow(F.lit(10.0), F.floor(F.log10("_target"))))
    multiple = F.lit(STEPS[-1])
    for step in reversed(STEPS):
        multiple = F.when(F.col("_target") <= F.col("_mag") * step, F.lit(step)).otherwise(multiple)
    rows = rows.withColumn("_step", multiple * F.col("_mag"))
    tenth = F.abs("_lo") * 0.1
    pad = F.when(tenth == 0, F.lit(1.0)).otherwise(tenth)
    flat = F.col("_target").isNull()
    return rows.select(
        *keys, F.when(flat, F.col("_lo") - pad).otherwise(F.floor(F.col("_lo") / F.col("_step")) * F.col("_step")).alias("low"),
        F.when(flat, F.col("_hi") + pad).otherwise(F.ceil(F.col("_hi") / F.col("_step")) * F.col("_step")).alias("high"))


def legend_stops(domains: DataFrame, count: int = 5) -> DataFrame:
    """Evenly spaced stops between the ends of a domain, with their labels."""
    keep = [c for c in domains.columns if c not in ("low", "high")]
    stops = domains.select(*keep, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("stop"))
    stops = stops.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) * (F.col("stop") / F.lit(count - 1)))
    whole = F.round("value", 0).cast("decimal(38,0)").cast("string")
    tenth = F.round("value", 1).cast("decimal(38,1)").cast("string")
    return stops.select(*keep, "stop", "value", F.when(F.abs("value") >= 100, whole).otherwise(tenth).alias("label"))


def place_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Last runs on a shared axis from the oldest run to now, at least a day long;
    a source that never ran has no place. The oldest run is one scalar."""
    oldest = sources.agg(F.min("last_run").alias("oldest")).scalar()
    seconds = lambda t: F.unix_micros(t) / 1e6
    rows = sources.withColumn("_span", F.greatest(seconds(now) - seconds(F.coalesce(oldest, now)), F.lit(86400.0)))
    at = (seconds(F.col("last_run")) - (seconds(now) - F.col("_span"))) / F.col("_span")
    placed = F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))
    return rows.select(*sources.columns, elapsed(F.col("last_run"), now).alias("elapsed"),
                       F.when(F.col("last_run").isNotNull(), placed).alias("at"))


def ring_anchors(features: DataFrame, polygons: str = "polygons") -> DataFrame:
    """features(entity, polygons array<array<point>>): vertex mean of the largest outer
    ring by area. A feature is one row, so this needs no shuffle."""
    ring = "array<array<double>>"
    cross = lambda r: F.aggregate(
        F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0),
        lambda acc, i: acc + (
            F.get(F.get(r, F.pmod(i - 1, F.size(r))), F.lit(0)) + F.get(F.get(r, i), F.lit(0))) * (
            F.get(F.get(r, F.pmod(i - 1, F.size(r))), F.lit(1)) - F.get(F.get(r, i), F.lit(1))))
    usable = F.filter(F.col(polygons).cast(f"array<{ring}>"), lambda r: F.size(r) >= 3)
    sized = F.transform(usable, lambda r, i: F.struct((-F.abs(cross(r)) / 2).alias("neg_area"), i.alias("i"), r.alias("ring")))
    rows = features.withColumn("_best", F.array_min(F.transform(sized, lambda s: s))).where(F.col("_best").isNotNull())
    mean = lambda at: F.aggregate(F.col("_best.ring"), F.lit(0.0), lambda a, p: a + F.get(p, F.lit(at))) / F.size("_best.ring")
    keep = [c for c in features.columns if c != polygons]
    return rows.select(*keep, mean(0).alias("lon"), mean(1).alias("lat"), ((mean(0) + 180) / 360).alias("sweep"))
