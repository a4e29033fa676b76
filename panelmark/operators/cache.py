"""Content-addressed result tables and request-trace counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVISION = 6


def slug(part: Column) -> Column:
    """Readable fragment of a key, free of delimiters."""
    text = F.left(F.regexp_replace(part.cast("string"), r"[^\p{L}\p{N}._-]", "-"), F.lit(40))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("_"))


def cache_key(task: str, country: Column, indicator: Column, parts: dict[str, Column], revision: int = REVISION) -> Column:
    """Readable prefix and a digest of every part in name order, so equal keys mean equal inputs."""
    named = {"country": country, "indicator": indicator, **parts}
    canonical = F.concat_ws(
        "|", F.lit(f"task={task}"), F.lit(f"rev={revision}"),
        *[F.concat(F.lit(f"{name}="), F.coalesce(named[name].cast("string"), F.lit("null"))) for name in sorted(named)])
    return F.concat_ws(":", F.lit(task), slug(country), slug(indicator), F.left(F.sha2(canonical, 256), F.lit(16)))


def live(now: Column) -> Column:
    """Unexpired and not empty; an entry without an expiry is live."""
    return (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.coalesce(F.col("response"), F.lit("")) != "")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests(request_id, cache_key) with the live entry, if there is one."""
    entries = cache.where(live(now)).select("cache_key", "response", "score")
    return requests.join(entries, "cache_key", "left").withColumn("hit", F.col("response").isNotNull())


def count_hits(cache: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The cache with its hit counters advanced by a batch of lookups, added up per key first."""
    asked = requests.groupBy("cache_key").agg(F.count("*").alias("_asked"))
    return cache.join(asked, "cache_key", "left").withColumn(
        "hits", F.col("hits") + F.when(live(now), F.coalesce("_asked", F.lit(0))).otherwise(0)).drop("_asked")


def prune(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def invalidate(cache: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(entries kept, one row with how many were removed)."""
    gone = F.col("cache_key").startswith(prefix)
    return cache.where(~gone), cache.agg(F.count_if(gone).alias("removed"))


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    """Counts over entries that expire in the future; one without an expiry is not counted."""
    held = cache.where(F.col("expires_at") > now)
    return held.agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.avg("score").alias("mean_score")
    ).withColumn("hit_rate", F.col("hits") / F.nullif(F.col("hits") + F.col("entries"), F.lit(0)))


def _rate(hits: Column, n: Column, places: int = 3) -> Column:
    scale = float(10 ** places)
    return F.rint(hits / F.nullif(n, F.lit(0)) * scale) / scale


def trace_rollup(traces: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Request counters, outcome and provider histograms and rates.

    traces(outcome, provider, cached, fallbacks, ranked, tool_calls, tool_failures,
    timed_out, seconds). Histograms are counted per word first, then put into a map.
    """
    groups = by or []
    names = [f"_g{i}" for i in range(len(groups))]
    rows = traces.select("*", *[g.alias(n) for g, n in zip(groups, names)])
    small = rows.groupBy(*names, "outcome", "provider").agg(
        F.count("*").alias("n"), F.count_if("cached").alias("cache_hits"), F.count_if(F.col("fallbacks") > 0).alias("fallbacks"),
        F.count_if("ranked").alias("rankings"), F.count_if("timed_out").alias("timeouts"), F.sum("tool_calls").alias("tool_calls"),
        F.sum("tool_failures").alias("tool_failures"), F.sum("seconds").alias("seconds"))

    def histogram(word: str) -> DataFrame:
        counted = small.where(F.col(word).isNotNull() & (F.col(word) != "")).groupBy(*names, word).agg(F.sum("n").alias("n"))
        return counted.groupBy(*names).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(word, "n")))).alias(f"{word}s"))

    refused = F.when(F.col("outcome").isin("refused", "retracted", "absent"), F.col("n"))
    total = small.groupBy(*names).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("_c"),
        F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("_f"), F.coalesce(F.sum("rankings"), F.lit(0)).alias("_r"),
        F.coalesce(F.sum(refused), F.lit(0)).alias("_x"), F.coalesce(F.sum("timeouts"), F.lit(0)).alias("_t"),
        F.sum("seconds").alias("_s"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_calls"),
        F.coalesce(F.sum("tool_failures"), F.lit(0)).alias("tool_failures"))
    n = F.col("requests")
    out = total.select(
        *names, "requests", _rate(F.col("_c"), n).alias("cache_hit_rate"), _rate(F.col("_f"), n).alias("fallback_rate"),
        _rate(F.col("_r"), n).alias("ranking_rate"), _rate(F.col("_x"), n).alias("refusal_rate"),
        _rate(F.col("_t"), n).alias("timeout_rate"), _rate(F.col("_s"), n, 2).alias("mean_seconds"), "tool_calls", "tool_failures")
    if names:
        return out.join(histogram("outcome"), names, "left").join(histogram("provider"), names, "left")
    return out.withColumn("outcomes", histogram("outcome").select("outcomes").scalar()).withColumn(
        "providers", histogram("provider").select("providers").scalar())


def request_budget(log: DataFrame, per_minute: int, per_day: int, client: str = "client", at: str = "at") -> DataFrame:
    """Requests of the trailing sixty seconds and of the day so far, per client and request.

    A log audit. The trailing count is split by minute: each request is also shown to
    the next minute as context, so a busy client is spread over its minutes. The day
    count adds the earlier minutes of the day, counted per minute, to the place inside
    the own minute.
    """
    seconds = F.unix_seconds(at)
    rows = log.withColumn("_sec", seconds).withColumn("_minute", F.floor(seconds / 60)).withColumn("_day", F.floor(seconds / 86400))
    shown = rows.withColumn("_slot", F.explode(F.array(F.col("_minute"), F.col("_minute") + 1)))
    trailing = Window.partitionBy(client, "_slot").orderBy("_sec").rangeBetween(-59, 0)
    counted = shown.withColumn("last_minute", F.count("*").over(trailing)).where(F.col("_slot") == F.col("_minute"))
    inside = Window.partitionBy(client, "_day", "_minute").orderBy("_sec").rangeBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_own", F.count("*").over(inside))
    minutes = rows.groupBy(client, "_day", "_minute").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(client, "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    before = minutes.select(client, "_day", "_minute", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = counted.join(before, [client, "_day", "_minute"]).withColumn("day_so_far", F.col("_before") + F.col("_own"))
    return out.select(*log.columns, "last_minute", "day_so_far", (
        (F.col("last_minute") > per_minute) | (F.col("day_so_far") > per_day)).alias("over_budget"))
