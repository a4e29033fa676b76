"""Guarded multi-model forecasts over one row per series.

Histories are trimmed to the newest ``max_context`` values before they are gathered,
so a series row is bounded whatever the length of its history. Models are tried in
order; the first plausible answer is kept and the reasons of the others are recorded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.functions.periods import advance, horizon_for, season_for
from panelmark.operators.cache import cache_key
from panelmark.operators.models import LOCAL_MODELS
from panelmark.session import settled

# Fixed values of the forecast service.
MIN_OBSERVATIONS = 16
MAX_CONTEXT = 512
BAND_Z = 1.2816
DRIFT_LIMIT = 20.0

Model = Callable[[list[float], int, int], tuple[list[float], list[float], list[float]]]


def series_inputs(facts: DataFrame, keys: list[str], min_obs: int = MIN_OBSERVATIONS,
                  max_context: int = MAX_CONTEXT) -> DataFrame:
    """facts(keys, date, value, frequency) to one row per eligible series.

    Counts come from an aggregate over the whole history; the kept tail comes from a
    row-number filter that Spark applies before the shuffle.
    """
    rows = facts.where(F.col("value").isNotNull()).select(*keys, "date", "value", "frequency")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("observations"), F.max("date").alias("last_date"),
                                     F.max("frequency").alias("frequency"))
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    tail = rows.drop("frequency").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_context)
    history = tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda p: p["value"]).alias("history"))
    return (
        counts.where(F.col("observations") >= min_obs).join(history, keys)
        .withColumn("horizon", horizon_for(F.col("frequency"))).withColumn("season", season_for(F.col("frequency")))
    )


# Closed-form models as column expressions over (history, horizon, season).

def _last() -> Column:
    return F.element_at("history", -1)


def _spread() -> Column:
    n = F.size("history")
    mean = F.aggregate("history", F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate("history", F.lit(0.0), lambda a, v: a + v * v) / n
    return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def _drift() -> Column:
    slope = (_last() - F.get("history", F.lit(0))) / F.nullif(F.size("history") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.col("horizon")), lambda h: _last() + slope * h)


def _seasonal_naive() -> Column:
    n = F.size("history")
    season = F.when((F.col("season") > 1) & (n >= F.col("season") * 2), F.col("season")).otherwise(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.col("horizon") - 1), lambda h: F.get("history", n - season + F.pmod(h, season)))


CLOSED_FORMS = {"drift": _drift, "seasonal_naive": _seasonal_naive}


def closed_form(inputs: DataFrame, model: str) -> DataFrame:
    """median, lower and upper of one closed-form model; the band is the history's spread."""
    rows = settled(inputs.withColumn("median", CLOSED_FORMS[model]()).withColumn("_sd", _spread()), "median", "_sd")
    return (
        rows.withColumn("lower", F.transform("median", lambda m: m - F.col("_sd") * BAND_Z))
        .withColumn("upper", F.transform("median", lambda m: m + F.col("_sd") * BAND_Z))
        .withColumn("model", F.lit(model)).drop("_sd")
    )


def rejection(median: Column, lower: Column, upper: Column, history: Column) -> Column:
    """Why an answer is implausible, or null. Wide on purpose: it stops nonsense, not surprises."""
    wild = lambda a: F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    last = F.element_at(history, -1)
    reach = F.greatest(F.array_max(history) - F.array_min(history), F.abs(last), F.lit(1.0)) * DRIFT_LIMIT
    drift = F.greatest(F.abs(F.array_max(median) - last), F.abs(F.array_min(median) - last))
    return (
        F.when(median.isNull() | lower.isNull() | upper.isNull(), F.lit("no answer"))
        .when(wild(median) | wild(lower) | wild(upper), F.lit("not finite"))
        .when(F.size(median) == 0, F.lit("empty"))
        .when(drift > reach, F.lit("drifts too far"))
    )


def guard(answers: DataFrame) -> DataFrame:
    """answers(history, median, lower, upper) with ``rejected``: the reason or null."""
    return answers.withColumn("rejected", rejection(F.col("median"), F.col("lower"), F.col("upper"), F.col("history")))


def parse_answers(payloads: DataFrame, expected: str, payload: str = "payload") -> DataFrame:
    """Model answers as JSON to arrays; anything but three equal-length number lists is rejected."""
    raw = F.from_json(F.col(payload), "model string, median array<string>, lower array<string>, upper array<string>")
    rows = payloads.withColumn("_a", raw)
    for name in ("median", "lower", "upper"):
        rows = rows.withColumn(name, F.transform(F.col(f"_a.{name}"), lambda v: v.try_cast("double")))
    listed = F.col("median").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    numeric = ~F.exists(F.flatten(F.array("median", "lower", "upper")), lambda v: v.isNull())
    even = (F.size("median") == F.size("lower")) & (F.size("median") == F.size("upper"))
    reason = F.when(~listed | ~F.coalesce(numeric, F.lit(False)), "malformed").when(~even, "ragged")
    return rows.withColumn("model", F.coalesce("_a.model", F.lit(expected))).withColumn("rejected", reason).drop("_a")


def clamp_bands(points: DataFrame) -> DataFrame:
    return points.withColumn("lower", F.least("lower", "median")).withColumn("upper", F.greatest("upper", "median"))


def forecast_points(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """One dated row per step, on the first day of its period, bands never crossing the median."""
    zipped = F.arrays_zip("median", "lower", "upper")
    rows = forecasts.select(*keys, "model", "last_date", "frequency", F.posexplode(zipped).alias("_at", "p"))
    return clamp_bands(rows.select(
        *keys, "model", (F.col("_at") + 1).alias("step"),
        advance(F.col("last_date"), F.col("frequency"), F.col("_at") + 1).alias("date"),
        F.col("p.median").alias("median"), F.col("p.lower").alias("lower"), F.col("p.upper").alias("upper")))


def forecast_closed(inputs: DataFrame, models: list[str]) -> DataFrame:
    """The cascade over closed-form models, all inside the plan."""
    rows = inputs
    for name in models:
        answer = closed_form(rows, name)
        why = rejection(F.col("median"), F.col("lower"), F.col("upper"), F.col("history"))
        rows = answer.withColumn(f"_{name}", F.struct(
            F.lit(name).alias("model"), "median", "lower", "upper", why.alias("why"))).drop("median", "lower", "upper", "model")
        rows = settled(rows, f"_{name}")
    tried = F.array(*[F.col(f"_{m}") for m in models])
    rows = rows.withColumn("_tried", tried).withColumn("_first", F.array_position(
        F.transform("_tried", lambda t: t["why"].isNull()), F.lit(True)))
    best = F.when(F.col("_first") > 0, F.get("_tried", (F.col("_first") - 1).cast("int")))
    failed = F.when(F.col("_first") > 0, F.slice("_tried", F.lit(1), (F.col("_first") - 1).cast("int"))).otherwise(F.col("_tried"))
    rows = rows.withColumn("_best", best).withColumn(
        "attempts", F.transform(failed, lambda t: F.concat(t["model"], F.lit(": "), t["why"])))
    return rows.select(*inputs.columns, "_best.model", "_best.median", "_best.lower", "_best.upper", "attempts")


def _plausible(history, median, lower, upper) -> str | None:
    import numpy as np

    arrays = [np.asarray(a, dtype="float64") for a in (median, lower, upper)]
    if len({len(a) for a in arrays}) != 1:
        return "ragged"
    if not all(np.isfinite(a).all() for a in arrays):
        return "not finite"
    if not len(arrays[0]):
        return "empty"
    past = np.asarray(history, dtype="float64")
    reach = DRIFT_LIMIT * max(past.max() - past.min(), abs(past[-1]), 1.0)
    return "drifts too far" if np.abs(arrays[0] - past[-1]).max() > reach else None


def forecast(inputs: DataFrame, models: list[tuple[str, Model]] | None = None) -> DataFrame:
    """The cascade over Python models: (history, horizon, season) -> (median, lower, upper).

    Rows arrive as Arrow batches of whole series, dealt out evenly by their hash, so workers hold one
    batch at a time and no group is gathered. A model with ``of_many`` answers all series of a batch that
    are still open at once; should that fail, it is asked one by one. A model that raises or answers
    nonsense gives way to the next; a series no model can answer keeps null arrays and its attempts.
    """
    chosen = models or LOCAL_MODELS

    def asked(model, rows: list) -> list:
        many = getattr(model, "of_many", None)
        if many is not None and len(rows) > 1:
            try:
                return many([list(r.history) for r in rows], [int(r.horizon) for r in rows], [int(r.season) for r in rows])
            except Exception:  # one of them fails: find out which
                pass
        return [None] * len(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            answers, attempts, open_ = [(None, None, None, None)] * len(rows), [[] for _ in rows], list(range(len(rows)))
            for name, model in chosen:
                still = []
                for i, answer in zip(open_, asked(model, [rows[i] for i in open_])):
                    row = rows[i]
                    try:
                        median, lower, upper = answer or model(list(row.history), int(row.horizon), int(row.season))
                        why = _plausible(row.history, median, lower, upper)
                    except Exception as exc:  # any model failure hands over to the next
                        why = f"{type(exc).__name__}: {exc}"
                    if why is None:
                        answers[i] = (name, list(median), list(lower), list(upper))
                    else:
                        attempts[i].append(f"{name}: {why}")
                        still.append(i)
                open_ = still
            extra = pd.DataFrame([(*a, t) for a, t in zip(answers, attempts)], columns=["model", "median", "lower", "upper", "attempts"], index=batch.index)
            yield pd.concat([batch, extra], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in inputs.dtypes)
    spread = inputs.repartition(F.xxhash64(*[c for c, t in inputs.dtypes if t in ("string", "int", "bigint", "date")]))
    return spread.mapInPandas(
        run, f"{schema}, model string, median array<double>, lower array<double>, upper array<double>, attempts array<string>")


def series_key(models: list[str], country: str = "entity", indicator: str = "indicator_code") -> Column:
    """Changes with the last date, the count, the horizon or the list of models."""
    return cache_key("forecast", F.col(country), F.col(indicator), {
        "last_date": F.col("last_date"), "observations": F.col("observations"), "horizon": F.col("horizon"),
        "cascade": F.lit(",".join(models)), "source": F.col("source")})


def short_series(facts: DataFrame, keys: list[str], min_obs: int = MIN_OBSERVATIONS) -> DataFrame:
    """Series with too few readings for a forecast."""
    return facts.groupBy(*keys).agg(F.count("value").alias("observations")).where(F.col("observations") < min_obs)


def refresh_forecasts(inputs: DataFrame, cache: DataFrame, now: Column, models: list[str], ttl_days: int = 30,
                      run: Callable[[DataFrame], DataFrame] | None = None, short: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fresh cache rows, outcome per series): only series without a live entry are computed.

    ``short`` (see ``short_series``) were considered too and are ``skipped``; ``failed`` are series
    that every model failed on."""
    keyed = inputs.withColumn("cache_key", series_key(models))
    alive = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("cache_key")
    missing = keyed.join(alive, "cache_key", "left_anti")
    answers = (run or (lambda df: forecast_closed(df, models)))(missing)
    fresh = answers.where(F.col("model").isNotNull()).withColumn("created_at", now).withColumn(
        "expires_at", now + F.expr(f"INTERVAL {ttl_days} DAYS"))
    held = keyed.join(alive, "cache_key", "left_semi").select("cache_key", F.lit("already_cached").alias("outcome"))
    done = answers.select("cache_key", F.when(F.col("model").isNotNull(), "computed").otherwise("failed").alias("outcome"))
    outcomes = held.unionAll(done)
    if short is not None:
        outcomes = outcomes.unionAll(short.select(F.lit(None).cast("string"), F.lit("skipped")))
    return fresh, outcomes


def refresh_summary(outcomes: DataFrame) -> DataFrame:
    is_ = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.agg(F.count("*").alias("series_considered"), is_("computed"), is_("already_cached"), is_("skipped"), is_("failed"))
