"""Trend-residual anomaly detection and scope refresh.

Each scored row sees its (at most ``window``) predecessors as an array made by one
ordered window per series; fit, spread, fences and tests are row-local expressions.
What a break is measured by, the median of all earlier moves, is kept along the series in
the same pass. A series is bounded by its natural key: one row per date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the detector.
MAD_TO_SIGMA = 1.4826
IQR_MULTIPLE = 1.5
BREAK_MULTIPLE = 3.0
FLAT_TOLERANCE = 1e-9
SIGMA_EPSILON = 1e-6


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def sorted_median(items: Column) -> Column:
    """Median of an already sorted array."""
    n = F.size(items)
    return (F.get(items, F.floor((n - 1) / 2).cast("int")) + F.get(items, F.floor(n / 2).cast("int"))) / 2


def _points(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Observations with a value and a whole key."""
    held = F.col("value").isNotNull()
    for key in keys:
        held = held & F.col(key).isNotNull()
    return df.select(*keys, "date", "value", *more).where(held)


def _trend_columns(df: DataFrame, keys: list[str], window: int, since: str | None = None) -> DataFrame:
    """Prior values of each row with least squares over them, on values and on logs.

    One ordered window per series. The fits come from the window itself, so the
    array expressions below read ready columns and stay linear in the window size. Rows
    before the day in column ``since`` get no prior values and are not scored.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    prior = w.rowsBetween(-window, -1)
    rows = _points(df, keys, *([since] if since else []))
    rows = rows.withColumn("_index", F.row_number().over(w) - 1).withColumn(
        "_ln", F.when(F.col("value") > 0, F.ln("value")))
    fit = lambda f, y: f(F.col(y), F.col("_index").cast("double")).over(prior)
    values = F.collect_list("value").over(prior)
    return rows.select(
        "*", (F.when(F.col("date") >= F.col(since), values) if since else values).alias("_prior"),
        F.min("value").over(prior).alias("_lowest"),
        fit(F.regr_slope, "value").alias("_slope"), fit(F.regr_intercept, "value").alias("_base"),
        fit(F.regr_slope, "_ln").alias("_ln_slope"), fit(F.regr_intercept, "_ln").alias("_ln_base"),
    )


def local_trend(df: DataFrame) -> DataFrame:
    """Prediction and residuals, on logs when all prior values are positive."""
    alone = F.size("_prior") < 2
    first = F.get("_prior", F.lit(0))
    slope = F.when(alone, F.lit(0.0)).when(F.col("_log"), F.col("_ln_slope")).otherwise(F.col("_slope"))
    start = F.when(alone, F.when(F.col("_log"), F.ln(first)).otherwise(first)).when(
        F.col("_log"), F.col("_ln_base")).otherwise(F.col("_base"))
    return (
        df.withColumn("_log", F.col("_lowest") > 0)
        .withColumn("_n", F.size("_prior"))
        .withColumn("_b", slope).withColumn("_a", start)
        .withColumn("_y", F.when(F.col("_log"), F.transform("_prior", lambda v: F.ln(v))).otherwise(F.col("_prior")))
        .withColumn("_resid", F.transform(
            "_y", lambda y, x: y - (F.col("_a") + F.col("_b") * (F.col("_index") - F.col("_n") + x))))
        .withColumn("_ahead", F.col("_a") + F.col("_b") * F.col("_index"))
        .withColumn("predicted", F.when(F.col("_log"), F.exp("_ahead")).otherwise(F.col("_ahead")))
    )


def robust_sigma(df: DataFrame) -> DataFrame:
    """Scaled median absolute residual; a clean fit falls back to the deviation of its
    residuals, whose mean is zero by construction of the fit."""
    return (
        df.withColumn("_size", F.array_sort(F.transform("_resid", lambda r: F.abs(r))))
        .withColumn("_mad", sorted_median(F.col("_size")))
        .withColumn("_sd", F.sqrt(_total(F.transform("_resid", lambda r: r * r)) / F.nullif(F.col("_n"), F.lit(0))))
        .withColumn("sigma", F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_sd")))
    )


def fences(df: DataFrame) -> DataFrame:
    """Quartile fences from the medians of the two halves; an odd middle value belongs to neither."""
    half = F.floor(F.col("_n") / 2).cast("int")
    df = (
        df.withColumn("_sorted", F.array_sort("_resid"))
        .withColumn("_low", F.slice("_sorted", F.lit(1), half))
        .withColumn("_high", F.slice("_sorted", F.col("_n") - half + 1, half))
        .withColumn("_q1", sorted_median(F.col("_low"))).withColumn("_q3", sorted_median(F.col("_high")))
    )
    reach = (F.col("_q3") - F.col("_q1")) * IQR_MULTIPLE
    return df.withColumn("fence_low", F.col("_q1") - reach).withColumn("fence_high", F.col("_q3") + reach)


def _scored(df: DataFrame, keys: list[str], window: int, since: str | None = None) -> DataFrame:
    """Every row with its trend prediction, spread, residual and fences, as far as its history goes."""
    scored = fences(robust_sigma(local_trend(_trend_columns(df, keys, window, since))))
    scale = F.when(F.col("_log"), F.lit(1.0)).otherwise(F.greatest(F.abs("predicted"), F.lit(1.0)))
    both_positive = F.col("_log") & (F.col("value") > 0) & (F.col("predicted") > 0)
    relative = F.ln(F.when(both_positive, F.col("value"))) - F.ln(F.when(both_positive, F.col("predicted")))
    return (
        scored.withColumn("flat", F.col("sigma") <= scale * SIGMA_EPSILON)
        .withColumn("residual", F.when(both_positive, relative).otherwise(F.col("value") - F.col("predicted")))
        .withColumn("z", F.when(~F.col("flat"), F.col("residual") / F.nullif(F.col("sigma"), F.lit(0.0))))
        .withColumn("_moved", F.abs(F.col("value") - F.col("predicted"))
                    > F.greatest(F.abs("predicted"), F.lit(1.0)) * FLAT_TOLERANCE)
    )


def _enough(min_obs: int) -> Column:
    return (F.col("_index") >= min_obs) & (F.size("_prior") >= 1)


def score_windows(df: DataFrame, keys: list[str], window: int = 12, min_obs: int = 8) -> DataFrame:
    """Every row with enough history, with its trend prediction, spread, residual and fences."""
    return _scored(df, keys, window).where(_enough(min_obs))


class Moves:
    """The non-zero moves of a series so far, in order of size; new ones are sorted in when the median is asked."""

    def __init__(self):
        self.sorted, self.new = np.zeros(0), []

    def add(self, steps: np.ndarray) -> None:
        steps = steps[(steps > 0) | np.isnan(steps)]
        if len(steps):
            self.new.append(steps)

    def median(self) -> float | None:
        if self.new:
            more = np.sort(np.concatenate(self.new))
            self.sorted, self.new = np.insert(self.sorted, np.searchsorted(self.sorted, more), more), []
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2 if n else None


def _large_breaks(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Judged rows in the order of their series to the anomalies among them.

    A break must be large beside the median of its series' own earlier moves, which is kept
    while the rows stream by: one series is held at a time, and only its moves.
    """
    out = [*keys, "date", "value", "z_score", "deviation_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last, moves = None, np.nan, Moves()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != open_
            for k in keys:
                column = batch.column(k)
                new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
            value, predicted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "predicted"))
            step = np.abs(np.diff(value, prepend=last))
            step[new] = 0
            starts = np.flatnonzero(new)
            kinds = batch.column("deviation_type")
            broke = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(kinds, "structural_break"), False)))
            stays = np.asarray(kinds.is_valid()).copy()
            seen = 0  # rows before it are in ``moves`` as far as they belong to its series
            for row in broke.tolist():
                begin = starts[np.searchsorted(starts, row, "right") - 1] if len(starts) and starts[0] <= row else 0
                if begin > seen or (seen == 0 and new[0]):
                    moves, seen = Moves(), begin
                moves.add(step[seen:row])
                seen = row
                typical = moves.median()
                stays[row] = typical is None or abs(value[row] - predicted[row]) >= typical * BREAK_MULTIPLE
            begin = starts[-1] if len(starts) else 0
            if begin > seen or (seen == 0 and new[0]):
                moves, seen = Moves(), begin
            moves.add(step[seen:])
            open_, last = tuple(batch.column(k)[n - 1].as_py() for k in keys), value[-1]
            yield batch.select(out).filter(pa.array(stays))

    schema = StructType([f for f in judged.schema.fields if f.name in out])
    return judged.mapInArrow(run, schema)


def detect_anomalies(
    df: DataFrame, keys: list[str], threshold: float = 2.0, window: int = 12, min_obs: int = 8, since: str | None = None
) -> DataFrame:
    """keys, date, value, z_score (4 decimals, null for a structural break), deviation_type.

    One ordered window per series, one scoring of its rows. Breaks out of a flat stretch must be
    large beside the series' own earlier moves. With ``since``, a date column, only rows from that
    day on are scored; earlier ones are their history.
    """
    scored = _scored(df, keys, window, since)
    outside = (F.col("residual") < F.col("fence_low")) | (F.col("residual") > F.col("fence_high"))
    kind = F.when(~F.col("flat") & (F.abs("z") >= threshold) & outside,
                  F.when(F.col("z") > 0, F.lit("spike")).otherwise(F.lit("drop"))
                  ).when(F.col("flat") & F.col("_moved"), F.lit("structural_break"))
    judged = scored.withColumn("deviation_type", F.when(_enough(min_obs), kind)).select(
        *keys, "date", "value", F.when(~F.col("flat"), F.round("z", 4)).alias("z_score"), "deviation_type", "predicted")
    # all rows of a series are in one partition by the window; the sort is dropped where they are in order already
    return _large_breaks(judged.sortWithinPartitions(*keys, "date"), keys)


def refresh_anomalies(old: DataFrame, found: DataFrame, keys: list[str], now, scope: Column | None = None) -> DataFrame:
    """Table after re-scoring a scope, with what happened to each row.

    Re-detected rows keep their explanation, rows of the scope that were not found
    again are ``retracted`` (drop them when writing), rows outside it are ``kept``.
    """
    scope = F.lit(True) if scope is None else scope
    natural = [*keys, "date"]
    before = old.where(scope).select(*natural, F.col("explanation"), F.col("value").alias("_old_value"),
                                     F.col("z_score").alias("_old_z"), F.col("deviation_type").alias("_old_type"),
                                     F.col("detected_at").alias("_old_at"), F.lit(True).alias("_was"))
    after = found.withColumn("_is", F.lit(True))
    joined = before.join(after, natural, "full")
    merged = joined.select(
        *natural,
        F.when(F.col("_is"), F.col("value")).otherwise(F.col("_old_value")).alias("value"),
        F.when(F.col("_is"), F.col("z_score")).otherwise(F.col("_old_z")).alias("z_score"),
        F.coalesce("deviation_type", "_old_type").alias("deviation_type"),
        "explanation",
        F.when(F.col("_is"), F.lit(now)).otherwise(F.col("_old_at")).alias("detected_at"),
        F.when(F.col("_is") & F.col("_was"), "updated").when(F.col("_is"), "inserted").otherwise("retracted").alias("change"),
    )
    outside = old.where(~scope).withColumn("change", F.lit("kept"))
    return merged.unionByName(outside)


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(
        F.count_if(F.col("change").isin("inserted", "updated")).alias("detected"),
        F.count_if(F.col("change") == "retracted").alias("retracted"),
        F.count_if(F.col("change") == "kept").alias("kept"),
    )
