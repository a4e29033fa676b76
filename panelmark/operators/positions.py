"""Exact row numbers and ranks that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a value's size between two powers of two.
STEPS = 64
#: A run of like values with more rows is cut further; characters of the two digits it is cut by.
LARGEST, DIGIT = 1 << 20, 3


def _runs(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_sign`` and ``_step``. A value's sign and the whole steps of its logarithm grow with it, so they
    cut a group into runs in order: the same ones each time the plan runs, without a sample or a stored copy."""
    number = F.col(value).cast("double")
    sign = F.when(F.isnan(number), F.lit(2)).otherwise(F.signum(number).cast("int"))
    step = F.coalesce(F.floor(F.log2(F.abs(number)) * STEPS), F.lit(0))
    return df.withColumn("_sign", F.coalesce(sign, F.lit(-2))).withColumn("_step", F.when(number < 0, -step).otherwise(step))


def _rows_before(counts: DataFrame, within: list[str], order: list[Column], name: str, count: str = "_size") -> DataFrame:
    """Adds how many rows come before each counted one among those equal in ``within``."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(count).over(before), F.lit(0)))


def split_row_number(df: DataFrame, by: list[str], value: str, ties: list[str], name: str, descending: bool = True,
                     largest: int = LARGEST) -> DataFrame:
    """``row_number`` over ``by`` ordered by ``value`` (then ``ties``, ascending), for groups of any size.

    Runs of like values are counted with partial sums; a row's number is its place in its run
    plus the rows of earlier runs. A run of more than ``largest`` rows, such as one value that a third of
    all rows share, is cut by the value itself and then by two digits of the first tie, its
    first and its next three characters, each counted the same way. So a task holds one short
    run, or the rows that are equal in all of that.
    """
    cut = [*by, "_sign", "_step"]
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sized = _runs(df, value).groupBy(*cut).agg(F.count("*").alias("_size"))
    sized = _rows_before(sized, by, [way("_sign"), way("_step")], "_before")
    runs = _runs(df, value).join(sized, cut)
    large = F.col("_size") > largest
    tie = F.coalesce(F.col(ties[0]).cast("string"), F.lit("")) if ties else F.lit("")
    # nulls have a run of their own, so any number may stand for them in it
    deep = {"_value": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_one": F.substring(tie, 1, DIGIT), "_two": F.substring(tie, DIGIT + 1, DIGIT)}
    runs = runs.select("*", *(F.when(large, c).alias(n) for n, c in deep.items()))
    counts = runs.where(large).groupBy(*cut, *deep).agg(F.count("*").alias("_rows"))
    # rows of smaller values in the run, of smaller first digits under the value, of smaller second digits under that
    ones = counts.groupBy(*cut, "_value", "_one").agg(F.sum("_rows").alias("_rows"))
    values = ones.groupBy(*cut, "_value").agg(F.sum("_rows").alias("_rows"))
    values = _rows_before(values, cut, [way("_value")], "_b1", "_rows").drop("_rows")
    ones = _rows_before(ones, [*cut, "_value"], [F.col("_one").asc()], "_b2", "_rows").drop("_rows")
    twos = _rows_before(counts, [*cut, "_value", "_one"], [F.col("_two").asc()], "_b3", "_rows").drop("_rows")
    inside = twos.join(ones, [*cut, "_value", "_one"]).join(values, [*cut, "_value"]).select(
        *cut, *deep, (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_inside"))
    runs = runs.join(inside, [*cut, *deep], "left")
    place = F.row_number().over(Window.partitionBy(*cut, *deep).orderBy(way(value), *ties))
    number = F.col("_before") + F.coalesce("_inside", F.lit(0)) + F.col("_at")
    return runs.withColumn("_at", place).withColumn(name, number.cast("int")).drop("_sign", "_step", "_at", "_before", "_size", "_inside", *deep)


def values_at(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): the value of rank floor(share * n) + 1, n at most, in ascending order.

    A first count tells which run of like values holds a rank, a second one counts the values of these
    runs alone; no row is numbered.
    """
    cut = [by, "_sign", "_step"]
    runs = _runs(df, value)
    sized = _rows_before(runs.groupBy(*cut).agg(F.count("*").alias("_size")), [by], [F.col("_sign").asc(), F.col("_step").asc()], "_before")
    totals = sized.groupBy(by).agg(F.sum("_size").alias("_n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.least(F.floor(F.lit(p) * F.col("_n")) + 1, F.col("_n")).alias("rank")) for k, p in shares.items()]))
    ranks = totals.select(by, wanted.alias("w")).select(by, "w.share", "w.rank")
    held = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_size"))
    holding = sized.join(ranks, by).where(held).select(*cut, "share", (F.col("rank") - F.col("_before")).alias("_rank"))
    near = runs.join(holding.select(*cut).distinct(), cut, "left_semi").groupBy(*cut, F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    near = _rows_before(near, cut, [F.col("_value").asc()], "_b", "_rows")
    hit = near.join(holding, cut).where((F.col("_rank") > F.col("_b")) & (F.col("_rank") <= F.col("_b") + F.col("_rows")))
    return hit.groupBy(by).agg(*[F.max(F.when(F.col("share") == k, F.col("_value"))).alias(k) for k in shares])
