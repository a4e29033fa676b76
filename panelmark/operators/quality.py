"""Data-quality rules over the catalog and the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.operators.latest import describe, describe_latest
from panelmark.sources.reference import VOCABULARIES


def check_catalog(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """violations(rule, subject, detail): words outside their vocabulary, concepts
    without exactly one primary, series with data but no classification, codes whose
    frequency differs between sources."""
    subject = F.concat_ws("/", "source", "indicator_code").alias("subject")
    words = catalog.select(subject, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("word"),
                 (F.col(c).isNotNull() & ~F.col(c).isin(allowed)).alias("bad")) for c, allowed in VOCABULARIES.items()
    ])).alias("w")).where("w.bad").select(
        F.lit("vocabulary").alias("rule"), "subject", F.concat_ws("=", "w.column", "w.word").alias("detail"))
    primaries = catalog.where("concept IS NOT NULL").groupBy("concept").agg(F.count_if("is_primary").alias("n")).where(
        "n <> 1").select(F.lit("one_primary").alias("rule"), F.col("concept").alias("subject"), F.col("n").cast("string").alias("detail"))
    columns = ["concept", *VOCABULARIES]
    held = catalog.join(facts.select("source", "indicator_code"), ["source", "indicator_code"], "left_semi")
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    unclassified = held.select(subject, gaps.alias("gaps")).where(F.size("gaps") > 0).select(
        F.lit("unclassified").alias("rule"), "subject", F.concat_ws(",", "gaps").alias("detail"))
    mixed = catalog.groupBy("indicator_code").agg(F.countDistinct("frequency").alias("n")).where("n > 1").select(
        F.lit("mixed_frequency").alias("rule"), F.col("indicator_code").alias("subject"), F.col("n").cast("string").alias("detail"))
    return words.unionAll(primaries).unionAll(unclassified).unionAll(mixed)


def check_views(facts: DataFrame, catalog: DataFrame, sources: DataFrame, countries: DataFrame) -> DataFrame:
    """One row of counts that must agree: non-null facts and described rows, series and latest rows."""
    def count(df, label):
        return df.agg(F.count("*").alias("n")).select(F.lit(label).alias("t"), "n")

    held = facts.where(F.col("value").isNotNull())
    parts = [count(held, "facts"), count(describe(facts, catalog, sources, countries), "observations"),
             count(held.select("entity", "indicator_code").distinct(), "series"),
             count(describe_latest(facts, catalog, sources, countries), "latest")]
    merged = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    wide = merged.agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in ("facts", "observations", "series", "latest")])
    return wide.withColumn("agree", (F.col("facts") == F.col("observations")) & (F.col("series") == F.col("latest")))


def backfill_metadata(catalog: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata written onto the catalog rows of the same source and code; others stay."""
    columns = [c for c in meta.columns if c not in ("source", "indicator_code")]
    new = meta.select("source", "indicator_code", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = catalog.join(new, ["source", "indicator_code"], "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in catalog.columns])
