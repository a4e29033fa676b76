"""Entity and indicator tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.sources.reference import ADVANCED

# Words that name a kind of number, dropped once from the end of a token.
TRAILING_QUALIFIERS = [
    "rate", "rates", "ratio", "level", "levels", "index", "data", "figures", "statistics", "stats",
    "numbers", "percentage", "percent", "value", "values",
]


def iso3(raw: Column) -> Column:
    """Upper-case three-letter code, or null for any other shape."""
    code = F.upper(F.trim(raw))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def code_or_fallback(primary: Column, other: Column) -> Column:
    return F.coalesce(iso3(primary), F.upper(F.trim(F.coalesce(other, F.lit("")))))


def to_iso3(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Add ``entity`` from a two-letter code; null where the index does not know it."""
    return df.withColumn("_iso2", F.upper(F.trim(F.col(column)))).join(
        index.select(F.col("iso2").alias("_iso2"), "entity"), "_iso2", "left").drop("_iso2")


def normalise_token(raw: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_qualifier(token: Column) -> Column:
    """Token without one trailing qualifier word; empty when there is none to drop."""
    head = F.regexp_extract(token, "^(.+)_([^_]*)$", 1)
    tail = F.regexp_extract(token, "^(.+)_([^_]*)$", 2)
    return F.when((head != "") & tail.isin(TRAILING_QUALIFIERS), head).otherwise(F.lit(""))


def income_group(raw: Column) -> Column:
    """Income label; placeholder labels and blanks become null."""
    return F.when(~F.trim(raw).isin("Aggregates", "Not classified", ""), F.trim(raw))


def imf_class(entity: Column, income: Column) -> Column:
    return F.when(entity.isin(ADVANCED), F.lit("Advanced")).when(
        income == "Low income", F.lit("Developing")).otherwise(F.lit("Emerging"))


def is_missing(raw: Column, *sentinels: str) -> Column:
    """Null, blank, or one of the provider's spellings of nothing (any case)."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return text.isin("", *[s.lower() for s in sentinels])
