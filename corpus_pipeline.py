"""Documents to packed training sequences, in five stages on Spark.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes
what a stage returns as Parquet to the shared folder and reads it again as the next one's
``docs``. All but the last return the columns of ``docs``, whatever they are, in their order.

1. quality: documents that fail the fixed rules or the trees fitted on ``labels`` go.
2. exact_dedup: of documents equal but for white space, that with the smallest id stays.
3. near_dedup: of documents linked by five-word shingles at a similarity of 0.8 or
   more, that with the smallest id stays.
4. personal_data: spans are replaced by the name of their kind in brackets; ``n_chars``,
   where there is such a column, follows the text.
5. packing: one row for each piece of a document, with its ids.

Null and empty texts have no words and go in the first stage. Rows without an id are
documents like any other; in the duplicate stages ids count as larger than none, and rows are
told apart by id and text. A row repeated with its id and text stays once. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import exact, near, packing, pii, quality
from panelmark.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules, "text")


def _key(id_: Column, text_mark: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), text_mark.cast("string")).alias("row_key")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(docs, "doc_id", "text", digests=True)
    gone = found.filter(~F.col("kept") & ~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = gone.select(_key(F.col("id"), F.col("text_sha256"))).distinct()
    mark = F.sha2(F.encode(exact.normalised(F.col("text")), "utf-8"), 256)
    keyed = docs.select(_key(F.col("doc_id"), mark), F.struct("*").alias("row"))
    return keyed.join(gone, "row_key", "left_anti").dropDuplicates(["row_key"]).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(docs, "doc_id", "text", words=5, percent=80)
    gone = found.filter(~F.col("kept")).select(_key(F.col("id"), F.col("text_key"))).distinct()
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(_key(F.col("doc_id"), mark), F.struct("*").alias("row"))
    return keyed.join(gone, "row_key", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = pii.fit_models(docs, "doc_id", "text")
    others = [c for c in docs.columns if c != "text"]
    found = pii.find_spans(docs, models, "text", F.struct(*others).alias("row"), F.col("text").isNull().alias("no_text"))
    clean = pii.redacted(found, "_text", "spans", "clean")
    text = F.when(~F.col("no_text"), F.col("clean"))
    of = {"text": text.alias("text"), "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars")}
    return clean.select(*(of[c] if c in of else F.col("row").getField(c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, "doc_id", "text", with_ids=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Fitted trees and tokenizer ids cannot be written in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
