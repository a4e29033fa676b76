"""The registered queries of this subpackage: thin projections of the operators' results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import bpe, clusters, exact, near, packing, pii, quality, ranked, records, repeats, shards, template, warc
from panelmark.llm.common import table
from panelmark.session import fresh_dir


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, percent=85)
    return rows.withColumnRenamed("id", "doc_id")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = pii.fit_models(docs, "doc_id", "text")
    found = pii.find_spans(docs, models, "text", F.col("doc_id"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(pii.written(F.col("base")), "utf-8"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write_warc(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    # payloads are decoded for responses alone; of revisits the headers say all that is asked
    held = warc.read_warc(spark, folder).filter("record_type = 'response'")
    again = warc.read_warc(spark, folder, payload=False).filter("record_type = 'revisit'")
    return held.select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.drop("ids").withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", digests=True)
    return rows.withColumnRenamed("id", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    rows = quality.judged(docs, rules, "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), *quality.COUNTS[:5], "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.interleaved_shards(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "token-records")
    records.write_records(table(spark, sf_dir, "documents"), "doc_id", "text", folder, end_id=2)
    return records.read_records(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extracted(table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_personal_data, op3_warc, op4_packing, op5_exact_dedup, op6_quality, op7_sharding, op8_bpe, op9_token_records, op10_html_text, op11_centroid_clusters, op12_ranked_search, op13_substring_dedup)}

_HERE = Path(__file__).parent
SQL = {p.stem: p.read_text(encoding="utf-8") for p in sorted((_HERE / "sql").glob("*.sql"))}
