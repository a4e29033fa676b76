"""Shards that all have the corpus's mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import staged

#: Rows that one ordered bucket holds on average; buckets number 65536 at most.
BUCKET_ROWS = 4096


def _bits(rows: int) -> int:
    return min(16, max(0, (rows // BUCKET_ROWS).bit_length()))


def interleaved_shards(df: DataFrame, id_col: str, text_col: str, source_col: str, shards: int = 24, seed: str = "mix") -> DataFrame:
    """(id, source, size, text_crc32, rank, fraction, shard, slot): law ``rows``.

    Rows are shuffled within each source by a seeded MD5 of (id, text checksum) and
    ranked; sorting all rows by (rank - 1/2) / rows of the source lays the sources
    evenly through one order, and equal cuts of it give shards whose counts differ by at
    most one and whose mixture is the corpus's. Strata are the sources; equal texts are
    not held together, since a hot text may exceed a shard.

    No rank needs a whole source in one task: an MD5 is uniform, so its leading bits deal
    a source into even buckets, counted with partial sums, and a row's rank is its place
    in its bucket plus the earlier buckets' counts. The order of fractions is cut the
    same way. Null sources are one stratum of their own, null texts have no bytes, null
    ids and repeated rows are rows like any other (identical ones are interchangeable);
    no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bytes_ = F.encode(text, "utf-8")
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    stratum = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")))
    rows = staged(rows.select("*", stratum.alias("stratum"), mixed.alias("mixed")), "shard-rows")
    total = rows.count()
    bits = _bits(total)

    leading = F.conv(F.substring("mixed", 1, 4), 16, 10).cast("long")
    dealt = rows.withColumn("bucket", F.shiftright(leading, 16 - bits))
    counts = dealt.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "stratum", "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("of_source"),
    )
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("mixed", F.asc_nulls_first("id"), "size"))
    ranked = dealt.withColumn("place", place).join(counts, ["stratum", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("of_source"))
    ranked = staged(ranked.select("id", "source", "stratum", "size", "text_crc32", "rank", "fraction"), "shard-ranked")

    cut = ranked.withColumn("bucket", F.floor(F.col("fraction") * (1 << bits)).cast("long"))
    counts = cut.groupBy("bucket").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 65536 buckets at most
    counts = counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", "rank"))
    placed = cut.withColumn("place", place).join(counts, "bucket").withColumn("at", F.col("before") + F.col("place") - 1)
    n = max(total, 1)
    shard = F.expr(f"cast(at * {shards} div {n} as int)")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.expr(f"at - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}"))
        .select("id", "source", "size", "text_crc32", "rank", "fraction", "shard", "slot")
    )
