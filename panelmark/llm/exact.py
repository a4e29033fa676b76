"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmark.llm.common import staged

#: Characters of the prefix that the second step hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space (a lone space is left as it is); null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_duplicates(df: DataFrame, id_col: str, text_col: str, digests: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept[, text_sha256]), one row for each row of ``df``.

    Rows whose normalised text no other row shares are settled by length or by the hash
    of a short prefix; only the others' texts are hashed whole. The three steps work on
    narrow rows and count with partial sums, so that a group of any size costs one row a
    task; groups are joined back to their rows on a key that may be hot, which Spark's
    skew handling splits.

    The row with the smallest id stays; null ids count as largest. Of rows repeated under
    that id one stays. Null text is empty, and empty texts equal each other. With
    ``digests`` the SHA-256 of every row's text is returned, which leaves no text unread.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"))
    first = [F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")]
    narrow = staged(source.select("id", *first), "exact-narrow")
    lengths = narrow.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # counted before the join, so that a frequent length is no more rows than it has prefixes
    counted = narrow.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"))
    prefixes = staged(counted.join(lengths, "n_bytes", "left_semi").filter("n > 1").drop("n"), "exact-prefixes")
    rivals = narrow.join(prefixes, ["n_bytes", "prefix"], "left_semi")
    if digests:  # all are asked for; those without a rival take no further part
        hashed = staged(source.select("id", *first, F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256")), "exact-hashed")
    else:
        wanted = rivals.select(F.col("id").alias("wanted")).distinct()
        hashed = staged(
            source.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
            .select("id", *first, F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256")),
            "exact-hashed",
        )
    key = ["n_bytes", "prefix", "text_sha256"]
    groups = hashed.groupBy(*key).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    if digests:
        groups = groups.join(prefixes, ["n_bytes", "prefix"], "left_semi")
    groups = staged(groups, "exact-groups")  # a side read as it lies lets Spark split a hot key of the other
    joined = staged(hashed.join(groups, key, "left"), "exact-joined")  # else numbering would hold the join to its key
    grouped = F.col("group_size").isNotNull()
    mine = F.col("id").eqNullSafe(F.col("keep_id"))
    # only rows under the smallest id of a group are numbered: the others are not kept anyway
    stays = joined.filter(grouped & mine)
    turn = Window.partitionBy(*key).orderBy(F.lit(1))
    stays = stays.withColumn("kept", F.row_number().over(turn) == 1)
    rest = joined.filter(~(grouped & mine)).withColumn("kept", ~grouped)
    out = stays.unionByName(rest).select(
        "id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        *(["text_sha256"] if digests else []),
    )
    if digests:
        return out
    known = hashed.select(F.col("id").alias("known")).distinct()
    alone = narrow.join(known, F.col("id").eqNullSafe(F.col("known")), "left_anti")
    return out.unionByName(
        alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    )
