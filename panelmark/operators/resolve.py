"""Tables of requested names to indicators and entities.

The name tables are small and joined on equality, so a request table of any size is
read once and, while they are below Spark's broadcast size, never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.functions.codes import iso3, normalise_token, strip_qualifier


_HIT = "struct<how:string,code:string,candidates:array<string>,note:string>"


def name_table(metadata: DataFrame, aliases: DataFrame, not_held: DataFrame) -> DataFrame:
    """(key, hit) of every way to name an indicator, each at most once: ``=`` an exact code, ``~`` a code in any case,
    ``:`` a concept, an alias or an ambiguous wording, ``!`` what is known not to be held.

    One pass over the metadata writes all its names out; the indicator to use per name is primary first, then of the
    widest coverage. A name that is several things counts as the first of concept, alias, ambiguous.
    """
    row = lambda key, way, position: F.struct(key.alias("key"), F.lit(way).alias("way"), position.alias("position"))
    zero = F.lit(0)
    meant = aliases.groupBy("concept").agg(F.collect_list(F.struct("alias", "ambiguous", "position")).alias("_as"))
    names = metadata.join(meant, "concept", "left").select("is_primary", "country_count", "source", "indicator_code", F.explode(F.filter(F.concat(
        F.array(row(F.concat(F.lit("="), "indicator_code"), 0, zero), row(F.concat(F.lit("~"), F.lower("indicator_code")), 0, zero), row(F.concat(F.lit(":"), "concept"), 1, zero)),
        F.coalesce(F.transform("_as", lambda a: F.struct(
            F.concat(F.lit(":"), a["alias"]).alias("key"), F.when(a["ambiguous"], 3).otherwise(2).alias("way"), a["position"].alias("position"))),
            F.array().cast("array<struct<key:string,way:int,position:int>>"))), lambda n: n["key"].isNotNull())).alias("n"))
    order = F.struct((~F.col("is_primary")).alias("p"), (-F.col("country_count")).alias("c"), "source", "indicator_code")
    heads = names.groupBy("n.key", "n.way", "n.position").agg(F.min(order).alias("_h"))
    held = heads.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("way", "position", F.col("_h.indicator_code").alias("code")))).alias("_all"))
    held = held.select("key", F.get("_all", zero)["way"].alias("way"), "_all")
    note = not_held.select(F.concat(F.lit(":"), "alias").alias("key"), "note")
    several = F.transform(F.filter("_all", lambda x: x["way"] == 3), lambda x: x["code"])
    unclear = F.col("way") == 3
    hits = held.join(note, "key", "left").select("key", F.struct(
        F.when(F.col("way") == 0, F.when(F.col("key").startswith("="), "code").otherwise("folded_code")).otherwise(
            F.get(F.array(F.lit("concept"), F.lit("alias"), F.lit("ambiguous")), F.col("way") - 1)).alias("how"),
        F.when(~unclear, F.get("_all", zero)["code"]).alias("code"), F.when(unclear, several).alias("candidates"),
        F.when(unclear, F.col("note")).alias("note")).cast(_HIT).alias("hit"))
    none = F.lit(None).cast("string")
    missing = not_held.select(F.concat(F.lit("!"), "alias").alias("key"), F.struct(
        F.lit("none").alias("how"), none.alias("code"), F.lit(None).cast("array<string>").alias("candidates"), F.col("note").alias("note")).cast(_HIT).alias("hit"))
    return hits.unionByName(missing)


def resolve_indicators(requests: DataFrame, metadata: DataFrame, aliases: DataFrame, not_held: DataFrame,
                       token: str = "token") -> DataFrame:
    """requests with ``resolution`` struct(how, code, candidates, note).

    An exact code wins; then concept, alias, ambiguous wording; then the same without
    one trailing qualifier; then the code in any case; else what is known not to be held. All five are
    looked up in one table of names, which Spark brings to the requests while it is small.
    """
    names = name_table(metadata, aliases, not_held)
    raw = F.trim(F.coalesce(F.col(token), F.lit("")))
    norm = normalise_token(raw)
    ways = {"=": raw, ":": norm, "::": strip_qualifier(norm), "~": F.lower(raw), "!": norm}
    rows = requests.select(*requests.columns, *(F.concat(F.lit(mark[0]), of).alias(f"_k{i}") for i, (mark, of) in enumerate(ways.items())))
    for i in range(len(ways)):
        rows = rows.join(names.alias(f"n{i}"), F.col(f"_k{i}") == F.col(f"n{i}.key"), "left").drop(F.col(f"n{i}.key")).withColumnRenamed("hit", f"_h{i}")
    none = F.lit(None).cast("string")
    miss = F.struct(F.lit("none").alias("how"), none.alias("code"), F.lit(None).cast("array<string>").alias("candidates"), none.alias("note")).cast(_HIT)
    return rows.withColumn("resolution", F.coalesce(*(f"_h{i}" for i in range(len(ways))), miss)).select(*requests.columns, "resolution")


def resolve_entities(requests: DataFrame, countries: DataFrame, token: str = "token") -> DataFrame:
    """requests with ``entity`` and ``entity_name``: a three-letter code as it stands,
    else an exact name, else the lowest code among names starting with the token
    (four letters or more). Prefixes are written out per name and joined on equality."""
    names = countries.select(F.lower("entity_name").alias("_full"), "entity", "entity_name")
    full = names.groupBy("_full").agg(F.min(F.struct("entity", "entity_name")).alias("_by_name"))
    prefixes = names.select(
        F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.length("_full"), F.lit(4))),
                              lambda n: F.substr(F.col("_full"), F.lit(1), n))).alias("_prefix"), "entity", "entity_name")
    short = prefixes.where(F.length("_prefix") >= 4).groupBy("_prefix").agg(
        F.min(F.struct("entity", "entity_name")).alias("_by_prefix"))
    code = countries.select(F.col("entity").alias("_code"), F.struct("entity", "entity_name").alias("_by_code"))
    rows = (
        requests.withColumn("_t", F.trim(F.coalesce(F.col(token), F.lit("")))).withColumn("_code", iso3(F.col("_t")))
        .withColumn("_full", F.when(F.col("_code").isNull(), F.lower("_t"))).withColumn("_prefix", F.col("_full"))
        .join(code, "_code", "left").join(full, "_full", "left").join(short, "_prefix", "left")
    )
    hit = F.coalesce("_by_code", F.when(F.col("_code").isNotNull(), F.struct(
        F.col("_code").alias("entity"), F.lit(None).cast("string").alias("entity_name"))), "_by_name", "_by_prefix")
    return rows.withColumn("_hit", hit).select(*requests.columns, "_hit.entity", "_hit.entity_name")
