"""Session settings, constant tables and durable intermediate results."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    named = {"spark.checkpoint.dir": shared} if shared else {}
    return (
        SparkSession.builder.config(map=named).master(f"local[{cores}]")
        .appName("panelmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the session names none, a folder in the warehouse: like the tables there, it
    is reached by every executor. A cluster whose warehouse is a folder of one machine has
    no such place and must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    home = spark.conf.get("spark.sql.warehouse.dir")
    of_one_machine = ":" not in home or home.startswith("file:")
    if of_one_machine and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no shared folder, and the warehouse is not one")
    return home.rstrip("/") + "/_work"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that several readers see the same rows."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns computed here and once.

    The optimizer pushes a filter below the projections that define its columns by
    repeating their expressions, which is ruinous for nested array expressions.
    Columns that come out of a generator are read by later filters as they are.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def constant(spark: SparkSession, schema: str, rows) -> DataFrame:
    """A fixed dimension as inline VALUES: its size is known, so joins to it are
    broadcast by the planner's own size check and need no hint."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
