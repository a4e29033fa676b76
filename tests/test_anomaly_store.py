"""Stored anomalies follow what arrives: corrections retract, late rows count, explanations stay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelmark.operators import anomaly_store as N
from panelmark.operators.anomaly import detect_anomalies
from panelmark.operators.latest import newest
from panelmark.operators.versioned import VersionedTable

KEYS = ["name"]
SCHEMA = "name string, date date, value double, batch_id long"


def day(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_any_order_of_arrivals_equals_one_run(spark, tmp_path):
    """Late, corrected, withdrawn and repeated observations of wavy and of stepped series, in fourteen batches."""
    rng = random.Random(1)
    final, batches = {}, [[] for _ in range(14)]
    for name in "abcde":
        level = 5.0
        for i in range(90):
            level += rng.choice([0, 0, 0, 0, 0.5, 6]) if name in "ab" else rng.gauss(0, 1) + 30 * (rng.random() < 0.03)
            final[name, day(i)] = level
    for (name, date), value in final.items():
        first = min(13, max(0, (date - day(0)).days // 220 + rng.choice([0, 0, 0, 0, 2])))
        batches[first].append((name, date, value if rng.random() < 0.97 else value + 9, first))
        if batches[first][-1][2] != value:
            batches[13].append((name, date, value, 13))
    gone = [("c", day(40)), ("a", day(5))]
    batches[13] = [b for b in batches[13] if b[:2] not in gone] + [(*g, None, 13) for g in gone]
    batches[6] = []  # a batch without rows
    store, facts = f"file://{tmp_path}/store", VersionedTable(spark, f"file://{tmp_path}/facts")
    for number, batch in enumerate(batches):
        facts.append(spark.createDataFrame(batch, SCHEMA), number)
        now = newest(facts.read(), ["name", "date"], [-F.col("batch_id")])
        N.refresh_store(spark, now, store, KEYS, dt.datetime(2020, 1, 1 + number))
    whole = detect_anomalies(newest(facts.read(), ["name", "date"], [-F.col("batch_id")]), KEYS)
    columns = ["name", "date", "value", "z_score", "deviation_type"]
    assert rows(N.read_anomalies(spark, store, KEYS), *columns) == rows(whole, *columns)
    assert whole.count() > 10 and VersionedTable(spark, store).folders() <= 7


def test_explanations_and_untouched_series(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    assert N.read_anomalies(spark, store, KEYS) is None
    flat = lambda name, spike, batch: [(name, day(i), 1.0 + i * 0.01 + (i % 3) * 0.1 + (40.0 if i == spike else 0), batch) for i in range(30)]
    first = spark.createDataFrame(flat("x", 20, 0) + flat("y", 22, 0), SCHEMA)
    assert N.refresh_store(spark, first, store, KEYS, dt.datetime(2020, 1, 1)) == 0
    N.explain(spark, store, spark.createDataFrame([("x", day(20), "strike"), ("y", day(22), "war"), ("z", day(1), "none")], "name string, date date, explanation string"), KEYS)
    at = VersionedTable(spark, store).version()
    assert N.refresh_store(spark, first, store, KEYS, dt.datetime(2020, 1, 2)) == 0 and VersionedTable(spark, store).version() == at
    mended = newest(first.unionByName(spark.createDataFrame([("x", day(20), 1.3, 1), ("x", day(30), 1.4, 1)], SCHEMA)), ["name", "date"], [-F.col("batch_id")])
    assert N.refresh_store(spark, mended, store, KEYS, dt.datetime(2020, 1, 3)) == 1
    held = {(r["name"], r["date"]): (r["explanation"], r["detected_at"].day) for r in N.read_anomalies(spark, store, KEYS).collect()}
    assert held[("y", day(22))] == ("war", 1) and ("x", day(20)) not in held
