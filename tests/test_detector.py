"""The detector's running median of moves, whatever batches and partitions bring the rows."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from panelmark.operators.anomaly import Moves, detect_anomalies


def test_running_median_of_moves():
    rng = random.Random(4)
    moves, seen = Moves(), []
    assert moves.median() is None
    for _ in range(60):
        some = [rng.choice([0.0, 0.0, rng.random(), 2.0]) for _ in range(rng.randint(0, 4))]
        moves.add(np.array(some))
        seen += [x for x in some if x > 0]
        if rng.random() < 0.5:
            assert moves.median() == (statistics.median(seen) if seen else None)


@pytest.fixture(scope="module")
def stepped():
    """Flat series that step now and then by small and large amounts."""
    rng, rows = random.Random(9), []
    for k in range(12):
        value = 5.0 + k
        for i in range(rng.randint(1, 160)):
            if rng.random() < 0.08:
                value += rng.choice([0.25, 0.25, -0.25, 3.0, 9.0])
            rows.append((f"s{k % 3}", k, dt.date(1990, 1, 1) + dt.timedelta(days=31 * i), value))
    return rows


def breaks(rows, window=12, min_obs=8):
    """Steps out of flat windows that are large beside the median of all earlier moves."""
    out, series = set(), {}
    for a, b, date, value in rows:
        series.setdefault((a, b), []).append((date, value))
    for key, points in series.items():
        for i, (date, value) in enumerate(points):
            prior = [v for _, v in points[max(0, i - window) : i]]
            if i < min_obs or len(set(prior)) != 1 or value == prior[0]:
                continue
            moves = [abs(y - x) for (_, x), (_, y) in zip(points[: i - 1], points[1:i]) if x != y]
            if not moves or abs(value - prior[0]) >= 3 * statistics.median(moves):
                out.add((*key, date))
    return out


@pytest.mark.parametrize("batch, partitions", [(10_000, 1), (1, 3), (7, 1), (13, 4)])
def test_breaks_over_batches(spark, stepped, batch, partitions):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(batch))
    try:
        df = spark.createDataFrame(stepped, "a string, b int, date date, value double").repartition(partitions)
        got = {(r["a"], r["b"], r["date"]) for r in detect_anomalies(df, ["a", "b"]).where("deviation_type = 'structural_break'").collect()}
    finally:
        spark.conf.set(setting, before)
    want = breaks(stepped)
    assert got == want and len(want) > 5


def test_one_ordered_pass_over_one_shuffle(spark, stepped):
    df = spark.createDataFrame(stepped, "a string, b int, date date, value double")
    plan = detect_anomalies(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Window [") == 2 and plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("- Sort [") == 1
