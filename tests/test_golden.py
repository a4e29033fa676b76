"""Cases with known answers: detector, periods, validation, forecasting, labels, readers."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.functions import codes as C
from panelmark.functions import labels as B
from panelmark.functions import periods as P
from panelmark.operators import forecast as O
from panelmark.operators import ingest as I
from panelmark.operators import models as M
from panelmark.operators import sinks as K
from panelmark.operators.anomaly import detect_anomalies, refresh_anomalies
from panelmark.operators.charts import nice_domain
from panelmark.operators.positions import split_row_number, values_at
from panelmark.operators.query import query_observations
from panelmark.sources import payloads as Y

JITTER = [1.0, 1.02, 0.99, 1.01, 0.98, 1.03, 1.0, 0.99, 1.02, 0.98]


def compounding(years):
    return [1000.0 * 1.05 ** y * JITTER[y % 10] for y in range(years)]


SERIES = {
    "spike": [2.0, 2.2, 1.8, 2.1, 1.9, 2.0, 2.3, 1.7, 2.0, 2.1, 40.0],
    "held": [4.25] * 12 + [12.0],
    "drop": [5.0, 5.1, 4.9, 5.0, 5.2, 4.8, 5.0, 5.1, 4.9, 5.0, -30.0],
    "stable": [3.0, 3.1, 2.9, 3.0, 3.2, 2.8, 3.0, 3.1, 2.9, 3.0, 3.05],
    "flat": [4.0] * 15,
    "volatile": [10.0, -8.0, 12.0, -6.0, 9.0, -11.0, 14.0, -7.0, 11.0, -9.0, 13.0, -8.0, 12.5],
    "contaminated": [2.0, 2.1, 1.9, 2.0, 500.0, 2.0, 2.1, 1.9, 2.0, 2.1, 300.0],
    "policy": [2.0, 2.0, 2.25, 2.25, 2.5, 2.5, 2.5, 2.25, 2.0, 2.0, 2.25, 2.5, 2.75, 2.75, 2.5, 2.25, 2.25, 2.0, 2.0, 2.25],
    "trend": compounding(40),
    "collapse": [*compounding(20), compounding(20)[-1] * 0.5],
    "tiny": [1.0],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, dt.date(2000 + i, 1, 1), v) for name, vs in SERIES.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows[::-1], "name string, date date, value double")
    out = {}
    for r in detect_anomalies(df, ["name"]).collect():
        out.setdefault(r["name"], []).append((r["value"], r["deviation_type"], r["z_score"]))
    return out


def test_detector_cases(found):
    assert [f[:2] for f in found["spike"]] == [(40.0, "spike")]
    assert found["held"] == [(12.0, "structural_break", None)]
    assert [f[1] for f in found["drop"]] == ["drop"]
    assert found["drop"][0][2] < -1000  # a raw residual over a spread of logs
    assert not {"stable", "flat", "volatile", "trend", "tiny"} & set(found)
    assert 300.0 in [f[0] for f in found["contaminated"]]
    assert len(found.get("policy", [])) <= 1
    assert len(found["collapse"]) == 1 and found["collapse"][0][1] in ("drop", "structural_break")


def test_refresh_is_idempotent_and_retracts(spark):
    rows = [("a", dt.date(2000 + i, 1, 1), v) for i, v in enumerate(SERIES["spike"])]
    df = spark.createDataFrame(rows, "name string, date date, value double")
    hits = detect_anomalies(df, ["name"])
    old = hits.withColumn("explanation", F.lit("why")).withColumn("detected_at", F.lit(dt.datetime(2020, 1, 1)))
    stale = old.withColumn("date", F.lit(dt.date(1990, 1, 1)))
    once = refresh_anomalies(old.unionByName(stale), hits, ["name"], dt.datetime(2021, 1, 1))
    got = {(r["date"].year, r["change"], r["explanation"]) for r in once.collect()}
    assert got == {(2010, "updated", "why"), (1990, "retracted", "why")}
    again = refresh_anomalies(once.where("change <> 'retracted'").drop("change"), hits, ["name"], dt.datetime(2022, 1, 1))
    assert [r["change"] for r in again.collect()] == ["updated"]


def test_periods(spark):
    cases = {
        "2025": ("2025-01-01", "annual"), "2025M06": ("2025-06-01", "monthly"), "2025m6": ("2025-06-01", "monthly"),
        "2026-04": ("2026-04-01", "monthly"), "2025Q1": ("2025-01-01", "quarterly"), "2025-Q3": ("2025-07-01", "quarterly"),
        "2025q4": ("2025-10-01", "quarterly"), " 2025-06-15 ": ("2025-06-15", "daily"), "2025-6": ("2025-06-01", "monthly"),
        "2025-M12": ("2025-12-01", "monthly"),
        "": None, "garbage": None, "2025M13": None, "2025-02-30": None, "25": None, "2025Q5": None, "0000": None,
        "2025-1-01": None, "2025-00": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    for r in df.select("raw", P.parse_period(F.col("raw")).alias("p")).collect():
        want = cases.get(r["raw"])
        got = (str(r["p"]["date"]), r["p"]["frequency"]) if r["p"]["date"] else None
        assert got == want, r["raw"]
        assert (r["p"]["frequency"] is None) == (want is None)


def test_advance_rolls_over(spark):
    df = spark.createDataFrame([
        (dt.date(2025, 11, 1), "monthly", 3, dt.date(2026, 2, 1)), (dt.date(2025, 10, 1), "quarterly", 1, dt.date(2026, 1, 1)),
        (dt.date(2025, 6, 15), "annual", 2, dt.date(2027, 6, 1)), (dt.date(2025, 6, 15), None, 1, dt.date(2026, 6, 1))],
        "d date, f string, n int, want date")
    assert df.where(P.advance(F.col("d"), F.col("f"), F.col("n")) != F.col("want")).count() == 0


def _rules(spark):
    index = spark.createDataFrame([("FRO", "FO"), ("GRL", "GL")], "entity string, iso2 string")
    indicators = spark.createDataFrame(
        [("S", "percent_share", "%", None), ("C", "percent_change", "%", None), ("N", "count", None, None)],
        "indicator_code string, kind string, unit string, frequency string")
    return I.Rules("paged", "test", index, indicators)


def test_every_row_has_one_outcome(spark):
    rows = [
        (1, "GRL", None, "C", "2013", "8150"), (2, "GRL", None, "C", "2013", "3"), (3, "GRL", None, "S", "2013", "7e11"),
        (4, "GRL", None, "N", "2013", "-17"), (5, "EUU", None, "C", "2013", "3"), (6, "GRL", None, "", "2013", "3"),
        (7, "GRL", None, "C", "2014", None), (8, "GRL", None, "C", "soon", "3"), (9, "GRL", None, "C", "1799", "3"),
        (10, "GRL", None, "C", "2044", "3"), (11, "", "fro", "X", "2013", "2e200"), (12, None, None, "C", "2013", "3"),
        (13, "FRO", None, "C", "2013", "-Infinity"), (14, "FRO", None, "C", "2013", "n/a"),
    ]
    raw = spark.createDataFrame([(*r, None, None) for r in rows],
                                "ordinal long, entity_raw string, entity_alt string, indicator_raw string, period_raw string, "
                                "value_raw string, unit_raw string, name_raw string")
    accepted, rejected, skipped, summary = I.ingest_batch(raw, _rules(spark), dt.date(2026, 1, 1))
    assert {r["ordinal"] for r in accepted.collect()} == {1, 11}
    assert {r["ordinal"] for r in skipped.collect()} == {5, 7}
    kinds = {r["ordinal"]: r["error_type"] for r in rejected.collect()}
    assert kinds == {2: "DuplicateRecord", 3: "ValidationError", 4: "ValidationError", 6: "NormalizationError",
                     8: "NormalizationError", 9: "ValidationError", 10: "ValidationError", 12: "NormalizationError",
                     13: "ValidationError", 14: "NormalizationError"}
    raw_records = {r["ordinal"]: r["raw"] for r in rejected.collect()}
    assert tuple(raw_records[12])[:5] == (None, None, "C", "2013", "3") and tuple(raw_records[4])[:5] == ("GRL", None, "N", "2013", "-17")
    s = summary.first()
    assert (s["fetched"], s["inserted"], s["failed"], s["skipped"], s["status"]) == (14, 2, 10, 2, "partial")


def test_stored_facts_are_merged_by_partition(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "source string, indicator_code string, entity string, date date, value double"
    first = spark.createDataFrame([("s", "i", "AAA", dt.date(2000, 1, 1), 1.0), ("s", "i", "AAA", dt.date(2001, 1, 1), 2.0)], schema)
    K.upsert_observations(spark, first, path)
    K.upsert_observations(spark, spark.createDataFrame(
        [("s", "i", "AAA", dt.date(2001, 1, 1), 5.0), ("s", "i", "BBB", dt.date(2001, 1, 1), 7.0)], schema), path)
    rows = {(r["entity"], r["year"]): r["value"] for r in K.read_observations(spark, path).collect()}
    assert rows == {("AAA", 2000): 1.0, ("AAA", 2001): 5.0, ("BBB", 2001): 7.0}


def test_error_rows_wrap_bare_values(spark):
    df = spark.createDataFrame([("x", "E", "m"), (None, "E", "m")], "raw string, error_type string, message string")
    assert [r["raw_record"] for r in K.error_rows(df, "r").collect()] == ['{"value":"x"}', None]


def test_csv_reader_keeps_line_breaks_and_drops_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿FREQ,REF_AREA,NOTE,OBS_VALUE\nM,US,"one, two\nthree ""q""",4.5\nM,XM,plain,NaN\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("<?xml version='1.0'?>\n<error>none</error>\n")
    (tmp_path / "c.csv").write_text("")
    rows = Y.read_sdmx_csv(spark, str(tmp_path), ["FREQ", "REF_AREA", "NOTE", "OBS_VALUE"]).collect()
    assert sorted((r["REF_AREA"], r["NOTE"], r["OBS_VALUE"]) for r in rows) == [
        ("US", 'one, two\nthree "q"', "4.5"), ("XM", "plain", "NaN")]


def test_json_readers(spark, tmp_path):
    page = [{"page": 1, "pages": 2}, [{"countryiso3code": "", "country": {"id": "NGA"}, "indicator": {"id": "C", "value": "Name"},
                                      "date": "2025Q1", "value": 3, "unit": ""}]]
    paged, nested, series, index = (tmp_path / n for n in ("paged", "nested", "series", "index"))
    for folder in (paged, nested, series, index):
        folder.mkdir()
    (paged / "p1.json").write_text(json.dumps(page))
    (paged / "p2.json").write_text('[{"message": [{"id": "120"}]}]')
    (paged / "p3.json").write_text('{"not": "a page"}')
    rows = Y.read_paged_json(spark, str(paged)).collect()
    assert [(r["entity_alt"], r["period_raw"], r["value_raw"], r["pages"], r["display_name"]) for r in rows] == [
        ("NGA", "2025Q1", "3", 2, "Name")]
    (nested / "n.json").write_text('{"values": {"G": {"NGA": {"2024": 1.5, "2031": 2}, "BAD": 3, "AFR": {"2024": null}}}}')
    got = {(r["entity_raw"], r["period_raw"], r["value_raw"]) for r in Y.read_nested_map_json(spark, str(nested), 2026).collect()}
    assert got == {("NGA", "2024", "1.5"), ("NGA", "2031", "2"), ("AFR", "2024", None)}
    (series / "UNRATE.json").write_text('{"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-02-01", "value": "3.9"}]}')
    got = [(r["series_id"], r["value_raw"], r["series_indicator"]) for r in
           Y.read_series_observations(spark, str(series), Y.keyed_registry(spark)).collect()]
    assert sorted(got) == [("UNRATE", ".", "FRED.UNRATE"), ("UNRATE", "3.9", "FRED.UNRATE")]
    (index / "i.json").write_text('[{"page": 1}, [{"id": "WLD", "region": {"id": "NA"}}]]')
    with pytest.raises(RuntimeError):
        Y.read_country_index(spark, str(index))


def test_all_parts_failing_ends_the_run(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "context string, error string")
    with pytest.raises(RuntimeError):
        K.require_some(files)
    assert K.require_some(files.unionAll(spark.createDataFrame([("c", None)], files.schema))).count() == 3


def test_smoothing_follows_trend_and_season():
    line = [10.0 + 2 * i for i in range(40)]
    median, lower, upper = M.smoothing(line, 5, 1)
    assert all(abs(m - (10 + 2 * (40 + i))) < 0.5 for i, m in enumerate(median))
    assert all(lo <= m <= up for lo, m, up in zip(lower, median, upper))
    wave = [100 + 10 * ((i % 4) - 1.5) for i in range(48)]
    median, _, _ = M.smoothing(wave, 8, 4)
    assert all(abs(m - wave[i % 4]) < 1.5 for i, m in enumerate(median))
    median, lower, upper = M.smoothing([5.0] * 20, 3, 1)
    assert median == [5.0] * 3 and lower == [5.0] * 3 and upper == [5.0] * 3


def test_a_series_is_smoothed_alike_alone_and_among_others():
    rng = np.random.default_rng(2)
    series = [list(np.cumsum(rng.normal(0, 1, n)) + 5 * np.sin(np.arange(n) / 2)) for n in (16, 24, 17, 80, 24, 300, 48)] + [[4.0] * 30, [1.0, 2.0] * 20]
    horizons, seasons = [12, 8, 5, 12, 12, 3, 8, 4, 12], [12, 12, 1, 12, 4, 12, 4, 12, 4]
    together = M.smoothing_many(series, horizons, seasons)
    for h, k, m, got in zip(series, horizons, seasons, together):
        alone = M.smoothing(h, k, m)
        assert got == alone and [len(x) for x in got] == [k] * 3
    assert M.smoothing_many([], [], []) == []


def test_one_bad_series_of_a_batch_leaves_the_others(spark):
    rows = [(n, dt.date(2000 + i, 1, 1), float(i + 1), "annual") for n in "abc" for i in range(20)]
    inputs = O.series_inputs(spark.createDataFrame(rows, "name string, date date, value double, frequency string"), ["name"]).coalesce(1)

    def picky(h, n, s):
        if len(h) == 21:
            raise ValueError("no")
        return M.smoothing(h, n, s)

    def many(hs, ns, ss):
        return [picky(*x) for x in zip(hs, ns, ss)]

    picky.of_many = many
    longer = inputs.withColumn("history", F.when(F.col("name") == "b", F.concat("history", F.array(F.lit(21.0)))).otherwise(F.col("history")))
    got = {r["name"]: (r["model"], r["attempts"]) for r in O.forecast(longer, [("picky", picky), ("smoothing", M.smoothing)]).collect()}
    assert got == {"a": ("picky", []), "b": ("smoothing", ["picky: ValueError: no"]), "c": ("picky", [])}


def test_cascade_records_attempts(spark):
    rows = [("a", dt.date(2000 + i, 1, 1), float(i + 1), "annual") for i in range(20)]
    rows += [("b", dt.date(2000 + i, 1, 1), 1.0, "annual") for i in range(10)]
    df = spark.createDataFrame(rows, "name string, date date, value double, frequency string")
    inputs = O.series_inputs(df, ["name"])
    nan = ("nan", lambda h, n, s: ([float("nan")] * n, [0.0] * n, [0.0] * n))
    ragged = ("ragged", lambda h, n, s: ([1.0] * n, [0.0], [2.0] * n))
    out = O.forecast(inputs, [nan, ragged, ("smoothing", M.smoothing)]).collect()
    assert [(r["name"], r["model"], len(r["median"]), r["attempts"]) for r in out] == [
        ("a", "smoothing", 5, ["nan: not finite", "ragged: ragged"])]
    none = O.forecast(inputs, [nan]).first()
    assert none["model"] is None and none["attempts"] == ["nan: not finite"]


def test_labels(spark):
    df = spark.createDataFrame([(2.5, 2.5), (4.475, 4.47), (12.25, 12.2), (1000.5, 1000.0), (-0.004, -0.0)], "v double, want double")
    assert df.where(B.fmt(F.col("v")) != F.col("want")).count() == 0
    texts = spark.createDataFrame([(8.54,), (-2.3,), (1234567.0,), (0.0,), (15406.0,)], "v double").select(
        B.signed_general(F.col("v")).alias("t"))
    assert [r["t"] for r in texts.collect()] == ["+8.54", "-2.3", "+1.23457e+06", "+0", "+15406"]
    token = spark.createDataFrame([("Debt-to-GDP ratio",), ("policy rate",), ("rate",)], "t string").select(
        C.normalise_token(F.col("t")).alias("n")).select("n", C.strip_qualifier(F.col("n")).alias("s"))
    assert [tuple(r) for r in token.collect()] == [("debt_to_gdp_ratio", "debt_to_gdp"), ("policy_rate", "policy"), ("rate", "")]
    assert spark.range(1).select(B.flag_emoji(F.lit(" aw ")).alias("f")).first()["f"] == "\U0001F1E6\U0001F1FC"


def test_nice_domain(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 97.0), ("b", 5.0), ("c", 0.0)], "k string, value double")
    got = {r["k"]: (r["low"], r["high"]) for r in nice_domain(df, ["k"]).collect()}
    assert got == {"a": (0.0, 100.0), "b": (4.5, 5.5), "c": (-1.0, 1.0)}


def test_split_row_number_matches_a_plain_window_on_a_hot_group(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        ((F.col("id") * 7919 % 613 - 300) / 7).alias("v"), "id")
    from pyspark.sql import Window

    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    out = split_row_number(plain, ["g"], "v", ["id"], "rank")
    assert out.count() == 6000 and out.where("rank <> want").count() == 0


@pytest.mark.parametrize("descending", [True, False])
def test_ties_of_any_size_are_cut_by_digits(spark, descending):
    """A third of all rows at one value, beside NaN, null, zeros, near values and repeated ties of all lengths."""
    from pyspark.sql import Window

    df = spark.range(3000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 50 == 1, F.lit(float("nan"))).when(F.col("id") % 70 == 1, F.lit(None).cast("double"))
        .when(F.col("id") % 40 == 2, F.lit(0.0)).otherwise(5.0 + (F.col("id") % 97) / 1e4).alias("v"),
        F.when(F.col("id") % 11 == 0, F.lit("")).when(F.col("id") % 13 == 0, F.lit("longer-than-both-digits")).otherwise(F.concat(F.lit("e"), (F.col("id") * 37 % 800).cast("string"))).alias("e"), "id")
    order = F.col("v").desc() if descending else F.col("v").asc()
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(order, "e", "id")))
    for largest in (1, 40, 1 << 20):
        out = split_row_number(plain, ["g"], "v", ["e", "id"], "rank", descending, largest)
        assert out.columns == [*plain.columns, "rank"] and out.count() == 3000 and out.where("rank <> want").count() == 0
    parts = split_row_number(plain, ["g"], "v", ["e", "id"], "rank", descending, 40).where("v = 5.0")
    sizes = parts.groupBy("g", F.substring("e", 1, 3), F.substring("e", 4, 3)).count().agg(F.max("count")).first()[0]
    assert sizes < 100 < parts.count() / 2  # the rows of one task at most, of the thousand that share the value


def test_quantiles_by_selection(spark):
    rows = [("a", float(i % 17 - 8)) for i in range(331)] + [("b", 7.0)] * 90 + [("c", -1.5), ("d", 1e300), ("d", -1e-300), ("d", 0.0)]
    got = values_at(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95})
    assert "row_number" not in got._jdf.queryExecution().toString()
    want = {}
    for k in "abcd":
        mine = sorted(v for n, v in rows if n == k)
        want[k] = tuple(mine[min(int(p * len(mine)) + 1, len(mine)) - 1] for p in (0.05, 0.5, 0.95))
    assert {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in got.collect()} == want


def test_limits_of_requests_reach_the_tasks(spark):
    facts = spark.createDataFrame([("s", "i", "E", dt.date(2000, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(400)],
                                  "source string, indicator_code string, entity string, date date, value double")
    schema = "request_id int, entity string, indicator_code string, start date, end date, latest_only boolean, limit int"
    asked = [(1, "E", "i", None, None, False, 2), (2, "E", "i", None, None, False, 300), (3, "E", "i", None, None, True, 9), (4, "X", "i", None, None, False, 5)]
    out = query_observations(spark.createDataFrame(asked, schema), facts)
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    got = {r["request_id"]: (len(r["observations"]), r["truncated"], r["observations"][:1]) for r in out.collect()}
    assert [got[k][:2] for k in (1, 2, 3, 4)] == [(2, True), (300, True), (1, False), (0, False)] and got[2][2][0]["value"] == 399.0
    assert query_observations(spark.createDataFrame([], schema), facts).count() == 0
