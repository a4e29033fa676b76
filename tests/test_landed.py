"""Landed files: what arrives damaged, blank or as an error document, and slices while reading."""

import json

import pytest
from pyspark.sql import functions as F

from panelmark.functions.periods import parse_period, period_end
from panelmark.sources import landed as Z
from panelmark.sources import payloads as Y

COLUMNS = ["NOTE", "AREA", "TIME_PERIOD", "OBS_VALUE"]
ROLES = ("TIME_PERIOD", "OBS_VALUE", None, ["AREA"])
HEAD = "NOTE,AREA,TIME_PERIOD,OBS_VALUE\n"


def states(rows):
    return {r["context"]: (r["state"], r["kind"], r["error"], r["n_rows"]) for r in Z.parts(rows).collect()}


def test_csv_parts(spark, tmp_path):
    files = {
        "good": "﻿" + HEAD + '"a, ""b""\nc",US,2001,1\r\n<x,DE,2001,2\n\nshort,FR\n',
        "tags": HEAD + "".join(f"<{k}>,US,2002,{k}\n" for k in range(3000)),
        "xml": "﻿\n <?xml version='1.0'?>\n<error>none</error>\n", "blank": " \n\t", "none": "", "head": HEAD,
        "cut": HEAD + 'a,US,1999,1\n"b\nc,DE,2000', "columns": "NOTE,AREA\nx,US\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "bytes.csv").write_bytes(HEAD.encode() + b"a,US,1999,1\n\xff\xfe,US,2000,1\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = Z.read_landed(spark, str(tmp_path), "csv", COLUMNS, ROLES)
    found = states(rows)
    assert found.pop("bytes")[:3] == ("failed", "PayloadError", "not UTF-8 text")
    assert found == {
        "good": ("ok", None, None, 3), "tags": ("ok", None, None, 3000), "xml": ("error document", None, None, 0), "blank": ("empty", None, None, 0),
        "none": ("empty", None, None, 0), "head": ("ok", None, None, 0), "cut": ("failed", "PayloadError", "ends inside a quoted field", 1),
        "columns": ("failed", "PayloadError", "no column TIME_PERIOD", 0),
    }
    good = [tuple(r) for r in Z.observations(rows).where("context = 'good'").orderBy("position").select(*COLUMNS).collect()]
    assert good == [('a, "b"\nc', "US", "2001", "1"), ("<x", "DE", "2001", "2"), ("short", "FR", "", "")]
    kept = Y.read_sdmx_csv(spark, str(tmp_path / "tags.csv"), COLUMNS, series=("AREA",), mrv=2)
    assert sorted(int(r["OBS_VALUE"]) for r in kept.collect()) == [0, 1]


@pytest.mark.parametrize("shape, body, want", [
    ("paged", [{"pages": 3}, [{"date": "2001", "value": 1.50, "indicator": {"id": "I", "value": "Name"}, "country": {"id": "US"}}, "odd"]],
     [(3, "Name", None, "US", "I", "2001", "1.5", None, "Name")]),
    ("paged", [{"pages": "x"}, [{"date": "2001", "value": True, "country": "US"}]], [(1, None, None, None, None, "2001", "true", None, None)]),
    ("paged", [{"message": []}], []), ("paged", {"a": 1}, []),
    ("map", {"values": {"I": {"US": {"2001": 1, "2002": None}, "bad": 3}, "J": 4}}, [("I", "US", "2001", "1"), ("I", "US", "2002", None)]),
    ("map", [1], []),
    ("series", {"observations": [{"date": "2001-01-01", "value": "."}, 5]}, [("part", "2001-01-01", ".")]),
])
def test_json_parts(spark, tmp_path, shape, body, want):
    text = json.dumps(body)
    (tmp_path / "part.json").write_text(text)
    for name, other in {"cut": text[:-1], "page": "<html></html>", "blank": "\n"}.items():
        (tmp_path / f"{name}.json").write_text(other)
    rows = Z.read_landed(spark, str(tmp_path), shape)
    assert [tuple(r)[2:] for r in Z.observations(rows).where("context = 'part'").orderBy("position").collect()] == want
    damaged = ("failed", "PayloadError", "not a JSON document", 0)
    assert states(rows) == {"part": ("ok", None, None, len(want)), "cut": damaged, "page": damaged, "blank": ("failed", "SourceError", "no answer", 0)}


def test_slices_of_parts_equal_slices_of_rows(spark, tmp_path):
    """The reader's own reading of periods against the column functions, and most recent values over several parts."""
    spelt = ["2001", "2001-Q3", "2001q4", "2002M2", "2002-m11", "2002-7", "2003-05-31", " 2004 ", "2001-02-30", "garbage", "0000", "2002M13", "9999", "9999-12", ""]
    frame = spark.createDataFrame([(x,) for x in spelt], "p string").select("p", parse_period(F.col("p"))["date"].alias("a"), period_end(F.col("p")).alias("b"))
    for r in frame.where("p NOT LIKE '9999%'").collect():
        assert Z.period_days(r["p"]) == (None if r["a"] is None else (r["a"], r["b"])), r["p"]
    for k in range(3):
        lines = [f"n,A{i % 2},{p},{'' if i == 5 else i}" for i, p in enumerate(spelt) if i % 3 == k or i % 4 == k]
        (tmp_path / f"p{k}.csv").write_text(HEAD + "\n".join(lines) + "\n")
    everything = Z.observations(Z.read_landed(spark, str(tmp_path), "csv", COLUMNS, ROLES)).withColumnRenamed("OBS_VALUE", "value_raw")
    everything = everything.withColumn("value_raw", F.nullif("value_raw", F.lit("")))
    for slices in ({"mrv": 2}, {"mrv": 1, "start": "2002"}, {"start": "2001Q4"}, {"end": "2002"}, {"start": "2002", "end": "2002M2"}, {"max_year": 2001}, {"mrv": 0}):
        got = Z.observations(Z.read_landed(spark, str(tmp_path), "csv", COLUMNS, ROLES, **slices))
        want = Y.slice_rows(everything, ["AREA"], period="TIME_PERIOD", **slices)
        assert sorted((r["AREA"], r["TIME_PERIOD"]) for r in got.collect()) == sorted((r["AREA"], r["TIME_PERIOD"]) for r in want.collect()), slices
    assert len(Z.parts(Z.read_landed(spark, str(tmp_path), "csv", COLUMNS, ROLES, mrv=1)).collect()) == 3


def test_slices_that_mean_nothing_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD)
    with pytest.raises(TypeError, match="nonsense"):
        Y.read_sdmx_csv(spark, str(tmp_path), COLUMNS, nonsense=1)
    with pytest.raises(ValueError, match="no period"):
        Z.read_landed(spark, str(tmp_path), "map", start="soon")
    with pytest.raises(ValueError, match="indicator"):
        Z.read_landed(spark, str(tmp_path), "series", indicators=["X"])
    with pytest.raises(ValueError, match="shape"):
        Z.read_landed(spark, str(tmp_path), "xml")


def test_parts_named_by_a_folder(spark, tmp_path):
    for name in ("a b", "c%2Fd"):
        (tmp_path / f"context={name}").mkdir()
        (tmp_path / f"context={name}" / "f.json").write_text('{"observations": [{"date": "2001", "value": 2}]}')
    got = Z.observations(Z.read_landed(spark, str(tmp_path), "series"))
    assert sorted((r["context"], r["series_id"], r["value_raw"]) for r in got.collect()) == [("a b", "a b", "2"), ("c/d", "c/d", "2")]
