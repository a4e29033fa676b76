"""Landed provider files as one Spark data source, for all four payload shapes.

A part is one file a provider request left. Every part yields its observations and one
status row, so a short or damaged answer is seen beside what the others brought. Parts are
dealt out in runs of about ``RUN_BYTES``; the first bytes tell an error document, which
is read no further. CSV is read record by record and JSON page by page (a page is as
large as the provider makes it). Slices are applied while reading: a part hands over
no more than the most recent values of each of its series, or what lies in the range.

Paths are those that ``pyarrow.fs`` knows (local, HDFS, S3, GCS). A folder ``context=x`` above
a file names the part; else the file's own name does.
"""

from __future__ import annotations

import csv
import datetime as dt
import heapq
import io
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelmark.functions.periods import PERIOD, parse_period

#: Bytes of the files that one task reads, about; of a file's head that tell its kind; rows of a batch.
RUN_BYTES, HEAD_BYTES, BATCH_ROWS = 32 << 20, 4096, 5000
STATUS = "context string, position long, state string, kind string, error string, n_rows long"
SHAPES = {
    "paged": "pages int, display_name string, entity_raw string, entity_alt string, indicator_raw string, "
             "period_raw string, value_raw string, unit_raw string, name_raw string",
    "map": "indicator_raw string, entity_raw string, period_raw string, value_raw string",
    "series": "series_id string, period_raw string, value_raw string",
}
#: Columns of period, value, indicator and series by shape; CSV files name their own.
ROLES = {
    "paged": ("period_raw", "value_raw", "indicator_raw", ["entity_raw", "entity_alt", "indicator_raw"]),
    "map": ("period_raw", "value_raw", "indicator_raw", ["entity_raw", "indicator_raw"]),
    "series": ("period_raw", "value_raw", None, ["series_id"]),
}
SLICES = {"mrv", "start", "end", "max_year", "indicators"}


class Damaged(ValueError):
    """A part that arrived but cannot be read to its end."""


def period_days(text: str | None) -> tuple[dt.date, dt.date] | None:
    """First and last day of a period as ``parse_period`` reads it, or None."""
    text = (text or "").strip(" ").upper()
    if not re.match(PERIOD, text):
        return None
    rest, months = text[4:], 1
    try:
        if len(text) == 10:
            day = dt.date.fromisoformat(text)
            return day, day
        if not rest:
            month, months = 1, 12
        elif "Q" in rest:
            month, months = int(rest[-1]) * 3 - 2, 3
        else:
            month = int(rest.strip("-M"))
        first = dt.date(int(text[:4]), month, 1)
        over = month + months > 12
        after = dt.date(first.year + over, month + months - 12 * over, 1) if first.year + over < 10000 else dt.date.max
        return first, after - dt.timedelta(days=after is not dt.date.max)
    except ValueError:
        return None


@dataclass
class Slice:
    """What is wanted of a part: the most recent values of each series beat a range."""

    period: int | None
    value: int | None
    indicator: int | None
    series: list[int]
    mrv: int | None = None
    start: str | None = None
    end: str | None = None
    max_year: int | None = None
    indicators: list[str] | None = None

    def applied(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows are (position, columns); without a slice no column is looked at."""
        if (self.mrv, self.start, self.end, self.max_year, self.indicators) == (None,) * 5:
            yield from rows
            return
        low = period_days(self.start)[0] if self.start is not None and self.mrv is None else None
        high = period_days(self.end)[1] if self.end is not None and self.mrv is None else None
        newest: dict[tuple, list] = {}
        for position, row in rows:
            if self.indicators is not None and self.indicator is not None and row[self.indicator] not in self.indicators:
                continue
            text = row[self.period]
            if self.max_year is not None and not (text and re.match(r"\s*[+-]?\d{1,4}\s*$", text[:4]) and int(text[:4]) <= self.max_year):
                continue
            if self.mrv is None:
                days = period_days(text) if low or high else None
                if (low or high) and (days is None or (low and days[0] < low) or (high and days[0] > high)):
                    continue
                yield position, row
            elif row[self.value]:
                days = period_days(text)
                heap = newest.setdefault(tuple(row[i] for i in self.series), [])
                entry = (days is not None, days[0] if days else dt.date.min, text or "", -position, row)
                if len(heap) < self.mrv:
                    heapq.heappush(heap, entry)
                elif self.mrv:
                    heapq.heappushpop(heap, entry)
        for heap in newest.values():
            yield from ((-entry[3], entry[4]) for entry in heap)


def _text(value) -> str | None:
    """A JSON scalar as it was spelt; lists and maps as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _document(body: str):
    try:
        return json.loads(body, parse_float=str, parse_int=str, parse_constant=str)
    except (ValueError, RecursionError):
        raise Damaged("not a JSON document") from None


def _of(value, *names: str) -> str | None:
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return _text(value)


def paged_rows(body: str) -> Iterator[tuple]:
    """``[meta, rows]``; a document of another shape has no rows."""
    found = _document(body)
    if not (isinstance(found, list) and len(found) == 2 and isinstance(found[1], list)):
        return
    pages = _of(found[0], "pages")
    pages = int(pages) if pages and re.fullmatch(r"\d{1,9}", pages) else 1
    display = _of(found[1][0], "indicator", "value") if found[1] else None
    for row in found[1]:
        if isinstance(row, dict):
            yield (
                pages, display, _of(row, "countryiso3code"), _of(row, "country", "id"), _of(row, "indicator", "id"), _of(row, "date"),
                _of(row, "value"), _of(row, "unit"), _of(row, "indicator", "value"),
            )


def map_rows(body: str) -> Iterator[tuple]:
    """``{"values": {code: {area: {year: value}}}}``; areas that hold no map are skipped."""
    values = _document(body)
    values = values.get("values") if isinstance(values, dict) else None
    for code, areas in values.items() if isinstance(values, dict) else ():
        for area, series in areas.items() if isinstance(areas, dict) else ():
            for period, value in series.items() if isinstance(series, dict) else ():
                yield code, area, period, _text(value)


def series_rows(body: str, name: str) -> Iterator[tuple]:
    """``{"observations": [{date, value}]}`` of the series the part is named after."""
    found = _document(body)
    found = found.get("observations") if isinstance(found, dict) else None
    for row in found if isinstance(found, list) else ():
        if isinstance(row, dict):
            yield name, _of(row, "date"), _of(row, "value")


def csv_rows(lines: Iterator[str], columns: list[str]) -> Iterator[tuple]:
    """Records with commas and line breaks in quoted fields; absent fields are empty.

    Quotes of a whole file come in pairs: with an odd one left the last record, which
    swallowed the rest of the file, is not handed over and the part is damaged.
    """
    quotes = 0

    def counted() -> Iterator[str]:
        nonlocal quotes
        for line in lines:
            quotes += line.count('"')
            yield line

    reader = csv.reader(counted())
    held = None
    try:
        head = next(reader, [])
        missing = [c for c in columns if c not in head]
        if missing:
            raise Damaged(f"no column {missing[0]}")
        places = [head.index(c) for c in columns]
        for record in reader:
            if not record:
                continue
            if held is not None:
                yield held
            held = tuple(record[i] if i < len(record) else "" for i in places)
    except csv.Error as error:
        raise Damaged(f"not readable as CSV: {error}") from None
    if quotes % 2:
        raise Damaged("ends inside a quoted field")
    if held is not None:
        yield held


@dataclass
class Run(InputPartition):
    paths: list[str]


def _named(path: str) -> str:
    for folder in reversed(path.split("/")[:-1]):
        if folder.startswith("context="):
            return unquote(folder.removeprefix("context="))
    return posixpath.splitext(posixpath.basename(path))[0]


class _Reader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.shape, self.names = options["path"], options["shape"], names
        roles = json.loads(options["roles"])
        place = {c: i for i, c in enumerate(names)}
        at = [place.get(roles[0]), place.get(roles[1]), place.get(roles[2]), [place[c] for c in roles[3]]]
        self.slice = Slice(*at, **json.loads(options["slices"]))

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        infos = [store.get_file_info(root)]
        if infos[0].type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        parts = sorted((x.path, x.size or 0) for x in infos if x.type == fs.FileType.File and x.base_name[0] not in "._")
        runs, held = [Run([])], 0
        for path, size in parts:
            if held + size > RUN_BYTES and runs[-1].paths:
                runs.append(Run([]))
                held = 0
            runs[-1].paths.append(path)
            held += size
        return runs

    def _rows(self, store, path: str) -> Iterator[tuple]:
        """The columns of each observation; ends early with the state of a part that has none."""
        with store.open_input_stream(path, compression=None) as file:
            head = file.read(HEAD_BYTES)
            while len(head) < HEAD_BYTES and (more := file.read(HEAD_BYTES - len(head))):
                head += more
            start = head.decode("utf-8", "replace").lstrip("﻿").lstrip()
            if not start and len(head) < HEAD_BYTES:
                if self.shape == "csv":
                    return "empty"
                raise OSError("no answer")
            if start.startswith("<"):
                if self.shape == "csv":
                    return "error document"
                raise Damaged("not a JSON document")
            if self.shape == "csv":
                yield from csv_rows(io.TextIOWrapper(_Behind(head, file), "utf-8-sig", newline=""), self.names)
            else:
                body = (head + file.read()).decode("utf-8-sig")
                yield from {"paged": paged_rows, "map": map_rows}[self.shape](body) if self.shape != "series" else series_rows(body, _named(path))
        return "ok"

    def _part(self, store, path: str) -> Iterator[tuple]:
        name, done = _named(path), ["ok", None, None, 0]

        def counted() -> Iterator[tuple]:
            rows = self._rows(store, path)
            try:
                while True:
                    row = next(rows)
                    done[3] += 1
                    yield done[3] - 1, row
            except StopIteration as end:
                done[0] = end.value
            except UnicodeDecodeError:
                done[:3] = "failed", "PayloadError", "not UTF-8 text"
            except Damaged as error:
                done[:3] = "failed", "PayloadError", str(error)
            except OSError as error:
                done[:3] = "failed", "SourceError", str(error)

        for position, row in self.slice.applied(counted()):
            yield name, position, None, None, None, None, *row
        yield name, None, *done, *[None] * len(self.names)

    def read(self, run: Run):
        store, _root = fs.FileSystem.from_uri(self.path)
        kinds = {"pages": pa.int32()}
        names = [c.split()[0] for c in STATUS.split(", ")] + self.names
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *(kinds.get(c, pa.string()) for c in self.names)]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for path in run.paths:
            for row in self._part(store, path):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class _Behind(io.RawIOBase):
    """A stream whose head was read already."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        part = self.head[: len(into)] or self.rest.read(len(into))
        self.head = self.head[len(part) :]
        into[: len(part)] = part
        return len(part)


class Landed(DataSource):
    @classmethod
    def name(cls):
        return "landed"

    def schema(self):
        return f"{STATUS}, {self.options['columns']}"

    def reader(self, schema):
        return _Reader(self.options, [f.name for f in schema.fields][6:])


def read_landed(spark: SparkSession, path: str, shape: str, columns: list[str] | None = None,
                roles: tuple[str, str, str | None, list[str]] | None = None, **slices) -> DataFrame:
    """Observations and status rows of the parts at ``path``; ``shape`` is paged, map, series or csv.

    CSV names its ``columns`` and which of them are (period, value, indicator, series).
    Slices are those of ``slice_rows``: ``mrv`` (a blank is no value), ``start``, ``end``, ``max_year``
    and ``indicators``; another one is an error. Status rows have a state (ok, empty, error document
    or failed), the number of records read, and, if failed, kind and error; observations have a
    position and no state. A part that breaks off keeps the records before the break.
    """
    unknown = set(slices) - SLICES
    if unknown:
        raise TypeError(f"unknown slice: {sorted(unknown)[0]}")
    if shape not in ("csv", *SHAPES):
        raise ValueError(f"unknown shape: {shape}")
    for name in ("start", "end"):
        if slices.get(name) is not None and period_days(slices[name]) is None:
            raise ValueError(f"{name} is no period: {slices[name]}")
    roles = roles or ROLES[shape]
    if slices.get("indicators") is not None and roles[2] is None:
        raise ValueError(f"{shape} parts name no indicator to choose by")
    spark.dataSource.register(Landed)
    schema = SHAPES[shape] if shape != "csv" else ", ".join(f"`{c}` string" for c in columns)
    rows = (
        spark.read.format("landed").option("shape", shape).option("columns", schema)
        .option("roles", json.dumps(roles)).option("slices", json.dumps(slices)).load(path)
    )
    mrv = slices.get("mrv")
    if mrv is None:
        return rows
    # each part has kept its own most recent values; of these the most recent over all parts
    period = F.col(f"`{roles[0]}`")
    order = [parse_period(period)["date"].desc_nulls_last(), period.desc(), F.col("context"), F.col("position")]
    turn = F.row_number().over(Window.partitionBy(*[f"`{c}`" for c in roles[3]]).orderBy(*order))
    seen = rows.where("state IS NULL").withColumn("_turn", turn).where(F.col("_turn") <= mrv).drop("_turn")
    return seen.unionByName(rows.where("state IS NOT NULL"))


def observations(landed: DataFrame) -> DataFrame:
    return landed.where("state IS NULL").drop("state", "kind", "error", "n_rows")


def parts(landed: DataFrame) -> DataFrame:
    """(context, state, kind, error, n_rows), one row for each part."""
    return landed.where("state IS NOT NULL").select("context", "state", "kind", "error", "n_rows")
