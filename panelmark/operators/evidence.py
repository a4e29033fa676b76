"""What nested evidence says, at any depth.

Payloads go to Python in Arrow batches and through its JSON parser; only one that is nested
deeper than that parser goes is read token by token with an explicit stack. Of a field given twice
the last one counts. Evidence that is no JSON says nothing, and is marked as unreadable.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[{}\[\],:])')
#: Payloads and bytes that are taken apart together.
ROWS, BYTES = 200, 1 << 20
#: Fields whose figures may be extreme.
FIGURES = ("value", "min_value", "max_value", "median", "lower", "upper")

_TEXTS = "array<struct<t:string,unit:string>>"
_NUMBERS = "array<struct<key:string,value:double,unit:string>>"
_OBJECTS = "array<struct<type:string,value:double,previous:double,changes:array<string>>>"
SCHEMA = f"struct<objects:{_OBJECTS},texts:{_TEXTS},figures:{_NUMBERS},unreadable:boolean>"
_ARROW = pa.struct([
    ("objects", pa.list_(pa.struct([("type", pa.string()), ("value", pa.float64()), ("previous", pa.float64()), ("changes", pa.list_(pa.string()))]))),
    ("texts", pa.list_(pa.struct([("t", pa.string()), ("unit", pa.string())]))),
    ("figures", pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64()), ("unit", pa.string())]))),
    ("unreadable", pa.bool_()),
])


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _deep(text: str):
    """The document of a text of any depth. A container waits on the stack with what it expects next."""
    stack: list[list] = [[[], None, "value"]]  # [container, key of the value to come, what may come]
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError("no JSON")
        at, mark, top = token.end(), token[1], stack[-1]
        box, _key, wanted = top
        if mark in ("}", "]"):
            if len(stack) == 1 or (mark == "}") != isinstance(box, dict) or wanted not in ("more", "first"):
                raise ValueError("no JSON")
            stack.pop()
        elif mark == ",":
            if wanted != "more" or len(stack) == 1:
                raise ValueError("no JSON")
            top[2] = "key" if isinstance(box, dict) else "value"
        elif mark == ":":
            if wanted != "colon":
                raise ValueError("no JSON")
            top[2] = "value"
        elif isinstance(box, dict) and wanted in ("key", "first"):
            if mark[0] != '"':
                raise ValueError("no JSON")
            top[1], top[2] = json.loads(mark), "colon"
        elif wanted in ("value", "first"):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(mark)
            if isinstance(box, dict):
                box[top[1]] = value
            else:
                box.append(value)
            top[2] = "more"
            if mark in ("{", "["):
                stack.append([value, None, "first"])
        else:
            raise ValueError("no JSON")
    if len(stack) != 1 or len(stack[0][0]) != 1:
        raise ValueError("no JSON")
    return stack[0][0][0]


def document(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _deep(text)


def _number(value) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return float(value)
    except OverflowError:
        return None


def _written(value) -> str | None:
    """A scalar as text; containers and null are none."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def describe(text: str | None) -> dict:
    """Objects, texts and figures, outer ones first. A missing or blank payload is no evidence, not an unreadable one."""
    out: dict = {"objects": [], "texts": [], "figures": [], "unreadable": False}
    if text is None or not text.strip():
        return out
    try:
        stack = [([document(text)], None)]
    except ValueError:
        return out | {"unreadable": True}
    while stack:
        box, unit = stack.pop()
        if isinstance(box, dict):
            unit = _written(box["unit"]) if "unit" in box else unit
            kind, changes = box.get("deviation_type"), box.get("changes")
            out["objects"].append({
                "type": kind.lower() if isinstance(kind, str) else None, "value": _number(box.get("value")), "previous": _number(box.get("previous_value")),
                "changes": [_written(v) for v in changes.values()] if isinstance(changes, dict) else []})
        inner = []
        for key, value in box.items() if isinstance(box, dict) else (("", v) for v in box):
            if isinstance(value, str):
                out["texts"].append({"t": value, "unit": unit})
            elif isinstance(value, (dict, list)):
                inner.append((value, unit))
            elif key in FIGURES and _number(value) is not None:
                out["figures"].append({"key": key, "value": _number(value), "unit": unit})
        stack.extend(reversed(inner))
    return out


def _runs(payloads: pa.Array) -> Iterator[pa.Array]:
    """A batch in runs of at most ``ROWS`` payloads and about ``BYTES`` bytes; a longer payload is a run of its own."""
    ends = np.cumsum(pc.binary_length(payloads).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(payloads):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, min(low + ROWS, int(np.searchsorted(ends, before + BYTES, "right"))))
        yield payloads.slice(low, high - low)
        low = high


def _described(payloads: pa.Array) -> pa.Array:
    """What the payloads of a batch say. Python holds the objects of one run at a time, however many rows a batch has."""
    parts = [pa.array([describe(p) for p in run.to_pylist()], _ARROW) for run in _runs(payloads)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


def walk(evidence: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``objects`` (marks, values and changes of each object), ``texts`` and ``figures``
    of the payload, each with the unit in force where it stands, and whether it was ``unreadable``."""
    rows = evidence.withColumn("_e", F.arrow_udf(_described, SCHEMA)(F.col(payload).cast("string")))
    return rows.select(*evidence.columns, "_e.objects", "_e.texts", "_e.figures", "_e.unreadable")
