"""Plain text of lightly marked-up answers, read once from left to right."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that a backslash makes plain.
ESCAPED = set("\\`*_{}[]()#+-.!")
#: Marks that come in pairs around a run of text, longer ones first.
PAIRS = ("**", "__", "*", "_")


def _word(sign: str) -> bool:
    return sign == "_" or sign == "*" or sign.isalnum()


def _closing(text: str, start: int, mark: str) -> int:
    """Where the run that ``mark`` opens before ``start`` ends, or -1. It touches its marks; a single mark
    stays within its line, and inside a word it marks nothing."""
    if start >= len(text) or text[start].isspace():
        return -1
    at = start
    while at < len(text):
        if text[at] == "\\":
            at += 2
            continue
        if len(mark) == 1 and text[at] in "*_\n" and text[at] != mark:
            return -1
        if text.startswith(mark, at):
            if at > start and not text[at - 1].isspace() and (len(mark) == 2 or not _word(text[at + 1 : at + 2])):
                return at
            if len(mark) == 1:
                return -1
            at += len(mark)
            continue
        at += 1
    return -1


def _inline(text: str) -> str:
    out, at = [], 0
    while at < len(text):
        sign = text[at]
        if sign == "\\" and text[at + 1 : at + 2] in ESCAPED and at + 1 < len(text):
            out.append(text[at + 1])
            at += 2
            continue
        if sign == "`":
            start = at + len(text[at:]) - len(text[at:].lstrip("`"))
            end = text.find("`", start)
            if end > start and "\n" not in text[start:end]:
                out.append(text[start:end])
                at = end + len(text[end:]) - len(text[end:].lstrip("`"))
            else:
                out.append(text[at:start])
                at = start
            continue
        mark = next((m for m in PAIRS if text.startswith(m, at)), None)
        if mark is not None:
            free = len(mark) == 2 or at == 0 or not _word(text[at - 1])
            end = _closing(text, at + len(mark), mark) if free else -1
            if end >= 0:
                out.append(_inline(text[at + len(mark) : end]))
                at = end + len(mark)
            else:
                out.append(mark)
                at += len(mark)
            continue
        out.append(sign)
        at += 1
    return "".join(out)


def _line(line: str) -> str:
    """Without the mark of a heading; list points as dots."""
    body = line.lstrip(" \t")
    indent = line[: len(line) - len(body)]
    hashes = len(body) - len(body.lstrip("#"))
    if 0 < hashes <= 6 and len(indent) <= 3 and "\t" not in indent and body[hashes : hashes + 1] in (" ", "\t"):
        return body[hashes:].lstrip(" \t")
    if body[:1] in ("*", "+", "-") and body[1:2] in (" ", "\t"):
        return f"{indent}• {body[1:].lstrip(' ' + chr(9))}"
    return line


def plain(text: str) -> str:
    return _inline("\n".join(_line(x) for x in text.split("\n"))).strip()


def _plain(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else plain(t) for t in texts.to_pylist()], pa.string())


def strip_markup(text: Column) -> Column:
    return F.arrow_udf(_plain, "string")(text)
