"""Short phrases as sequences of tokens: what moved, by how much, from where to where.

A text is cut at white space once. A token counts as a word by the letters it ends with, as
a figure by the number it begins with ("41.6%," is the figure 41.6), as a day if it is one. A
phrase is tried at every token, by looking at the few that follow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmark.functions.words import PLAIN_NUMBER


def tokens(text: Column) -> Column:
    """array<struct<raw, word, figure>>: each piece, the lower-case letters at its end, the number at its start."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(pieces, lambda t: F.struct(
        F.lower(t).alias("raw"),
        F.lower(F.regexp_extract(t, "(?:^|[^A-Za-z0-9_])([A-Za-z]+)$", 1)).alias("word"),
        F.regexp_extract(t, f"^({PLAIN_NUMBER})", 1).alias("figure")))


def _at(toks: Column, i: Column, ahead: int, field: str) -> Column:
    return F.coalesce(F.get(toks, i + ahead)[field], F.lit(""))


def _found(toks: Column, phrase) -> Column:
    """What ``phrase(i)`` makes of each token i; null is no phrase."""
    tried = F.transform(toks, lambda _t, i: phrase(i))
    return F.filter(tried, lambda p: p.isNotNull())


def figure_after(toks: Column, *links: str) -> Column:
    """array<struct<word, figure>>: a word, one of ``links``, a figure ("fell to 3", "a rise of 4")."""
    return _found(toks, lambda i: F.when(
        (_at(toks, i, 0, "word") != "") & _at(toks, i, 1, "raw").isin(*links) & (_at(toks, i, 2, "figure") != ""),
        F.struct(_at(toks, i, 0, "word").alias("word"), _at(toks, i, 2, "figure").alias("figure"))))


def sizes(toks: Column) -> Column:
    """array<struct<way, figure>>: "a rise of 4", "a fall of 4"."""
    def phrase(i: Column) -> Column:
        way = _at(toks, i, 1, "raw")
        said = (_at(toks, i, 0, "word") == "a") & way.isin("rise", "fall") & (_at(toks, i, 2, "raw") == "of") & (_at(toks, i, 3, "figure") != "")
        return F.when(said, F.struct(way.alias("way"), _at(toks, i, 3, "figure").alias("figure")))

    return _found(toks, phrase)


def moves(toks: Column) -> Column:
    """array<struct<way, start, end>>: "rose from 3 % in 2001-01-01 to 5"; the unit may stand apart or not at all."""
    def phrase(i: Column) -> Column:
        way = _at(toks, i, 0, "word")
        unit = (_at(toks, i, 3, "raw") != "in") & ~_at(toks, i, 3, "raw").rlike("^[0-9]")
        rest = F.when(unit, F.lit(4)).otherwise(F.lit(3))
        next_ = lambda k, field: F.coalesce(F.get(toks, i + rest + k)[field], F.lit(""))
        said = (
            way.isin("rose", "fell") & (_at(toks, i, 1, "raw") == "from") & (_at(toks, i, 2, "figure") != "")
            & (next_(0, "raw") == "in") & next_(1, "raw").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (next_(2, "raw") == "to") & (next_(3, "figure") != "")
        )
        return F.when(said, F.struct(
            F.when(way == "fell", "fall").otherwise("rise").alias("way"), _at(toks, i, 2, "figure").alias("start"), next_(3, "figure").alias("end")))

    return _found(toks, phrase)
