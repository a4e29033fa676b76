"""Period text, frequencies and calendar steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted period spellings: a day, a quarter, a month or a year.
PERIOD = r"^(?!0000)\d{4}(-\d{2}-\d{2}|-?[Qq][1-4]|-?[Mm]\d{1,2}|-\d{1,2})?$"


def iso_date(text: Column) -> Column:
    """A calendar date or null; never an error, also under ANSI rules."""
    return F.when(F.left(text, F.lit(4)) != "0000", text.try_cast("date"))


def parse_period(raw: Column) -> Column:
    """struct(date, frequency): the first day of the period, both null if unreadable.

    One pattern decides whether the text is a period at all; its parts are then taken
    by position. The cleaned text and the date are bound once through one-element
    arrays, since a column used in several branches is computed again in each.
    """
    def parts(text: Column) -> Column:
        rest = F.substr(text, F.lit(5))
        quarter = F.contains(rest, F.lit("Q"))
        number = F.when(quarter, (F.right(text, F.lit(1)).try_cast("int") * 3 - 2).cast("string")).otherwise(
            F.translate(rest, "-M", ""))
        first_day = F.when(F.length(text) == 10, text).when(rest == "", F.concat(text, F.lit("-01-01"))).otherwise(
            F.concat(F.left(text, F.lit(4)), F.lit("-"), F.lpad(number, 2, "0"), F.lit("-01")))
        frequency = (
            F.when(rest == "", "annual").when(quarter, "quarterly").when(F.contains(rest, F.lit("M")), "monthly")
            .when(F.length(text) == 10, "daily").otherwise("monthly")
        )
        return _bind(F.when(text.rlike(PERIOD), first_day.try_cast("date")), lambda date: F.struct(
            date.alias("date"), F.when(date.isNotNull(), frequency).alias("frequency")))

    return _bind(F.upper(F.trim(raw)), parts)


def period_end(raw: Column) -> Column:
    """The last day of a period."""
    length = {"annual": "12", "quarterly": "3", "monthly": "1"}
    return _bind(parse_period(raw), lambda p: F.coalesce(*[
        F.when(p["frequency"] == name, F.date_sub(F.add_months(p["date"], F.lit(int(months))), 1)) for name, months in length.items()
    ], p["date"]))


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lenient_date(raw: Column) -> Column:
    """Date from the first ten characters: a day, a month or a bare year; else null."""
    token = F.substr(F.trim(raw), F.lit(1), F.lit(10))
    return (
        F.when(token.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso_date(token))
        .when(token.rlike(r"^\d{8}$"), iso_date(F.regexp_replace(token, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")))
        .when(token.rlike(r"^\d{4}-\d{2}$"), iso_date(F.concat(token, F.lit("-01"))))
        .when(token.rlike(r"^\d{4}$"), iso_date(F.concat(token, F.lit("-01-01"))))
    )


# Months per step, horizon and season length by frequency.
STEP_MONTHS = {"monthly": 1, "quarterly": 3}
HORIZONS = {"monthly": 12, "quarterly": 8, "annual": 5}
SEASONS = {"monthly": 12, "quarterly": 4, "annual": 1}


def _by_frequency(frequency: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(F.lower(frequency) == name, F.lit(value)).otherwise(out)
    return out


def horizon_for(frequency: Column) -> Column:
    return _by_frequency(frequency, HORIZONS, HORIZONS["annual"])


def season_for(frequency: Column) -> Column:
    return _by_frequency(frequency, SEASONS, 1)


def advance(date: Column, frequency: Column, steps: Column) -> Column:
    """``steps`` periods later, on the first day of the period."""
    months = _by_frequency(frequency, STEP_MONTHS, 12) * steps
    return F.trunc(F.add_months(date, months.cast("int")), "MM")
