"""Display forms of values, dates and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt(value: Column) -> Column:
    """Half-even display rounding of the binary value: 0, 1 or 2 decimals by size. A
    negative that rounds to nothing stays a negative zero, so its sign can be written."""
    size = F.abs(value)
    rounded = F.when(size >= 1000, F.rint(size)).when(size >= 10, F.rint(size * 10) / 10).otherwise(F.rint(size * 100) / 100)
    return F.when(value < 0, -rounded).otherwise(rounded)


def _trimmed(number: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = number.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def signed_general(value: Column) -> Column:
    """Signed text with six significant digits, exponent form from a million up or below 1e-4."""
    size = F.abs(value)
    power = F.floor(F.log10(F.when(size > 0, size)))
    lead = F.bround(size / F.pow(F.lit(10.0), power), 5)
    power = F.when(lead >= 10, power + 1).otherwise(power)
    lead = F.when(lead >= 10, lead / 10).otherwise(lead)
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                        F.lpad(F.abs(power).cast("string"), 2, "0"))
    # Six significant digits of a plain number: digits left of the point vary by size.
    plain = F.when(size >= 1e5, F.bround(size, 0)).when(size >= 1e4, F.bround(size, 1)).when(
        size >= 1e3, F.bround(size, 2)).when(size >= 100, F.bround(size, 3)).when(
        size >= 10, F.bround(size, 4)).otherwise(F.bround(size, 5))
    return F.when(size == 0, F.concat(sign, F.lit("0"))).when(
        (power >= 6) | (power < -4), F.concat(sign, _trimmed(lead), exponent)
    ).otherwise(F.concat(sign, _trimmed(plain)))


def _fixed(value: Column, digits: int) -> Column:
    """Number text with a fixed count of decimals and no grouping."""
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def value_text(value: Column, unit: Column) -> Column:
    """Grouped number with its unit; missing or non-finite reads ``No data``."""
    size = F.abs(value)
    number = F.when(size >= 1000, F.format_number(value, 0)).when(
        size >= 10, F.format_number(value, 1)).otherwise(F.format_number(value, 2))
    missing = value.isNull() | F.isnan(value) | (size == float("inf"))
    return (
        F.when(missing, F.lit("No data"))
        .when(unit == "%", F.concat(number, F.lit("%")))
        .when(unit == "US$", F.concat(F.lit("$"), number))
        .when(F.coalesce(unit, F.lit("")) != "", F.concat(number, F.lit(" "), unit))
        .otherwise(number)
    )


def unit_suffix(unit: Column) -> Column:
    return F.when(unit == "%", F.lit("%")).when(
        F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(F.lit(""))


def title(name: Column) -> Column:
    """Provider name without trailing separators."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s,;·-]+$", "")


# Readable words of the measurement vocabulary, everything else is left unsaid.
BASIS_WORDS = {
    "real": "real",
    "nominal": "nominal",
    "year_over_year": "year-over-year",
    "period_average": "period average",
    "period_total": "period total",
    "end_of_period": "end of period",
    "general_government": "general government",
    "central_government": "central government",
    "ilo_modelled": "ILO-modelled",
    "national_definition": "national definition",
    "oecd_harmonised": "OECD-harmonised",
    "seasonally_adjusted": "seasonally adjusted",
    "not_seasonally_adjusted": "not seasonally adjusted",
}
BASIS_COLUMNS = ["price_basis", "transformation", "observation_basis", "coverage_definition", "seasonal_adjustment"]

# Display labels.
CONCEPT_LABELS = {
    "gdp_growth": "GDP growth", "gdp_per_capita": "GDP per capita", "current_account": "Current account",
    "government_debt": "Government debt", "exports": "Exports", "imports": "Imports", "inflation": "Inflation",
    "unemployment": "Unemployment", "exchange_rate": "Exchange rate",
    "industrial_production": "Industrial production", "equity_market": "Equity market",
    "policy_rate": "Policy rate", "bond_yield": "Bond yield", "price_level": "Price level",
}
SOURCE_LABELS = {
    "world_bank": "World Bank", "wb_databank": "WB DataBank", "imf": "IMF", "fred": "FRED", "bis": "BIS",
}
MODEL_LABELS = {
    "chronos2": "Chronos-2", "timesfm": "TimesFM", "statsforecast": "StatsForecast",
    "mistral": "Mistral", "mistral_agent": "Mistral", "nvidia_nim": "NVIDIA NIM", "groq": "Groq",
    "openrouter": "OpenRouter", "gemini_flash": "Gemini Flash", "qwen3_vl_dashscope": "Qwen3-VL",
}


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _named(token: Column, words: dict[str, str], empty: str, other: Column) -> Column:
    blank = F.coalesce(token, F.lit("")) == ""
    return F.when(blank, F.lit(empty)).otherwise(F.coalesce(F.try_element_at(_lookup(words), token), other))


def concept_label(token: Column) -> Column:
    return _named(token, CONCEPT_LABELS, "Other", F.replace(token, F.lit("_"), F.lit(" ")))


def source_label(token: Column) -> Column:
    return _named(token, SOURCE_LABELS, "Unknown", token)


def model_label(token: Column) -> Column:
    return _named(token, MODEL_LABELS, "unknown", token)


def basis_summary() -> Column:
    """Readable words of the five measurement columns, in reading order."""
    words = F.array(*[F.try_element_at(_lookup(BASIS_WORDS), F.coalesce(F.col(c), F.lit(""))) for c in BASIS_COLUMNS])
    return F.filter(words, lambda w: w.isNotNull())


def elapsed(at: Column, now: Column, raw: Column | None = None) -> Column:
    """How long ago, in words. ``raw`` is the unparsed text, to tell missing from unreadable."""
    seconds = F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6
    absent = at.isNull() if raw is None else (F.coalesce(raw, F.lit("")) == "")
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(absent, F.lit("no successful run on record"))
        .when(at.isNull(), F.lit("unreadable timestamp"))
        .when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(seconds < 48 * 3600, F.concat(whole(3600), F.lit(" hr ago")))
        .otherwise(F.concat(whole(86400), F.lit(" days ago")))
    )


def utc_stamp(at: Column, raw: Column | None = None) -> Column:
    absent = at.isNull() if raw is None else (F.coalesce(raw, F.lit("")) == "")
    return F.when(absent, F.lit("never")).when(at.isNull(), F.lit("unknown")).otherwise(
        F.concat(F.date_format(at, "d MMM HH:mm"), F.lit("z")))


def axis_label(value: Column, span: Column) -> Column:
    """Compact axis text; decimals of small values come from the axis span."""
    size = F.abs(value)
    small = F.when(span >= 12, _fixed(value, 0)).when(span >= 1.5, _fixed(value, 1)).otherwise(_fixed(value, 2))
    return (
        F.when(value.isNull() | F.isnan(value) | (size == float("inf")), F.lit(""))
        .when(size >= 1e6, F.concat(_fixed(value / 1e6, 1), F.lit("M")))
        .when(size >= 1e4, F.concat(_fixed(value / 1e3, 0), F.lit("k")))
        .when(size >= 1e3, F.concat(_fixed(value / 1e3, 1), F.lit("k")))
        .otherwise(small)
    )


def anomaly_look(kind: Column, z: Column) -> Column:
    label = F.when(kind == "drop", F.lit("Drop")).when(kind == "spike", F.lit("Spike")).otherwise(
        F.lit("Structural break"))
    shown = F.concat(F.lit("z "), F.when(z > 0, F.lit("+")).otherwise(F.lit("")), _fixed(z, 1))
    return F.struct(label.alias("label"), F.coalesce(F.abs(z) >= 3, F.lit(False)).alias("severe"), shown.alias("z_text"))


def flag_emoji(iso2: Column) -> Column:
    """Two regional-indicator symbols, or nothing for anything but two letters."""
    code = F.upper(F.trim(iso2))
    symbol = lambda at: F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substr(code, F.lit(at), F.lit(1))) + 101))
    return F.when(code.rlike("^[A-Z]{2}$"), F.decode(F.unhex(F.concat(symbol(1), symbol(2))), "UTF-8")).otherwise("")
