"""Small fixed dimensions: sources, indicator catalog, bounds, aliases, code lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.session import constant

# Catalog of the panel adapters.
CATALOG_SCHEMA = (
    "source string, indicator_code string, indicator_name string, category string, unit string, "
    "frequency string, concept string, metric_type string, transformation string, "
    "observation_basis string, price_basis string, coverage_definition string, "
    "seasonal_adjustment string, is_primary boolean, notes string"
)
CATALOG_ROWS = [
    ("orders", "ORD.REV", "Order revenue,,", "trade", "US$", "monthly", "revenue", "currency_level", "none",
     "period_total", "nominal", "not_applicable", "not_seasonally_adjusted", True, "gross"),
    ("orders", "ORD.AOV", "Average order value (US$)", "trade", "US$", "monthly", "revenue", "currency_per_capita",
     "none", "period_average", "nominal", "not_applicable", "not_applicable", False, None),
    ("orders", "ORD.CNT", "Orders placed", "trade", "orders", "monthly", "orders", "index", "none",
     "period_total", "not_applicable", "national_definition", "not_applicable", True, None),
    ("lines", "ORD.CNT", "Order lines shipped", "trade", "lines", "monthly", "orders", "index", "none",
     "period_total", "not_applicable", "general_government", "not_applicable", False, None),
    ("lines", "LIN.DISC", "Mean discount ;", "financial", "%", "monthly", "discount_rate", "rate", "none",
     "period_average", "not_applicable", "not_applicable", "seasonally_adjusted", True, None),
    ("lines", "LIN.QTY", "Units shipped", "trade", None, "monthly", None, None, None,
     None, None, None, None, False, None),
]


def catalog(spark: SparkSession) -> DataFrame:
    return constant(spark, CATALOG_SCHEMA, CATALOG_ROWS)


SOURCES_SCHEMA = "source string, base_url string, is_active boolean, last_run timestamp"
SOURCES_ROWS = [
    ("orders", "https://orders.example", True, dt.datetime(2001, 8, 1, 6, 30)),
    ("lines", "https://lines.example", True, dt.datetime(2001, 7, 20, 18, 5)),
    ("events", "https://events.example", False, None),
]


def sources(spark: SparkSession) -> DataFrame:
    return constant(spark, SOURCES_SCHEMA, SOURCES_ROWS)


# Plausible range of each value kind, both ends allowed.
BOUNDS = [
    ("percent_change", -100.0, 1e7),
    ("percent_share", -1000.0, 1000.0),
    ("rate", -50.0, 1e6),
    ("index", 0.0, 1e12),
    ("currency", -1e15, 1e15),
    ("count", 0.0, 1e12),
]


def bounds(spark: SparkSession) -> DataFrame:
    return constant(spark, "kind string, low double, high double", BOUNDS)


# Closed vocabularies of the catalog metadata.
VOCABULARIES = {
    "metric_type": ["percent_change", "percent_of_gdp", "percent_of_labor_force", "rate", "index",
                    "currency_level", "currency_per_capita", "exchange_rate"],
    "transformation": ["none", "year_over_year", "month_over_month", "quarter_over_quarter"],
    "observation_basis": ["period_average", "end_of_period", "period_total", "point_in_time"],
    "price_basis": ["nominal", "real", "ppp", "not_applicable"],
    "coverage_definition": ["ilo_modelled", "national_definition", "oecd_harmonised",
                            "general_government", "central_government", "not_applicable"],
    "seasonal_adjustment": ["seasonally_adjusted", "not_seasonally_adjusted", "not_applicable"],
}

# Two-letter codes that name groupings rather than countries.
GROUPING_ISO2 = ["XM", "EU", "XK", "ZZ"]

# Three-letter grouping codes that must never be stored as countries.
GROUPING_CODES = """
AFE AFW ARB CEB CSS EAP EAR EAS ECA ECS EMU EUU HPC IBD IBT IDA
IDB IDX LAC LCN LDC LMY LTE MEA MIC MNA NAC OED OSS PRE PSS PST
SAS SSA SSF SST TEA TEC TLA TMN TSA TSS WLD LIC LMC UMC HIC INX
HIY DEV EAA EDE EDI EDX EMD SSP LAP AME ECH SAP MNH WLT
AFR CEE EUR WEO
""".split()

# Economies classed as advanced.
ADVANCED = """
AND AUS AUT BEL CAN CHE CYP CZE DEU DNK ESP EST FIN FRA GBR GRC HKG IRL ISL ISR
ITA JPN KOR LTU LUX LVA MAC MLT NLD NOR NZL PRI PRT SGP SMR SVK SVN SWE TWN USA
""".split()

# Provider registry.
SEED_SOURCES = [
    ("world_bank", "https://api.worldbank.org/v2", True),
    ("imf", "https://www.imf.org/external/datamapper/api/v1", False),
    ("fred", "https://api.stlouisfed.org/fred", False),
    ("bis", "https://stats.bis.org/api/v2", False),
    ("wb_databank", "https://api.worldbank.org/v2", False),
]

# Indicators every installation starts with (code, name, category, unit).
SEED_INDICATORS = [
    ("NY.GDP.MKTP.KD.ZG", "GDP growth (annual %)", "macroeconomic", "%"),
    ("FP.CPI.TOTL.ZG", "Inflation, consumer prices (annual %)", "macroeconomic", "%"),
    ("NY.GDP.PCAP.CD", "GDP per capita (current US$)", "macroeconomic", "US$"),
    ("SL.UEM.TOTL.ZS", "Unemployment, total (% of labor force)", "social", "%"),
    ("NE.EXP.GNFS.ZS", "Exports of goods and services (% of GDP)", "trade", "%"),
    ("NE.IMP.GNFS.ZS", "Imports of goods and services (% of GDP)", "trade", "%"),
    ("GC.DOD.TOTL.GD.ZS", "Central government debt, total (% of GDP)", "financial", "%"),
    ("BN.CAB.XOKA.GD.ZS", "Current account balance (% of GDP)", "financial", "%"),
]

# Territories the registry lacks.
SEED_TERRITORIES = [
    ("TWN", "Taiwan, Province of China", "East Asia & Pacific", "High income", "Advanced"),
    ("WBG", "West Bank and Gaza", "Middle East, North Africa, Afghanistan & Pakistan",
     "Lower middle income", "Developing"),
    ("UVK", "Kosovo", "Europe & Central Asia", "Upper middle income", "Emerging"),
]

# Keyed series (id, country, indicator, name, unit, kind, declared frequency).
KEYED_SERIES = [
    ("FEDFUNDS", "USA", "FRED.POLRATE", "Policy interest rate (%)", "%", "rate", "monthly"),
    ("UNRATE", "USA", "FRED.UNRATE", "Unemployment rate (%)", "%", "percent_share", "monthly"),
    ("CPIAUCSL", "USA", "FRED.CPI", "Consumer price index (1982-84=100)", "index", "index", "monthly"),
    ("IRLTLT01USM156N", "USA", "FRED.GOV10Y", "10-year government bond yield (%)", "%", "rate", "monthly"),
    ("IRLTLT01DEM156N", "DEU", "FRED.GOV10Y", "10-year government bond yield (%)", "%", "rate", "monthly"),
    ("IRLTLT01GBM156N", "GBR", "FRED.GOV10Y", "10-year government bond yield (%)", "%", "rate", "monthly"),
    ("IRLTLT01JPM156N", "JPN", "FRED.GOV10Y", "10-year government bond yield (%)", "%", "rate", "monthly"),
    ("LRHUTTTTDEM156S", "DEU", "FRED.UNRATE", "Unemployment rate (%)", "%", "percent_share", "monthly"),
    ("LRHUTTTTJPM156S", "JPN", "FRED.UNRATE", "Unemployment rate (%)", "%", "percent_share", "monthly"),
]

# Monthly monitor indicators (code, name, unit, kind).
MONITOR_INDICATORS = [
    ("DPANUSSPB", "Exchange rate, LCU per US$, period average", "LCU/US$", "currency"),
    ("CPTOTSAXNZGY", "CPI Price, % y-o-y, nominal, seas. adj.", "%", "percent_change"),
    ("IPTOTSAKD", "Industrial production, constant US$, seasonally adjusted", "US$", "currency"),
    ("DSTKMKTXD", "Stock market index, US$", "index", "index"),
]


def grouping_codes(spark: SparkSession) -> DataFrame:
    return constant(spark, "entity string", [(c,) for c in GROUPING_CODES])


def reference_dims(spark: SparkSession, countries: DataFrame) -> dict[str, DataFrame]:
    """Seed rows; territories are added only where the registry lacks them."""
    registry = constant(spark, "source string, base_url string, is_active boolean", SEED_SOURCES)
    values = constant(
        spark, "indicator_code string, indicator_name string, category string, unit string", SEED_INDICATORS
    ).withColumn("source", F.lit("world_bank"))
    indicators = values.join(registry.select("source"), "source").withColumn("frequency", F.lit("annual"))
    extra = constant(
        spark, "entity string, entity_name string, region string, income string, imf_class string",
        SEED_TERRITORIES,
    )
    missing = extra.join(countries.select("entity"), "entity", "left_anti")
    return {
        "sources": registry, "indicators": indicators,
        "countries": countries.unionByName(missing, allowMissingColumns=True),
    }
