"""Everyday wording of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmark.session import constant

# Phrasings and the one concept each means.
ALIASES = {
    "economic_growth": "gdp_growth",
    "growth": "gdp_growth",
    "output_growth": "gdp_growth",
    "real_gdp_growth": "gdp_growth",
    "gdp_growth_rate": "gdp_growth",
    "gdp_per_head": "gdp_per_capita",
    "per_capita_gdp": "gdp_per_capita",
    "per_capita_income": "gdp_per_capita",
    "income_per_person": "gdp_per_capita",
    "income_per_capita": "gdp_per_capita",
    "average_income": "gdp_per_capita",
    "living_standards": "gdp_per_capita",
    "debt": "government_debt",
    "public_debt": "government_debt",
    "national_debt": "government_debt",
    "sovereign_debt": "government_debt",
    "gross_debt": "government_debt",
    "debt_to_gdp": "government_debt",
    "debt_burden": "government_debt",
    "government_borrowing": "government_debt",
    "jobless": "unemployment",
    "joblessness": "unemployment",
    "unemployed": "unemployment",
    "out_of_work": "unemployment",
    "consumer_price_inflation": "inflation",
    "cpi_inflation": "inflation",
    "price_inflation": "inflation",
    "cost_of_living": "inflation",
    "consumer_price_index": "price_level",
    "consumer_prices": "price_level",
    "price_index": "price_level",
    "cpi_index": "price_level",
    "central_bank_rate": "policy_rate",
    "policy_interest_rate": "policy_rate",
    "monetary_policy_rate": "policy_rate",
    "benchmark_rate": "policy_rate",
    "base_rate": "policy_rate",
    "bank_rate": "policy_rate",
    "official_rate": "policy_rate",
    "government_bond_yield": "bond_yield",
    "bond_yields": "bond_yield",
    "sovereign_yield": "bond_yield",
    "long_term_interest_rate": "bond_yield",
    "ten_year_yield": "bond_yield",
    "10_year_yield": "bond_yield",
    "yield": "bond_yield",
    "fx": "exchange_rate",
    "fx_rate": "exchange_rate",
    "currency": "exchange_rate",
    "currency_rate": "exchange_rate",
    "dollar_exchange_rate": "exchange_rate",
    "usd_exchange_rate": "exchange_rate",
    "current_account_balance": "current_account",
    "external_balance": "current_account",
    "balance_of_payments": "current_account",
    "export": "exports",
    "import": "imports",
    "stock_market": "equity_market",
    "stock_market_index": "equity_market",
    "stock_prices": "equity_market",
    "share_prices": "equity_market",
    "equity_prices": "equity_market",
    "equities": "equity_market",
    "manufacturing_output": "industrial_production",
    "industrial_output": "industrial_production",
    "factory_output": "industrial_production",
}

# Phrasings that mean several concepts and are never guessed.
AMBIGUOUS = {
    "gdp": ["gdp_growth", "gdp_per_capita"],
    "gross_domestic_product": ["gdp_growth", "gdp_per_capita"],
    "economic_output": ["gdp_growth", "gdp_per_capita"],
    "economy_size": ["gdp_growth", "gdp_per_capita"],
    "cpi": ["inflation", "price_level"],
    "prices": ["inflation", "price_level"],
    "price": ["inflation", "price_level"],
    "interest_rate": ["policy_rate", "bond_yield"],
    "interest_rates": ["policy_rate", "bond_yield"],
    "borrowing_costs": ["policy_rate", "bond_yield"],
    "trade": ["exports", "imports", "current_account"],
    "trade_balance": ["exports", "imports", "current_account"],
}

# Requests that name something the catalog cannot supply at all.
NOT_HELD = {
    "gdp": "No total-output level is held, only its growth and its value per head.",
    "gross_domestic_product": "No total-output level is held, only its growth and its value per head.",
    "trade_balance": "No net trade balance is held, only exports, imports and the current account.",
}


def aliases(spark: SparkSession, singles: dict[str, str] = ALIASES, several: dict[str, list[str]] = AMBIGUOUS) -> DataFrame:
    """alias, concept, ambiguous, position: one row per concept an alias can mean."""
    rows = [(alias, concept, False, 0) for alias, concept in singles.items()]
    rows += [(alias, concept, True, i) for alias, concepts in several.items() for i, concept in enumerate(concepts)]
    return constant(spark, "alias string, concept string, ambiguous boolean, position int", rows)


def not_held(spark: SparkSession, notes: dict[str, str] = NOT_HELD) -> DataFrame:
    return constant(spark, "alias string, note string", list(notes.items()))
