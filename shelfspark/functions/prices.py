"""Price expressions over nested price details and resolved price entries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import uuid_str

#: Catalogue currencies, ISO fraction digits and the bounds that stand for no price.
CATALOG_CURRENCIES = ("eur", "chf", "huf", "pln", "gbp", "czk", "cny")
FRACTION_DIGITS = {"EUR": 2, "USD": 2, "GBP": 2, "CHF": 2, "HUF": 2, "PLN": 2, "CZK": 2, "CNY": 2, "JPY": 0}
MAX_PRICE = 3.4028234e38

_DEC = "decimal(18,6)"


def single_unit_price(details: Column) -> Column:
    """Price of the least minimum quantity per unit; entries without a price are skipped."""
    steps = F.filter(details["prices"]["staggeredPrices"], lambda s: s["price"].isNotNull())
    ranked = F.array_sort(
        F.transform(steps, lambda s: F.struct(F.coalesce(s["minQuantity"].try_cast(_DEC), F.lit(0).cast(_DEC)).alias("q"), s["price"].try_cast(_DEC).alias("p")))
    )
    per = F.coalesce(F.nullif(details["priceQuantity"].try_cast(_DEC), F.lit(0).cast(_DEC)), F.when(details["priceQuantity"].isNull() | (details["priceQuantity"].try_cast(_DEC) == 0), F.lit(1).cast(_DEC)))
    return F.get(ranked, F.lit(0))["p"] / per


def pricing_priority(kind: Column) -> Column:
    known = F.when(kind == "CLOSED", 2).when(kind == "GROUP", 3).when(kind == "DEDICATED", 4)
    return known.otherwise(1)


def project_pricing(details: Column) -> Column:
    """Price entry (price, currency, priority, sourcePriceListId), null without a price."""
    price = single_unit_price(details).cast("double")
    entry = F.struct(
        price.alias("price"),
        F.coalesce(details["prices"]["currencyCode"], F.lit("")).alias("currency"),
        pricing_priority(details["type"]).alias("priority"),
        F.coalesce(uuid_str(details["sourcePriceListId"]), F.lit("")).alias("sourcePriceListId"),
    )
    return F.when(details.isNotNull() & price.isNotNull(), entry)


def envelope(prices: Column, currency: str) -> tuple[Column, Column]:
    """Least and greatest price of a currency within a row, the outer bounds if it has none."""
    own = F.transform(F.filter(prices, lambda p: F.lower(p["currency"]) == currency), lambda p: p["price"])
    return F.coalesce(F.array_min(own), F.lit(MAX_PRICE)), F.coalesce(F.array_max(own), F.lit(-MAX_PRICE))


def resolve_price(prices: Column, currency: str, lists: list[str]) -> Column:
    """Price of the entry of highest priority in the currency and lists, the first of equal ones."""
    if not lists:
        return F.lit(None).cast("double")
    fit = F.filter(prices, lambda p: (F.upper(p["currency"]) == currency.upper()) & p["sourcePriceListId"].isin(*lists))
    ranked = F.transform(fit, lambda p, i: F.struct(F.coalesce(p["priority"], F.lit(0)).alias("r"), (-i).alias("i"), p["price"].alias("price")))
    return F.array_max(ranked)["price"]


def decode_minor_units(value: int, currency: str) -> Decimal:
    """Minor units as an amount; an unknown currency is an error."""
    digits = FRACTION_DIGITS.get(currency.upper())
    if digits is None:
        raise ValueError(f"no fraction digits for currency {currency!r}")
    return Decimal(int(value)).scaleb(-digits)


def passes_price_filter(prices: Column, currency: str, lists: list[str], bound_currency: str, low: int | None, high: int | None) -> Column:
    """Whether a resolved price exists and lies within inclusive bounds in minor units."""
    price = resolve_price(prices, currency, lists)
    ok = price.isNotNull()
    if low is not None:
        ok &= price >= float(decode_minor_units(low, bound_currency))
    if high is not None:
        ok &= price <= float(decode_minor_units(high, bound_currency))
    return F.coalesce(ok, F.lit(False))


def price_list_ids(prices: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(prices, lambda p: p["sourcePriceListId"]), lambda x: x.isNotNull() & (x != ""))))


def currencies(prices: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(prices, lambda p: F.lower(p["currency"])), lambda x: x.isNotNull() & (x != ""))))
