"""Fixed-point money: micro-USD as long, rates in micro-USD per million tokens."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_micros(rate: Column, tokens: Column) -> Column:
    """Half-up rounded cost; 0 if either is not positive. Overflow is an error, not a wrap."""
    return F.when((rate > 0) & (tokens > 0), _div(rate * tokens + F.lit(500_000).cast("long"), 1_000_000)).otherwise(F.lit(0).cast("long"))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def format_usd(micros: Column) -> Column:
    """``d.dddddd`` with a minus sign in front of negative amounts."""
    whole = F.abs(micros)
    return F.concat(F.when(micros < 0, "-").otherwise(""), _div(whole, 1_000_000).cast("string"), F.lit("."), F.lpad((whole % 1_000_000).cast("string"), 6, "0"))


def parse_usd(text: str) -> int:
    """Micro-USD of a non-negative decimal amount with up to six places."""
    try:
        amount = Decimal(text.strip())
    except InvalidOperation as error:
        raise ValueError(f"invalid amount {text!r}") from error
    if not amount.is_finite() or amount.is_signed() or amount.as_tuple().exponent < -6:
        raise ValueError(f"invalid amount {text!r}")
    return int(amount * 1_000_000)


def tier_at(tiers: Column, tokens: Column) -> Column:
    """The last tier in list order that ``tokens`` reaches (an as-of lookup without a join)."""
    return F.element_at(F.filter(tiers, lambda t: tokens >= t["above"]), -1)


def modality_tiers(tiers: Column, by_modality: Column, modality: Column) -> Column:
    return F.coalesce(F.try_element_at(by_modality, modality), tiers)
