"""Price columns: what a household pays, gets, and what an hour costs it at the margin. EUR/MWh in, EUR/kWh out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def consumer_price(spot: Column, transfer: Column, margin: float = 0.004, tax: float = 0.02253, vat: float = 1.255, clamp: bool = True) -> Column:
    """Spot (not below zero, if clamped) with margin, transfer and tax, times VAT."""
    return ((F.greatest(spot, F.lit(0.0)) if clamp else spot) / 1000 + margin + transfer + tax) * vat


def sell_price(spot: Column, commission: float = 0.003, fee: float = 0.0) -> Column:
    """What exported energy brings; it may be negative."""
    return spot / 1000 - commission - fee


def marginal_price(buy: Column, sell: Column, pv: Column, base: Column) -> Column:
    """Cost of one more kWh: from spare panel output first, which costs only a negative export price, then from the grid."""
    own = F.least(F.greatest(pv - base, F.lit(0.0)), F.lit(1.0))
    return own * F.least(sell, F.lit(0.0)) + (1 - own) * buy


def net_cost(buy: Column, sell: Column, pv: Column, load: Column) -> Column:
    """What an hour costs: bought energy less what is sold, own yield used first. A null yield or load makes 0, a null price null."""
    return F.greatest(load - pv, F.lit(0.0)) * buy - F.greatest(pv - load, F.lit(0.0)) * sell


def blended_price(buy: Column, sell: Column, pv: Column, demand: Column) -> Column:
    """Buy and sell price by the share of demand that panels give; all bought where there is no demand."""
    share = F.coalesce(F.least(F.greatest(F.try_divide(pv, demand), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return (1 - share) * buy + share * sell
