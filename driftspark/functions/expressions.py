"""Scalar column expressions of the transaction table.

All are built-in expressions (JVM side, whole-stage codegen).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Simplified FX rates to USD by currency code; unknown codes use 1.0.
FX_TO_USD = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "COP": 0.00026}
# Currency codes of the transaction table, in this order.
CURRENCIES = ("USD", "EUR", "GBP", "COP")
# Day-of-month seasons.
SEASONS = (("days_5_10", 5, 10), ("days_20_25", 20, 25))
SEASON_OTHER = "other"


def fx_rate(currency: Column) -> Column:
    """Rate to USD by currency code, 1.0 when unknown."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FX_TO_USD.items()))
    return F.coalesce(m[currency], F.lit(1.0))


def season_class(ts: Column) -> Column:
    """Season by day of month: 5-10, 20-25, other."""
    d = F.dayofmonth(ts)
    out = F.lit(SEASON_OTHER)
    for name, lo, hi in reversed(SEASONS):
        out = F.when((d >= lo) & (d <= hi), F.lit(name)).otherwise(out)
    return out


def converted_amount(amount: Column, fee: Column, rate: Column) -> Column:
    """round((amount - fee) * rate, 2)."""
    return money((amount - fee) * rate)


def money(x: Column) -> Column:
    """Rounded half up to cents as a decimal, so that binary noise does not decide halves."""
    return F.round(x.cast("decimal(24,6)"), 2).cast("double")


def partition_values(ts: Column) -> tuple[Column, Column]:
    """``dt`` = yyyy-MM-dd and ``hour`` = HH strings."""
    return F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH")


def flag01(b: Column) -> Column:
    """Boolean as 0/1 integer (null stays null)."""
    return b.cast("int")


def currency_of(key: Column) -> Column:
    """Currency code assigned to a row from an integer key (for tables without one)."""
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.pmod(key, F.lit(len(CURRENCIES))) + 1).cast("int"))
