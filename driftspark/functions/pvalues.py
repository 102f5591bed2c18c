"""Distribution tails as pure SQL expressions.

SciPy is not available on executors, and a Python UDF for a p-value would pull a
per-group scalar through Arrow for nothing. Each tail is therefore written once as
an SQL template over higher-order list functions and rendered for two dialects:
``spark`` (used inside our plans through ``F.expr``) and ``duckdb`` (used by the
oracle queries). The results are evaluated once per group, never per input row.

Formulas
- Kolmogorov tail  Q(l) = 2 * sum_{k=1..100} (-1)^(k-1) exp(-2 k^2 l^2), 1 for l < 0.2.
- erfc(x), x >= 0: power series for x < 3, continued fraction (100 levels) above.
The chi-squared tail is an incomplete gamma function, see ``special``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_PI = 1.7724538509055159


class Dialect:
    """Tiny renderer for the few constructs that differ between the two engines."""

    def __init__(self, name: str):
        if name not in ("spark", "duckdb"):
            raise ValueError(name)
        self.name = name

    def seq(self, lo: str, hi: str) -> str:
        if self.name == "spark":
            return f"sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))"
        return f"generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))"

    def fold(self, arr: str, init: str, acc: str, x: str, body: str) -> str:
        if self.name == "spark":
            return f"aggregate({arr}, {init}, ({acc}, {x}) -> {body})"
        return f"list_reduce({arr}, lambda {acc}, {x}: {body}, {init})"

    def struct(self, **fields: str) -> str:
        if self.name == "spark":
            inner = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in fields.items())
            return f"named_struct({inner})"
        inner = ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in fields.items())
        return "{" + inner + "}"

    def keep(self, arr: str, x: str, cond: str) -> str:
        if self.name == "spark":
            return f"filter({arr}, {x} -> {cond})"
        return f"list_filter({arr}, lambda {x}: {cond})"

    def reverse(self, arr: str) -> str:
        return f"reverse({arr})" if self.name == "spark" else f"list_reverse({arr})"


def kolmogorov_sf_sql(lam: str, d: Dialect) -> str:
    """Tail of the Kolmogorov limit law at ``lam``."""
    body = f"acc + CASE WHEN k % 2 = 1 THEN 1.0e0 ELSE -1.0e0 END * exp(-2.0e0 * k * k * ({lam}) * ({lam}))"
    series = d.fold(d.seq("1", "100"), "CAST(0.0e0 AS DOUBLE)", "acc", "k", body)
    return (f"(CASE WHEN ({lam}) IS NULL THEN NULL WHEN ({lam}) < 0.2e0 THEN 1.0e0 "
            f"ELSE least(greatest(2.0e0 * {series}, 0.0e0), 1.0e0) END)")


def erfc_sql(x: str, d: Dialect) -> str:
    """Complementary error function for x >= 0 (callers pass an absolute value)."""
    # power series: erfc = 1 - 2/sqrt(pi) * x * exp(-x^2) * sum_n (2x^2)^n / (2n+1)!!
    step = d.struct(t=f"acc.t * 2.0e0 * ({x}) * ({x}) / (2.0e0 * n + 1.0e0)",
                    s=f"acc.s + acc.t * 2.0e0 * ({x}) * ({x}) / (2.0e0 * n + 1.0e0)")
    series = d.fold(d.seq("1", "200"), d.struct(t="1.0e0", s="1.0e0"), "acc", "n", step) + ".s"
    small = f"(1.0e0 - 2.0e0 / {SQRT_PI!r}e0 * ({x}) * exp(-({x}) * ({x})) * {series})"
    # continued fraction evaluated from the tail: t = x + (k/2) / t
    cf = d.fold(d.reverse(d.seq("1", "100")), f"CAST({x} AS DOUBLE)", "acc", "k",
                f"({x}) + (k / 2.0e0) / acc")
    large = f"(exp(-({x}) * ({x})) / ({SQRT_PI!r}e0 * {cf}))"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < 3.0e0 THEN greatest({small}, 0.0e0) "
            f"ELSE {large} END)")


def normal_two_sided_sql(z: str, d: Dialect) -> str:
    """Two-sided normal tail 2*(1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return f"least({erfc_sql(f'abs({z}) / sqrt(2.0e0)', d)}, 1.0e0)"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def kolmogorov_sf(lam: Column | str) -> Column:
    return F.expr(kolmogorov_sf_sql(_name(lam), SPARK))


def normal_two_sided(z: Column | str) -> Column:
    return F.expr(normal_two_sided_sql(_name(z), SPARK))


def erfc(x: Column | str) -> Column:
    return F.expr(erfc_sql(_name(x), SPARK))


def _name(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`" if c.isidentifier() else c
    raise TypeError("pass the column name (the tail is rendered as SQL text)")
