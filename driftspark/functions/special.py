"""Incomplete gamma and beta functions and their inverses as SQL templates for Spark.

One method at every size, no switch to an approximation for large parameters:

- ``stirling(z)``: lnGamma(z + 1) - (z ln z - z + ln(2 pi z) / 2), the remainder of
  Stirling's formula, from its asymptotic series at z + 10 carried back by recurrence.
  All terms are small, so nothing cancels.
- Incomplete gamma: the leading factor x^a e^-x / Gamma(a + 1) is written through
  mu - ln(1 + mu), mu = (x - a) / a, whose size is that of the exponent itself; powers of
  large numbers never meet. Below a + 1 the power series, above it the continued fraction,
  each with 40 + 10 sqrt(a) terms, which both need at most.
- Incomplete beta: the same factor in two variables, then the continued fraction on the
  side where it converges. Its inverse bisects the bracket [0, 1].

The oracle queries use other formulas for the same values (finite sums), see
``plans/oracle_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two pi; coefficients of Stirling's series; bisection steps of an inverse.
TWO_PI = 6.283185307179586
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 10
STEPS = 100


def _num(x: float) -> str:
    return f"{float(x)!r}D"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def stirling(z: str) -> str:
    """Remainder of Stirling's formula at z > 0."""
    back = " + ".join(f"log1p({_num(SHIFT - j)} / (({z}) + {_num(j)}))" for j in range(1, SHIFT))
    series = _num(0)
    for c in reversed(STIRLING):
        series = f"({_num(c)} + ({series}) / (_s * _s))"
    tail = bind(f"({z}) + {_num(SHIFT)}", "_s", f"({series}) / _s")
    return f"({tail} - {_num(SHIFT)} + (({z}) + 0.5D) * log1p({_num(SHIFT)} / ({z})) + {back})"


def gamma_upper(a: str, x: str) -> str:
    """Regularised upper incomplete gamma Q(a, x) for a > 0, x > 0 (names or plain numbers)."""
    n = f"cast(40 + ceil(10 * sqrt({a})) as bigint)"
    mu = f"(({x}) - ({a})) / ({a})"
    log = f"CASE WHEN ({x}) < ({a}) / 2 THEN ln(({x}) / ({a})) ELSE log1p({mu}) END"  # mu may round to -1
    factor = f"(exp(-({a}) * ({mu} - {log}) - {stirling(a)}) / sqrt({_num(TWO_PI)} * ({a})))"
    series = (f"aggregate(sequence(1L, {n}), named_struct('t', 1.0D, 's', 1.0D), "
              f"(_c, _n) -> named_struct('t', _c.t * ({x}) / (({a}) + _n), 's', _c.s + _c.t * ({x}) / (({a}) + _n))).s")
    fraction = (f"aggregate(sequence({n}, 1L, -1L), ({x}) + 2 * {n} + 1 - ({a}), "
                f"(_t, _n) -> ({x}) + 2 * _n - 1 - ({a}) - _n * (_n - ({a})) / _t)")
    return (f"CASE WHEN ({x}) < ({a}) + 1 THEN greatest(1.0D - {factor} * {series}, 0.0D) "
            f"ELSE least(greatest({factor} * ({a}) / {fraction}, 0.0D), 1.0D) END")


def chi2_sf_sql(x: str, k: str) -> str:
    """Upper tail of chi-squared with ``k`` > 0 degrees of freedom at ``x``, for any k."""
    body = gamma_upper("_g.a", "_g.x")
    both = f"named_struct('a', cast({k} as double) / 2, 'x', cast({x} as double) / 2)"
    return (f"CASE WHEN ({x}) IS NULL OR ({k}) IS NULL OR ({k}) < 1 THEN NULL WHEN ({x}) <= 0 THEN 1.0D "
            f"ELSE {bind(both, '_g', body)} END")


def _beta_side(a: str, b: str, x: str) -> str:
    """I_x(a, b) over the leading factor, by the continued fraction."""
    n = f"cast(40 + ceil(10 * sqrt(greatest({a}, {b}))) as bigint)"
    odd = f"-(({a}) + _m) * (({a}) + ({b}) + _m) * ({x}) / ((({a}) + 2 * _m) * (({a}) + 2 * _m + 1))"
    even = f"_m * (({b}) - _m) * ({x}) / ((({a}) + 2 * _m - 1) * (({a}) + 2 * _m))"
    # from the tail inwards: 1 + d(2m+1) / t, then 1 + d(2m) / that; m = 0 has the odd term only
    step = f"CASE WHEN _m = 0 THEN 1 + {odd} / _t ELSE 1 + ({even}) / (1 + ({odd}) / _t) END"
    return f"1 / (({a}) * aggregate(sequence({n}, 0L, -1L), 1.0D, (_t, _m) -> {step}))"


def beta_lower(a: str, b: str, x: str, fixed: str) -> str:
    """Regularised incomplete beta I_x(a, b), 0 < x < 1. ``fixed``: ``beta_fixed(a, b)``."""
    mean = f"(({a}) / (({a}) + ({b})))"
    log = (f"({a}) * log1p((({x}) - {mean}) / {mean}) + ({b}) * log1p(({mean} - ({x})) * (({a}) + ({b})) / ({b})) + ({fixed})")
    factor = f"exp({log})"
    return (f"CASE WHEN ({x}) < (({a}) + 1) / (({a}) + ({b}) + 2) THEN {factor} * {_beta_side(a, b, x)} "
            f"ELSE 1.0D - {factor} * {_beta_side(b, a, f'(1 - ({x}))')} END")


def beta_fixed(a: str, b: str) -> str:
    """What the leading factor's logarithm has besides x."""
    return (f"(0.5D * ln(({a}) * ({b}) / ({_num(TWO_PI)} * (({a}) + ({b})))) + {stirling(f'(({a}) + ({b}))')} "
            f"- {stirling(a)} - {stirling(b)})")


def beta_inverse(a: str, b: str, p: str) -> str:
    """x with I_x(a, b) = p, 0 < p < 1, by bisection of [0, 1]."""
    below = beta_lower("_q.a", "_q.b", "_b.m", "_q.f")
    step = bind(f"({below}) < _q.p", "_u", "named_struct('lo', IF(_u, _b.m, _b.lo), 'hi', IF(_u, _b.hi, _b.m), "
                                           "'m', IF(_u, (_b.m + _b.hi) / 2, (_b.lo + _b.m) / 2))")
    fold = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0.0D, 'hi', 1.0D, 'm', 0.5D), (_b, _i) -> {step}).m"
    with_f = bind(f"named_struct('a', cast({a} as double), 'b', cast({b} as double), 'p', cast({p} as double))", "_r",
                  bind(f"named_struct('a', _r.a, 'b', _r.b, 'p', _r.p, 'f', {beta_fixed('_r.a', '_r.b')})", "_q", fold))
    return with_f


def chi2_sf(x: str, k: str) -> Column:
    return F.expr(chi2_sf_sql(x, k))


def clopper_pearson(k: str, n: str, level: float = 0.95) -> tuple[Column, Column]:
    """Exact interval of a proportion with ``k`` hits in ``n`` (column names or SQL text).

    The bounds are quantiles of beta distributions; 0 for no hits and 1 for hits only.
    Null where n is null or 0, or k is null.
    """
    half = (1 - level) / 2
    bad = f"({k}) IS NULL OR ({n}) IS NULL OR ({n}) <= 0 OR ({k}) < 0 OR ({k}) > ({n})"
    low = f"CASE WHEN {bad} THEN NULL WHEN ({k}) = 0 THEN 0.0D ELSE {beta_inverse(k, f'({n}) - ({k}) + 1', _num(half))} END"
    high = f"CASE WHEN {bad} THEN NULL WHEN ({k}) = ({n}) THEN 1.0D ELSE {beta_inverse(f'({k}) + 1', f'({n}) - ({k})', _num(1 - half))} END"
    return F.expr(low), F.expr(high)


def normal_quantile(p: str) -> str:
    """z with Phi(z) = p, 0 < p < 1: bisection of [-40, 40] on the normal tail (Q(1/2, z^2 / 2))."""
    tail = f"0.5D * ({gamma_upper('0.5D', '_z.h')})"
    phi = bind("named_struct('h', greatest(_b.m * _b.m / 2, 1e-300D))", "_z", f"IF(_b.m < 0, {tail}, 1 - {tail})")
    step = bind(f"({phi}) < _q", "_u", "named_struct('lo', IF(_u, _b.m, _b.lo), 'hi', IF(_u, _b.hi, _b.m), "
                                       "'m', IF(_u, (_b.m + _b.hi) / 2, (_b.lo + _b.m) / 2))")
    fold = f"aggregate(sequence(1, 80), named_struct('lo', -40.0D, 'hi', 40.0D, 'm', 0.0D), (_b, _i) -> {step}).m"
    return f"CASE WHEN ({p}) IS NULL THEN NULL WHEN ({p}) <= 0 THEN -40.0D WHEN ({p}) >= 1 THEN 40.0D ELSE {bind(f'cast({p} as double)', '_q', fold)} END"


def normal_cdf(z: str) -> str:
    """Phi(z)."""
    tail = f"0.5D * ({gamma_upper('0.5D', '_z.h')})"
    return bind(f"named_struct('z', cast({z} as double), 'h', greatest(cast({z} as double) * ({z}) / 2, 1e-300D))", "_z",
                f"IF(_z.z < 0, {tail}, 1 - {tail})")
