"""Student's t and the inverse normal distribution as Columns: no Python, any number of rows.

They are written as SQL expressions of SQL expressions: such a Column is parsed in one step, where thousands of
Column calls would take seconds to build.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidemark.functions.pricing import HART_DEN, HART_LIMIT, HART_NUM, SQRT_2PI

# fixed values: rational approximation of the normal quantile (Acklam 2003), centre and tail
_CENTRE = ([-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00],
           [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0])
_TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00],
         [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0])
_TAIL_FROM = 0.02425
_TERMS = 300


def _num(x: float) -> str:
    return f"{x!r}D" if "e" not in repr(x) else f"CAST('{x!r}' AS DOUBLE)"


def _bind(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _poly(coefs: list[float], x: str) -> str:
    out = _num(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_num(c)})"
    return out


def _log_gamma(x: str) -> str:
    """ln of the gamma function of x > 0, to about 1e-12: Stirling's series eight steps up."""
    low = " * ".join(f"(lg + {k})" for k in range(8))
    series = "(lg + 7.5D) * ln(lg + 8) - (lg + 8) + " + _num(0.5 * math.log(2 * math.pi)) + f" + (1D / 12 - r * (1D / 360 - r * (1D / 1260 - r / 1680))) / (lg + 8) - ln({low})"
    return _bind("lg", f"CAST({x} AS DOUBLE)", _bind("r", "1D / ((lg + 8) * (lg + 8))", f"({series})"))


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta function, a fold of a fixed number of terms."""
    safe = lambda v: _bind("sv", v, "if(abs(sv) < 1e-300D, 1e-300D, sv)")

    def turn(state: str, num: str) -> str:
        return _bind("nu", num, f"named_struct('c', {safe(f'1D + nu / {state}.c')}, 'd', 1D / {safe(f'1D + nu * {state}.d')}, 'h', {state}.h)")
    grown = lambda s: f"named_struct('c', {s}.c, 'd', {s}.d, 'h', {s}.h * {s}.c * {s}.d)"
    even, odd = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))", f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    step = _bind("t1", turn("s", even), _bind("t2", grown("t1"), _bind("t3", turn("t2", odd), grown("t3"))))
    start = _bind("d0", f"1D / {safe(f'1D - ({a} + {b}) * {x} / ({a} + 1)')}", "named_struct('c', 1D, 'd', d0, 'h', d0)")
    return f"aggregate(CAST(sequence(1, {_TERMS}) AS ARRAY<DOUBLE>), {start}, (s, m) -> {step}, s -> s.h)"


def t_two_sided(t: str, df: str) -> Column:
    """P(|T| >= |t|) with df degrees of freedom (any positive number), both SQL expressions: the incomplete beta function at
    df / (df + t*t).  Null for a missing, NaN or infinite statistic and for df that is not positive."""
    front = f"exp({_log_gamma('v.a + 0.5D')} - {_log_gamma('v.a')} - {_num(0.5 * math.log(math.pi))} + v.a * ln(greatest(v.x, 1e-300D)) + 0.5D * ln(greatest(v.y, 1e-300D)))"
    near, far = f"f * {_beta_fraction('v.a', '0.5D', 'v.x')} / v.a", f"1D - f * {_beta_fraction('0.5D', 'v.a', 'v.y')} / 0.5D"
    tail = f"CASE WHEN v.y <= 0 THEN 1D WHEN v.x < (v.a + 1) / (v.a + 2.5D) THEN {near} ELSE {far} END"
    args = "named_struct('a', q.df / 2, 'x', q.df / (q.df + q.t * q.t), 'y', q.t * q.t / (q.df + q.t * q.t))"
    ok = "q.t IS NOT NULL AND NOT isnan(q.t) AND abs(q.t) < double('Infinity') AND q.df > 0"
    whole = f"CASE WHEN {ok} THEN {_bind('v', args, _bind('f', front, f'least(greatest({tail}, 0D), 1D)'))} END"
    return F.expr(_bind("q", f"named_struct('t', CAST({t} AS DOUBLE), 'df', CAST({df} AS DOUBLE))", whole))


def _cdf(x: str) -> str:
    tail = f"if(abs({x}) < {_num(HART_LIMIT)}, exp(-{x} * {x} / 2) * {_poly(HART_NUM, 'ax')} / {_poly(HART_DEN, 'ax')}, exp(-{x} * {x} / 2) / (ax + 1 / (ax + 2 / (ax + 3 / (ax + 4 / (ax + 0.65D))))) / {_num(SQRT_2PI)})"
    return _bind("ax", f"abs({x})", _bind("tl", tail, f"if({x} > 0, 1D - tl, tl)"))


def normal_probability(x: str) -> Column:
    """N(x) for an SQL expression."""
    return F.expr(_bind("nx", f"CAST({x} AS DOUBLE)", _cdf("nx")))


def normal_quantile(p: str) -> Column:
    """x with N(x) = p for 0 < p < 1, else null, p an SQL expression: a rational start and one step of Halley's rule."""
    low = lambda r: _bind("z", f"sqrt(-2 * ln({r}))", f"{_poly(_TAIL[0], 'z')} / {_poly(_TAIL[1], 'z')}")
    mid = _bind("z", "p - 0.5D", f"z * {_poly(_CENTRE[0], '(z * z)')} / {_poly(_CENTRE[1], '(z * z)')}")
    start = f"CASE WHEN p < {_TAIL_FROM}D THEN {low('p')} WHEN p > {1 - _TAIL_FROM}D THEN -{low('(1D - p)')} ELSE {mid} END"
    halley = _bind("u", f"({_cdf('x')} - p) * {_num(SQRT_2PI)} * exp(x * x / 2)", "x - u / (1D + x * u / 2)")
    return F.expr(_bind("p", f"CAST({p} AS DOUBLE)", f"CASE WHEN p > 0 AND p < 1 THEN {_bind('x', start, halley)} END"))
