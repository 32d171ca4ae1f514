"""Chi-square and Student t quantiles.

Reports use them as column expressions, on one row per site and outcome or per pooled group; the
array versions state the same and serve as their check.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_975 = 1.959963984540054
#: Newton's method doubles the digits; the cube-root start has three of them from one event on.
NEWTON_STEPS, FEW_EVENTS_STEPS = 7, 20
#: A step this small relative to the value is rounding.
SETTLED = 1e-12


def _gamma_log(a: np.ndarray) -> np.ndarray:
    """Log gamma by the Stirling series, shifted to arguments above 10."""
    x = a.astype(float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    inv = 1.0 / x
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, for a > 0 and x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - _gamma_log(a))
    steps = int(200 + 20 * np.sqrt(max(float(a.max(initial=1.0)), 1.0)))
    # Below a + 1 the power series converges, above it the continued fraction does.
    low = x < a + 1
    xs = np.where(low, x, 0.0)
    term = 1.0 / a
    total = term.copy()
    for n in range(1, steps):
        term = term * xs / (a + n)
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    else:
        raise ArithmeticError("the gamma series did not converge")
    series = total * front
    xf = np.where(low, a + 2.0, x)
    tiny = 1e-300
    b = xf + 1.0 - a
    c = np.full_like(xf, 1.0 / tiny)
    d = 1.0 / b
    h = d.copy()
    for n in range(1, steps):
        an = -n * (n - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    else:
        raise ArithmeticError("the gamma fraction did not converge")
    fraction = 1.0 - front * h
    return np.where(x <= 0, 0.0, np.where(low, series, fraction))


def chi_square_quantiles(p: float, df: np.ndarray) -> np.ndarray:
    """x with P(chi-square with ``df`` degrees <= x) = p; 0 for df = 0, NaN below."""
    df = np.asarray(df, float)
    out = np.where(df == 0, 0.0, np.nan)
    todo = df > 0
    if not todo.any():
        return out
    out[todo] = 2.0 * _gamma_quantiles(p, df[todo] / 2.0)
    return out


def _gamma_quantiles(p: float, a: np.ndarray) -> np.ndarray:
    """Newton steps from a cube-root normal start, kept inside a shrinking bracket."""
    low, high = np.zeros_like(a), a + 20.0 * np.sqrt(a) + 20.0
    z = -NORMAL_975 if p < 0.5 else NORMAL_975
    x = a * np.maximum(1 - 1 / (9 * a) + z / (3 * np.sqrt(a)), 0.05) ** 3
    for _ in range(100):
        miss = _gamma_cdf(a, x) - p
        low, high = np.where(miss < 0, x, low), np.where(miss < 0, high, x)
        slope = np.exp((a - 1) * np.log(x) - x - _gamma_log(a))
        step = x - miss / np.maximum(slope, 1e-300)
        inside = (step > low) & (step < high)
        after = np.where(inside, step, (low + high) / 2.0)
        done = (np.abs(after - x) <= 1e-13 * x) | (high - low <= 1e-14 * high) | (miss == 0)
        x = np.where(miss == 0, x, after)
        if done.all():
            return x
    raise ArithmeticError("the chi-square quantile did not converge")


def _t_upper(t: np.ndarray, df: int) -> np.ndarray:
    """P(|T| <= t) for whole degrees of freedom, a finite cosine sum."""
    angle = np.arctan(t / np.sqrt(df))
    cos2, total = np.cos(angle) ** 2, np.zeros_like(t)
    if df % 2:
        term = np.cos(angle)
        for k in range(1, (df - 1) // 2 + 1):
            total = total + term
            term = term * cos2 * (2 * k) / (2 * k + 1)
        return 2.0 / np.pi * (angle + np.sin(angle) * total)
    term = np.ones_like(t)
    for k in range(1, df // 2 + 1):
        total = total + term
        term = term * cos2 * (2 * k - 1) / (2 * k)
    return np.sin(angle) * total


def t_quantile(p: float, df: int) -> float:
    """Upper quantile (p > 0.5) of Student's t with whole degrees of freedom."""
    if df < 1:
        return float("nan")
    inside = 2.0 * p - 1.0
    low, high = np.array(0.0), np.array(1.0)
    while _t_upper(high, df) < inside:
        high = high * 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if _t_upper(middle, df) < inside:
            low = middle
        else:
            high = middle
    return float((low + high) / 2.0)


# The same as column expressions: loops are folds over sequences, values are bound by ``_with``.


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(n: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """The state after steps 1 to n."""
    state = F.struct(*[v.cast("double").alias(k) for k, v in start.items()])
    return F.aggregate(
        F.sequence(F.lit(1), n),
        state,
        lambda s, i: F.struct(*[v.cast("double").alias(k) for k, v in step(s, i.cast("double")).items()]),
    )


def _gamma_log_column(a: Column) -> Column:
    """Stirling's series at a + 10, taken back by ten factors."""
    shift = F.lit(0.0)
    for k in range(10):
        shift = shift + F.log(a + k)

    def series(x: Column) -> Column:
        inv = 1.0 / x
        square = inv * inv
        terms = inv * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
        return (x - 0.5) * F.log(x) - x + 0.5 * float(np.log(2 * np.pi)) + terms

    return _with(a + 10.0, series) - shift


def _gamma_cdf_column(a: Column, x: Column, gamma_log: Column) -> Column:
    """Regularised lower incomplete gamma function for a > 0 and x > 0."""
    front = F.exp(-x + a * F.log(x) - gamma_log)
    # Terms shrink like a normal density around a, so their number grows with its root.
    steps = (40 + 10 * F.sqrt(a)).cast("int")
    tiny = 1e-300

    def grow(s: Column, n: Column) -> dict[str, Column]:
        term = s["term"] * x / (a + n)
        return {"term": term, "total": s["total"] + term}

    def fraction(s: Column, n: Column) -> dict[str, Column]:
        an, b = -n * (n - a), s["b"] + 2.0
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        d = 1.0 / safe(an * s["d"] + b)
        c = safe(b + an / s["c"])
        return {"b": b, "c": c, "d": d, "h": s["h"] * d * c}

    series = _fold(steps, {"term": 1.0 / a, "total": 1.0 / a}, grow)["total"]
    first = x + 1.0 - a
    start = {"b": first, "c": F.lit(1.0 / tiny), "d": 1.0 / first, "h": 1.0 / first}
    return F.when(x < a + 1.0, front * series).otherwise(1.0 - front * _fold(steps, start, fraction)["h"])


def chi_square_quantile(p: float, df: Column) -> Column:
    """Column of chi-square quantiles; 0 at 0 degrees, NULL where ``df`` is NULL or negative.

    Newton steps from a cube-root normal start, kept inside a shrinking bracket.
    """
    z = -NORMAL_975 if p < 0.5 else NORMAL_975

    def solve(a: Column, gamma_log: Column) -> Column:
        root = F.greatest(1 - 1 / (9 * a) + z / (3 * F.sqrt(a)), F.lit(0.05))

        def step(s: Column, _: Column) -> dict[str, Column]:
            x = s["x"]

            def moved(miss: Column) -> Column:
                low = F.when(miss < 0, x).otherwise(s["low"])
                high = F.when(miss < 0, s["high"]).otherwise(x)
                slope = F.exp((a - 1) * F.log(x) - x - gamma_log)
                newton = x - miss / F.greatest(slope, F.lit(1e-300))
                inside = (newton > low) & (newton < high)
                # A value that is found stays: its next step may touch the bracket by rounding.
                found = (miss == 0) | (F.abs(newton - x) <= SETTLED * x)
                after = F.when(found, x).when(inside, newton).otherwise((low + high) / 2.0)
                return F.struct(after.alias("x"), low.alias("low"), high.alias("high"))

            state = _with(_gamma_cdf_column(a, x, gamma_log) - p, moved)
            return {name: state[name] for name in ("x", "low", "high")}

        start = {"x": a * root * root * root, "low": F.lit(0.0), "high": a + 20.0 * F.sqrt(a) + 20.0}
        n = F.when(a >= 1, NEWTON_STEPS).otherwise(FEW_EVENTS_STEPS)
        return 2.0 * _fold(n, start, step)["x"]

    half = df.cast("double") / 2.0
    found = _with(half, lambda a: _with(_gamma_log_column(a), lambda g: solve(a, g)))
    return F.when(df == 0, 0.0).when(df > 0, found)


#: Degrees of freedom whose quantiles are literals of the plan; groups are databases, so few.
LITERAL_DEGREES = 64


def t_quantile_975(df):
    """Column of 97.5 % t quantiles; NULL below one degree of freedom.

    The first ``LITERAL_DEGREES`` come from a list in the plan, any others from the expansion in
    powers of 1 / df, which is exact to nine digits there.
    """
    listed = F.array(*[F.lit(t_quantile(0.975, n)) for n in range(1, LITERAL_DEGREES + 1)])
    near = F.get(listed, (df - 1).cast("int"))
    z = NORMAL_975
    # Coefficients of the expansion of Student's quantile about the normal one.
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    far = F.lit(0.0)
    for term in reversed(terms):
        far = F.lit(term) + far / df
    return F.when(df <= LITERAL_DEGREES, near).otherwise(far)
