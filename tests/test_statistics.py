from __future__ import annotations

import math

import numpy as np
import pytest

from spanrate.functions.quantiles import chi_square_quantile, chi_square_quantiles, t_quantile
from spanrate.operators import statistics as S
from spanrate.schemas import literal_frame


def poisson_at_least(d, mean):
    return 1 - sum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(d))


@pytest.mark.parametrize("d", [1, 2, 5, 17, 120, 900])
def test_exact_limits_solve_the_poisson_tails(d):
    low = chi_square_quantiles(0.025, np.array([2.0 * d]))[0] / 2
    high = chi_square_quantiles(0.975, np.array([2.0 * (d + 1)]))[0] / 2
    assert poisson_at_least(d, low) == pytest.approx(0.025, abs=1e-9)
    assert 1 - poisson_at_least(d + 1, high) == pytest.approx(0.025, abs=1e-9)


def test_chi_square_edges():
    found = chi_square_quantiles(0.025, np.array([0.0, -2.0, 2_000_000.0]))
    assert found[0] == 0
    assert math.isnan(found[1])
    # The normal approximation is good to a few parts in a million at this size.
    n = 2_000_000.0
    assert found[2] == pytest.approx(n * (1 - 2 / (9 * n) - 1.959964 * math.sqrt(2 / (9 * n))) ** 3, rel=1e-8)


def test_t_quantiles():
    expected = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 10: 2.228138852, 24: 2.063898562}
    for df, value in expected.items():
        assert t_quantile(0.975, df) == pytest.approx(value, abs=1e-8)


def pooled(spark, rows):
    df = literal_frame(spark, [("a", y, v) for y, v in rows], "g string, y double, v double")
    return S.pool_random_effects(df, ["g"]).collect()[0]


def test_pooling_one_study(spark):
    r = pooled(spark, [(1.5, 0.25)])
    assert (r.k, r.estimate, r.se, r.tau2, r.i2, r.predict_lower) == (1, 1.5, 0.5, 0.0, None, None)
    assert r.upper == pytest.approx(1.5 + 0.5 * 1.959963984540054)


def test_pooling_equal_studies_has_no_spread(spark):
    r = pooled(spark, [(1.0, 0.5), (1.0, 0.5)])
    assert (r.k, r.estimate, r.tau2, r.q, r.i2) == (2, 1.0, 0.0, 0.0, 0.0)
    assert r.se == pytest.approx(0.5)


def test_pooling_three_studies_by_hand(spark):
    rows = [(0.0, 0.1), (1.0, 0.2), (3.0, 0.4)]
    w = [1 / v for _, v in rows]
    mu = sum(y * a for (y, _), a in zip(rows, w)) / sum(w)
    q = sum(a * (y - mu) ** 2 for (y, _), a in zip(rows, w))
    tau2 = (q - 2) / (sum(w) - sum(a * a for a in w) / sum(w))
    w2 = [1 / (v + tau2) for _, v in rows]
    estimate = sum(y * a for (y, _), a in zip(rows, w2)) / sum(w2)
    se = 1 / math.sqrt(sum(w2))
    r = pooled(spark, rows)
    assert (r.k, r.tau2, r.estimate, r.se) == (
        3,
        pytest.approx(tau2),
        pytest.approx(estimate),
        pytest.approx(se),
    )
    assert r.i2 == pytest.approx((q - 2) / q)
    reach = t_quantile(0.975, 1) * math.sqrt(tau2 + se**2)
    assert r.predict_lower == pytest.approx(estimate - reach)


def test_pooling_leaves_out_what_is_not_finite(spark):
    r = pooled(spark, [(1.0, 0.5), (float("-inf"), 0.5), (2.0, float("inf")), (None, 1.0)])
    assert (r.k, r.estimate) == (1, 1.0)


def test_rates_add_half_an_event(spark):
    df = literal_frame(spark, [("a", 0.0, 100)], "g string, e double, y long")
    r = S.pool_rates(df, ["g"], "e", "y").collect()[0]
    assert r.rate == pytest.approx(0.5 / 100 * 100000)
    assert r.se == pytest.approx(math.sqrt(2))


def test_sum_is_null_with_a_null(spark):
    df = literal_frame(spark, [("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    found = {r.g: r.s for r in df.groupBy("g").agg(S.sum_or_null("x").alias("s")).collect()}
    assert found == {"a": None, "b": 2.0}


def test_ratio_without_observed_events(spark):
    df = literal_frame(
        spark, [(0.0, 2.0), (3.0, 2.0), (1.0, 0.0)], "observed double, expected double"
    )
    rows = {r.observed: r for r in S.exact_ratios(df).collect()}
    zero = rows[0.0]
    assert (zero.sir, zero.sir_lower) == (0.0, 0.0)
    assert zero.log_sir == float("-inf")
    assert zero.sir_upper == pytest.approx(-math.log(0.025) / 2)
    assert rows[3.0].sir == 1.5
    assert rows[1.0].sir is None


def test_halves_round_to_even(spark):
    df = literal_frame(
        spark,
        [(250, 1.0, 9, 9), (350, 1.0, 9, 9)],
        "person_years long, incidence_rate_p100py double,"
        " num_outcomes long, num_persons_w_outcome long",
    )
    found = {r.person_years: r.uncensored_outcomes for r in S.recovered_events(df).collect()}
    assert found == {250: 2.0, 350: 4.0}


def test_quantile_columns_equal_the_arrays(spark):
    degrees = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 11.0, 34.0, 90.0, 240.0, 1801.0, 20_000.0, 300_000.0]
    df = literal_frame(spark, [(d,) for d in [*degrees, -1.0, None]], "d double")
    from pyspark.sql import functions as F

    found = df.select("d", *[chi_square_quantile(p, F.col("d")).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r.d: r for r in found.collect()}
    for p, name in ((0.025, "low"), (0.975, "high")):
        for d, expected in zip(degrees, chi_square_quantiles(p, np.array(degrees)), strict=True):
            assert rows[d][name] == pytest.approx(expected, rel=1e-11, abs=1e-14)
    assert rows[-1.0].low is None and rows[None].high is None


def test_limits_stay_where_they_are_found(spark):
    """115 events: a bisection after Newton's last step left the lower limit 1e-6 too low."""
    from pyspark.sql import functions as F

    degrees = list(range(2, 802, 2))
    frame = spark.createDataFrame([(float(d),) for d in degrees], "d double")
    for p in (0.025, 0.975):
        found = {r.d: r.x for r in frame.select("d", chi_square_quantile(p, F.col("d")).alias("x")).collect()}
        for d, x in zip(degrees, chi_square_quantiles(p, np.array(degrees, float)), strict=True):
            assert abs(found[float(d)] - x) <= 1e-10 * x, (p, d)
