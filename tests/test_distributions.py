"""Tails and quantiles against published values and against integration of the densities."""

import itertools
import math

import pytest

from quaymark.functions import distributions as d
from quaymark.operators import metrics


def integral(f, a, b, steps=20_000):
    h = (b - a) / steps
    return h / 3 * sum(f(a + i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))


def t_density(v):
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    return lambda x: c * (1 + x * x / v) ** (-(v + 1) / 2)


# Published 97.5 % and 99.5 % points of t, and closed forms for one and two degrees of freedom.
@pytest.mark.parametrize(("share", "v", "want"), [(0.975, 1, 12.706204736432095), (0.975, 2, 4.302652729911275), (0.975, 5, 2.5705818366147395), (0.975, 10, 2.2281388519649385), (0.975, 30, 2.0422724563012373), (0.995, 10, 3.1692726726169514), (0.75, 1, 1.0), (0.975, 1e7, 1.9599642)])
def test_t_quantiles(share, v, want):
    assert d.t_quantile(share, v) == pytest.approx(want, rel=1e-9 if v < 1e6 else 1e-6)


@pytest.mark.parametrize("v", [1, 2, 3, 7, 24, 120, 5000])
@pytest.mark.parametrize("t", [0.0, 0.1, 1.0, 2.5, 6.0])
def test_t_tails(t, v):
    assert d.t_two_sided(t, v) == pytest.approx(1 - 2 * integral(t_density(v), 0, t), abs=1e-9)
    if v == 1:
        assert d.t_two_sided(t, v) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-14)
    if v == 2:
        assert d.t_two_sided(t, v) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-14)


@pytest.mark.parametrize(("x", "v", "want"), [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (5.991464547107979, 2, 0.05), (15.50731305586545, 8, 0.05), (0.0, 3, 1.0), (124.34211340400407, 100, 0.05), (61.6541, 20, None)])
def test_chi_squared_tails(x, v, want):
    if want is None or v > 1:
        c = math.exp(-math.lgamma(v / 2)) / 2 ** (v / 2)
        assert d.chi2_tail(x, v) == pytest.approx(1 - integral(lambda u: c * u ** (v / 2 - 1) * math.exp(-u / 2), 0, x), abs=1e-9)
    if want is not None:
        assert d.chi2_tail(x, v) == pytest.approx(want, abs=1e-9)
    assert d.chi2_tail(4.2, 2) == pytest.approx(math.exp(-2.1), rel=1e-13) and d.chi2_tail(2.7, 1) == pytest.approx(math.erfc(math.sqrt(1.35)), rel=1e-12)


@pytest.mark.parametrize("ranks", [[1.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.5, 1.5, 3.0], [2.0, 2.0, 2.0, 4.5, 4.5, 6.0, 7.0, 8.0]])
def test_signed_ranks_equal_all_signs(ranks):
    sums = [sum(r for r, up in zip(ranks, signs, strict=True) if up) for signs in itertools.product([0, 1], repeat=len(ranks))]
    for w in set(sums):
        far = abs(w - sum(ranks) / 2)
        assert d.signed_rank_two_sided(w, ranks) == pytest.approx(sum(abs(s - sum(ranks) / 2) >= far - 1e-12 for s in sums) / len(sums), abs=1e-15)
    # a fixed value of the published tables: 10 pairs, sum 8 of the lesser sign
    assert d.signed_rank_two_sided(8, list(map(float, range(1, 11)))) == pytest.approx(0.048828125)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "a double, b double")


def test_reports_are_one_row_whatever_the_rows(spark):
    one = lambda pairs: tuple(metrics.paired_tests(rows(spark, pairs), "a", "b").first())
    assert one([]) == (0, None, None, None, None, None)
    assert one([(1.0, 0.5)]) == (1, 0.5, None, None, 1.0, 1.0)
    assert one([(1.0, 1.0)] * 5) == (5, 0.0, None, 1.0, None, 1.0)
    assert one([(1.5, 1.0)] * 5 + [(None, 1.0)])[:4] == (5, 0.5, None, 0.0)
    got = one([(float(i + (i % 3)), float(i)) for i in range(12)])
    assert got[0] == 12 and got[5] == round(d.signed_rank_two_sided(36, [2.5] * 4 + [6.5] * 4), 9)
    many = one([(float(i % 7), 3.1) for i in range(300)])
    assert many[3] == pytest.approx(d.t_two_sided(many[2], 299), abs=1e-4) and 0 < many[5] < 1
    bounds = lambda v: tuple(metrics.interval(spark.createDataFrame([(x,) for x in v], "v double"), "v").first())
    assert bounds([]) == (0, None, None, None, None) and bounds([2.0, None]) == (1, 2.0, None, None, None) and bounds([3.0, 3.0]) == (2, 3.0, 0.0, 3.0, 3.0)
    low, high = bounds([1.0, 2.0])[3:]
    assert high - low == pytest.approx(12.706204736432095, abs=1e-5)
    gate = metrics.gate(spark.createDataFrame([], "y int, p double, ms double"), "ms", 5.0).collect()
    assert len(gate) == 1 and gate[0]["p95"] is None and gate[0]["accuracy"] == 0.0
    same = spark.createDataFrame([(1, 0.9, 0.9)], "y int, p double, q double")
    assert metrics.mcnemar_test(same).first()["p_value"] == 1.0
