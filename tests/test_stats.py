import math
from itertools import combinations

import numpy as np
import pytest

from driftlane.functions import stats as S


@pytest.mark.parametrize(("x", "dof", "want"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (9.210340371976182, 2, 0.01), (0, 3, 1.0), (4.0, 4, math.exp(-2) * 3)])
def test_chi2(x, dof, want):
    assert S.chi2_sf(x, dof) == pytest.approx(want, rel=1e-9)


def test_kolmogorov():
    assert 1 - S.kolmogorov_sf(0.274, 10) == pytest.approx(0.6284796154565, rel=1e-10)
    for d in (0.01, 0.02, 0.03, 0.05):  # both methods where they meet
        assert S.kolmogorov_sf(d, 3000) == pytest.approx(S.kolmogorov_sf(d, 3001), abs=1e-3)
    assert S.kolmogorov_sf(0, 5) == 1 and S.kolmogorov_sf(1, 5) == 0


def _interleavings(n, m):
    for at in combinations(range(n + m), n):
        x = np.zeros(n + m, int)
        x[list(at)] = 1
        yield np.cumsum(x) / n - np.cumsum(1 - x) / m


@pytest.mark.parametrize(("n", "m"), [(5, 5), (4, 7), (6, 3)])
def test_exact_ks_by_enumeration(n, m):
    gaps = list(_interleavings(n, m))
    for d in sorted({round(float(np.abs(g).max()), 12) for g in gaps}):
        assert S.ks_sf(d, n, m, exact=True) == pytest.approx(np.mean([np.abs(g).max() >= d - 1e-9 for g in gaps]), abs=1e-9)
        assert S.ks_sf(d, n, m, "greater", exact=True) == pytest.approx(np.mean([g.max() >= d - 1e-9 for g in gaps]), abs=1e-9)


def test_exact_and_asymptotic_ks_agree():
    assert S.ks_sf(0.1, 400, 300, exact=True) == pytest.approx(S.ks_sf(0.1, 400, 300), abs=0.01)
    assert S.ks_sf(0.1, 400, 300, "greater", exact=True) == pytest.approx(S.ks_sf(0.1, 400, 300, "greater"), abs=0.01)


def test_cvm():
    assert S.cvm_limit_sf(0.46136) == pytest.approx(0.05, abs=1e-5)
    assert S.cvm_limit_sf(0.74346) == pytest.approx(0.01, abs=1e-5)
    n, m = 4, 5
    all_t = [n * m / (n + m) ** 2 * float((g**2).sum()) for g in _interleavings(n, m)]
    for t in sorted(set(round(x, 12) for x in all_t)):
        assert S.cvm_sf(t, n, m) == pytest.approx(np.mean([x >= t - 1e-9 for x in all_t]), abs=1e-9)


def test_fisher():
    odds, p = S.fisher_exact(8, 2, 1, 5, "two-sided")
    assert (odds, p) == (20.0, pytest.approx(0.034965034965))
    assert S.fisher_exact(8, 2, 1, 5)[1] == pytest.approx(0.0244755244755)
    assert S.fisher_exact(8, 2, 1, 5, "less")[1] == pytest.approx(0.9991258741)
    assert math.isnan(S.fisher_exact(0, 0, 1, 5)[0])


def test_binomial():
    assert S.binom_sf(60, 100, 0.5) == pytest.approx(0.0284439668204906)
    assert S.binom_sf(0, 10, 0.3) == 1 and S.binom_sf(11, 10, 0.3) == 0


def test_table():
    x, p, dof = S.chi2_table(np.array([[10, 20], [20, 10]]))
    assert dof == 1 and x == pytest.approx(5.4) and p == pytest.approx(0.0201367, abs=1e-6)  # with Yates
    assert S.chi2_table(np.array([[10, 20, 0], [20, 10, 0]]))[2] == 1
    assert S.chi2_table(np.array([[5, 5]])) == (0.0, 1.0, 0)


def test_quantiles():
    x = np.arange(1.0, 11)
    assert S.quantile(x, 0.5) == np.quantile(x, 0.5) and S.quantile(x, 0.3, 6) == pytest.approx(3.3)
    assert S.quantile(x, 0.3, 8) == pytest.approx(np.quantile(x, 0.3, method="median_unbiased"))
    assert S.quantile(x, 0.35, 6, interpolate=False) in x
    with pytest.raises(ValueError):
        S.quantile(x, 0.01)


@pytest.mark.parametrize("q", [0.05, 0.1, 0.25])
def test_fdr_is_strict(q):
    assert S.fdr_threshold(np.full(1000, q - 1e-5), q) == pytest.approx(q)
    assert S.fdr_threshold(np.full(1000, q), q) is None


def test_tails_of_large_tables():
    """Terms follow the deviation, not the rows."""
    n = 10**9
    low, p = S.hypergeom_pmf(2 * n, n, n)
    assert len(p) < 3_000_000 and p.sum() == pytest.approx(1)
    assert low + float((np.arange(len(p)) * p).sum()) == pytest.approx(n / 2, rel=1e-9)
    dev = math.sqrt(n / 8)  # of the count
    assert S.fisher_exact(n // 2 + int(2 * dev), n // 2 - int(2 * dev), n // 2 - int(2 * dev), n // 2 + int(2 * dev))[1] == pytest.approx(0.02275, rel=1e-3)
    assert S.fisher_exact(n, 0, 0, n)[1] == 0 and S.fisher_exact(0, n, n, 0, "two-sided")[1] == 0 and S.fisher_exact(0, n, n, 0)[1] == 1
    assert S.binom_sf(n // 2 + int(math.sqrt(n)), n, 0.5) == pytest.approx(0.02275, rel=1e-3)
    assert S.binom_sf(n, n, 0.5) == 0
