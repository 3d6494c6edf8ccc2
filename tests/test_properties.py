"""Invariants, over generated inputs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlane.functions import stats as S
from driftlane.operators import kernels, timeseries
from driftlane.streaming import online

P = st.lists(st.floats(0, 1), min_size=1, max_size=30)


@given(P, st.floats(0.01, 0.5))
def test_bonferroni_drift_is_fdr_drift(p, q):
    if min(p) < q / len(p):
        assert S.fdr_threshold(np.array(p), q) is not None


@given(st.integers(1, 60), st.integers(1, 60), st.floats(0, 1))
def test_tails_are_probabilities_and_fall(n, m, d):
    for alternative in ("two-sided", "greater"):
        for exact in (False, True):
            a, b = S.ks_sf(d, n, m, alternative, exact), S.ks_sf(min(1.0, d + 0.1), n, m, alternative, exact)
            assert 0 <= b <= a + 1e-9 <= 1 + 1e-9


@given(st.integers(0, 20), st.integers(0, 20), st.integers(0, 20), st.integers(0, 20))
def test_fisher_sides(a, b, c, d):
    greater, less = (S.fisher_exact(a, b, c, d, s)[1] for s in ("greater", "less"))
    assert 0 <= greater <= 1 and 0 <= less <= 1 and greater + less >= 1 - 1e-9


@given(st.integers(1, 40), st.floats(0.05, 0.95))
def test_binomial_tail_by_summation(n, p):
    for k in range(n + 1):
        assert S.binom_sf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), abs=1e-9)


@settings(deadline=None)
@given(st.integers(1, 200), st.integers(1, 100), st.integers(5, 50), st.integers(0, 5))
def test_permutations_mark_as_many_rows(n_ref, n_test, size, seed):
    tiles = math.ceil((n_ref + n_test) / size)
    marks = np.concatenate([kernels.tile_labels(t, n_ref, n_test, kernels.tile_shares(n_ref, n_test, 3, seed, size)[t], seed, size) for t in range(tiles)])
    assert marks.shape == (n_ref + n_test, 4) and (marks.sum(0) == n_test).all()


@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=50), st.floats(0.01, 0.99), st.sampled_from([6, 7, 8]))
def test_quantiles_lie_among_values(x, p, kind):
    if 1 / len(x) <= p <= (len(x) - 1) / len(x):
        assert min(x) - 1e-9 <= S.quantile(np.array(x), p, kind) <= max(x) + 1e-9


@given(st.lists(st.lists(st.floats(0, 1), min_size=4, max_size=4), min_size=8, max_size=30))
def test_conditional_thresholds_are_attained(runs):
    runs = np.array(runs)
    assert all(runs.min() <= t <= runs.max() for t in online.conditional_thresholds(runs, 0.25))


@given(st.integers(2, 30), st.integers(31, 60))
def test_saliency_keeps_length(window, n):
    x = np.random.default_rng(n).normal(size=n)
    assert timeseries.saliency(x, window).shape == (n,)
