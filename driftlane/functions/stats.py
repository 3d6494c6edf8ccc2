"""Distribution tails with the standard library and numpy alone.

They turn statistics that Spark has aggregated into p-values: a few numbers per
feature, never rows of data.
"""

from __future__ import annotations

import math

import numpy as np


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300  # continued fraction (Lentz)
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-squared distribution; 1 without freedom."""
    return 1.0 if dof <= 0 else gammaincc(dof / 2, x / 2)


def kolmogorov_sf(d: float, n: int) -> float:
    """P(D_n >= d) of the two-sided one-sample statistic: the matrix method of
    Marsaglia, Tsang and Wang for moderate n * d**2, the tail's leading term beyond."""
    if d <= 0 or n < 1:
        return 1.0
    if d >= 1:
        return 0.0
    s = d * d * n
    if s > 18:
        return 0.0 if s > 370 else min(1.0, 2 * math.exp(-2 * s))
    if s > 4 or n > 3000:
        # the limit with the usual correction of the argument
        z = d * math.sqrt(n) + 1 / (6 * math.sqrt(n)) + (d * math.sqrt(n) - 1) / (4 * n)
        return kolmogorov_limit_sf(z)
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    i, j = np.indices((m, m))
    mat = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    mat[:, 0] -= powers
    mat[-1, :] -= powers[::-1]
    mat[-1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    fact = np.array([math.lgamma(x + 1) for x in range(m + 1)])
    gap = i - j + 1
    mat = np.where(gap > 0, mat * np.exp(-fact[np.clip(gap, 0, m)]), mat)
    result, scale, power, pscale, e = np.eye(m), 0, mat, 0, n
    while e:
        if e & 1:
            result, scale = result @ power, scale + pscale
        power, pscale = power @ power, 2 * pscale
        e >>= 1
        if power[k - 1, k - 1] > 1e140:
            power, pscale = power * 1e-140, pscale + 140
        if result[k - 1, k - 1] > 1e140:
            result, scale = result * 1e-140, scale + 140
    value = result[k - 1, k - 1]
    if value <= 0:
        return 1.0
    return min(1.0, max(0.0, 1 - math.exp(math.log(value) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n))))


def kolmogorov_limit_sf(z: float) -> float:
    if z <= 0:
        return 1.0
    if z < 1:
        t = math.pi**2 / (8 * z * z)
        return max(0.0, 1 - math.sqrt(2 * math.pi) / z * sum(math.exp(-((2 * k - 1) ** 2) * t) for k in range(1, 8)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 12))))


def ks_sf(d: float, n: int, m: int, alternative: str = "two-sided", exact: bool = False) -> float:
    """p-value of the two-sample Kolmogorov-Smirnov statistic.

    Asymptotic: the one-sample tail at the rounded effective size (two-sided), or
    Hodges' expansion (one-sided). ``exact`` counts lattice paths.
    """
    if exact:
        return _ks_paths(d, n, m, alternative != "two-sided")
    m, n = max(n, m), min(n, m)
    en = m * n / (m + n)
    if alternative == "two-sided":
        return kolmogorov_sf(d, round(en))
    z = math.sqrt(en) * d
    return min(1.0, max(0.0, math.exp(-2 * z * z - 2 * z * (m + 2 * n) / math.sqrt(m * n * (m + n)) / 3)))


def _ks_paths(d: float, n: int, m: int, one_sided: bool) -> float:
    """Share of interleavings of n and m values whose statistic reaches d."""
    lcm = n * m // math.gcd(n, m)
    reach = round(d * lcm)
    if reach <= 0:
        return 1.0
    j = np.arange(m + 1, dtype=np.int64)
    row = np.zeros(m + 1)
    log = 0.0
    for i in range(n + 1):
        gap = i * (lcm // n) - j * (lcm // m)
        inside = (gap < reach) if one_sided else (np.abs(gap) < reach)
        if i == 0:
            row = np.cumprod(inside.astype(float))
        else:
            # a path is cut where it leaves: sums run over stretches inside
            first = int(np.argmax(inside)) if inside.any() else m + 1
            row = np.where(inside, row, 0.0)
            row[first:] = np.cumsum(row[first:])
            row = np.where(inside, row, 0.0)
        top = row.max()
        if top <= 0:
            return 1.0
        row /= top
        log += math.log(top)
    if row[m] <= 0:
        return 1.0
    share = math.log(row[m]) + log - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
    return min(1.0, max(0.0, 1 - math.exp(share)))


def _bessel_k(order: float, x: float) -> float:
    """exp(-x) K_order(x), by quadrature of its integral form."""
    t = np.linspace(0, 12 if x < 1e-2 else min(12.0, 3 + 4 / math.sqrt(x)), 4001)
    y = np.exp(-x * (np.cosh(t) + 1)) * np.cosh(order * t)
    return float(np.trapezoid(y, t))


def cvm_limit_sf(x: float) -> float:
    """Upper tail of the limiting Cramer-von Mises distribution."""
    total, k = 0.0, 0
    while True:
        y = 4 * k + 1
        q = y * y / (16 * x)
        term = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / (math.pi**1.5 * math.sqrt(x)) * math.sqrt(y) * _bessel_k(0.25, q)
        total += term
        k += 1
        if abs(term) < 1e-10 or k > 200:
            return max(0.0, 1 - total)


def cvm_sf(t: float, n: int, m: int) -> float:
    """p-value of the two-sample Cramer-von Mises statistic T: exact while both
    samples have 20 values at most, else the limit after matching moments."""
    if max(n, m) <= 20:
        return _cvm_exact(t, n, m)
    total, k = n + m, n * m
    mean = (1 + 1 / total) / 6
    var = (total + 1) * (4 * k * total - 3 * (n * n + m * m) - 2 * k) / (45 * total**2 * 4 * k)
    x = 1 / 6 + (t - mean) / math.sqrt(45 * var)
    return 1.0 if x < 0.003 else min(1.0, cvm_limit_sf(x))


def _cvm_exact(t: float, n: int, m: int) -> float:
    """By the number of interleavings for each sum of (i m - j n)**2."""
    goal = t * n * m * (n + m) ** 2
    rows: list[dict[int, int]] = [{} for _ in range(m + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                rows[0] = {0: 1}
                continue
            add = (i * m - j * n) ** 2
            new: dict[int, int] = {}
            for source in ([rows[j]] if i else []) + ([rows[j - 1]] if j else []):
                for s, c in source.items():
                    new[s + add] = new.get(s + add, 0) + c
            rows[j] = new
    counts = rows[m]
    return sum(c for s, c in counts.items() if s >= goal - 1e-6 * max(1, abs(goal))) / sum(counts.values())


def _around(mode: int, low: int, high: int, up) -> tuple[int, np.ndarray]:
    """(first count, probabilities from there on) of a distribution with one mode,
    of all counts that aren't beyond the reach of a double. ``up(k)`` is p(k + 1) /
    p(k); sums go outwards from the mode, so the number of terms grows with the
    deviation and not with the counts behind it."""

    def side(step: int) -> np.ndarray:
        parts, k, last = [], mode, 1.0
        while last > 1e-300 and (k < high if step > 0 else k > low):
            n = min(4096, high - k if step > 0 else k - low)
            at = k + np.arange(n, dtype=float) if step > 0 else k - 1 - np.arange(n, dtype=float)
            terms = last * np.cumprod(up(at) if step > 0 else 1 / up(at))
            parts.append(terms)
            k, last = k + step * n, float(terms[-1])
        return np.concatenate(parts) if parts else np.zeros(0)

    below, above = side(-1), side(1)
    p = np.concatenate([below[::-1], [1.0], above])
    return mode - len(below), p / p.sum()


def hypergeom_pmf(total: int, marked: int, drawn: int) -> tuple[int, np.ndarray]:
    """Least count of any weight, and probabilities from there on."""
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    mode = min(max((drawn + 1) * (marked + 1) // (total + 2), low), high)
    rest = total - marked - drawn
    return _around(mode, low, high, lambda k: (marked - k) * (drawn - k) / ((k + 1) * (rest + k + 1)))


def hypergeom_cdf(k: int, total: int, marked: int, drawn: int) -> float:
    low, p = hypergeom_pmf(total, marked, drawn)
    return float(p[: max(0, k - low + 1)].sum())


def fisher_exact(a: int, b: int, c: int, d: int, alternative: str = "greater") -> tuple[float, float]:
    """(odds ratio, p-value) of the table [[a, b], [c, d]]."""
    odds = math.nan if (a + b == 0 or c + d == 0 or a + c == 0 or b + d == 0) else (a * d / (b * c) if b * c else math.inf)
    if math.isnan(odds):
        return odds, 1.0
    low, p = hypergeom_pmf(a + b + c + d, a + c, a + b)
    at = a - low
    if alternative == "greater":
        q = p[max(0, at) :].sum()
    elif alternative == "less":
        q = p[: max(0, at + 1)].sum()
    else:
        q = p[p <= p[at] * (1 + 1e-7)].sum() if 0 <= at < len(p) else 0.0
    return odds, float(min(1.0, q))


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    low, q = _around(min(int((n + 1) * p), n), 0, n, lambda k: (n - k) / (k + 1) * (p / (1 - p)))
    return float(min(1.0, q[max(0, k - low) :].sum()))


def chi2_table(rows: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value, degrees of freedom) of a table of counts, with Yates'
    correction at one degree. Empty rows and columns are left out."""
    t = np.asarray(rows, float)
    t = t[t.sum(1) > 0][:, t.sum(0) > 0]
    dof = (t.shape[0] - 1) * (t.shape[1] - 1) if t.size else 0
    if dof <= 0:
        return 0.0, 1.0, 0
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    gap = np.abs(t - e)
    if dof == 1:
        gap = gap - np.minimum(0.5, gap)
    x = float((gap**2 / e).sum())
    return x, chi2_sf(x, dof), dof


def quantile(values: np.ndarray, p: float, kind: int = 7, interpolate: bool = True) -> float:
    """Sample quantile of Hyndman and Fan's types 6, 7 and 8. ``p`` must leave a
    value on either side: 1/N <= p <= (N-1)/N."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 1 / n <= p <= (n - 1) / n:
        raise ValueError("p must lie between 1/N and (N-1)/N")
    shift = {6: p, 7: 1 - p, 8: (p + 1) / 3}
    if kind not in shift:
        raise ValueError("type 6, 7 or 8")
    at = n * p + shift[kind] - 1
    low = int(math.floor(at))
    if not interpolate:
        return float(x[min(max(low, 0), n - 1)])
    return float(x[low] + (at - low) * (x[min(low + 1, n - 1)] - x[low]))


def fdr_threshold(p_values: np.ndarray, q: float) -> float | None:
    """Benjamini and Hochberg's threshold q i / n of the last p-value below its
    own; None if none is."""
    p = np.sort(np.asarray(p_values, float))
    bars = q * np.arange(1, len(p) + 1) / len(p)
    below = np.flatnonzero(p < bars)
    return float(bars[below.max()]) if len(below) else None
