"""Sums over sliding windows against plain correlation, and recordings at rest."""

import numpy as np

from lapwing.operators import pairing


def test_sums_give_the_correlations():
    rng = np.random.default_rng(5)
    fixed, v = rng.normal(size=120).cumsum(), 300 + rng.normal(size=1500).cumsum()
    fixed[20:25], v[400:450], v[800:1500] = np.nan, np.nan, v[799]
    starts = np.arange(-300, 1600)[::-1]
    r, n, sure = pairing.slide(fixed, v, starts, 5)
    exact, count = pairing.pearson(np.broadcast_to(fixed, (len(starts), 120)), pairing._windows(v, starts, 120, 5))
    assert (n == count).all() and np.abs(r - exact)[sure].max() < 1e-8 and (exact[~sure] == -2).all() and sure.mean() > 0.7


def test_rest_is_no_correlation():
    x = np.full((1, 300), 61.7)
    x[0, 7] = np.nan
    assert pairing.pearson(x, x * 1.1)[0][0] == -2
