"""The attribution kernel: leaves that share a table, and slopes behind a logistic link."""

import numpy as np
import pytest

from colonnade.functions import shapley
from colonnade.functions.shapley import Ensemble, Leaf, shapley_values


def grown(rng, features, depth, trees, logistic=False):
    """Random trees; leaves lie one behind the other as in a fitted model."""
    leaves = []

    def go(box, left):
        if not left:
            names = sorted(box)
            leaves.append(Leaf(np.array(names, int), np.array([box[f][0] for f in names]), np.array([box[f][1] for f in names]), rng.normal()))
            return
        f = int(rng.integers(features))
        low, high = box.get(f, (-np.inf, np.inf))
        cut = float(np.clip(np.round(rng.normal(), 1), max(low, -4) + 0.05, min(high, 4) - 0.05))
        go({**box, f: (low, cut)}, left - 1)
        go({**box, f: (cut, high)}, left - 1)

    for _ in range(trees):
        go({}, depth)
    return Ensemble(leaves, features, logistic)


@pytest.mark.parametrize("logistic", [False, True])
@pytest.mark.parametrize("depth", [4, 12])
def test_leaves_that_share_a_table_give_what_single_leaves_give(logistic, depth, monkeypatch):
    rng = np.random.default_rng(3)
    ensemble = grown(rng, 14, depth, 1 if depth > 10 else 5, logistic)
    x, background = rng.normal(size=(300, 14)), rng.normal(size=(20, 14))
    x[::9, 2] = np.nan
    together = shapley_values(ensemble, x, background)
    assert len(ensemble.groups(shapley.cells_for(ensemble, len(x)))) < len(list(ensemble.leaves)) / (2 if depth < 10 else 1)
    for name in ("MOST_CELLS", "SCALED_CELLS"):
        monkeypatch.setattr(shapley, name, 1)
    alone = shapley_values(ensemble, x, background)
    assert np.abs(together - alone).max() < 1e-12
    assert np.abs(together.sum(axis=1) - (ensemble.output(x) - ensemble.output(background).mean())).max() < 1e-12


def test_slopes_of_near_margins_do_not_cancel():
    x = np.array([0.3, 0.3, -7.0, 800.0])
    scale = shapley._link_scale(x, x + np.array([1e-7, 0.0, 1e-5, 1e-3]))
    p = 1.0 / (1.0 + np.exp(-2.0 * 0.3))
    assert abs(scale[0, 0] - 2 * p * (1 - p) * (1 + 1e-7 * (1 - 2 * p))) < 1e-14 and abs(scale[1, 1] - 2 * p * (1 - p)) < 1e-15
    q = 1.0 / (1.0 + np.exp(14.0))
    assert abs(scale[2, 2] / (2 * q * (1 - q) * (1 + 1e-5 * (1 - 2 * q))) - 1) < 1e-9 and scale[3, 3] == 0.0
    x, z = np.linspace(-3, 3, 500), np.linspace(-2, 2, 100)
    narrow, basis = shapley._narrowed(x, z)
    assert basis.shape[1] < 30 and np.abs(narrow @ basis.T - shapley._link_scale(x, z)).max() < 1e-13
