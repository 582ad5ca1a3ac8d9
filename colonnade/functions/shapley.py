"""Shapley values of tree ensembles against a background: the kernel run inside tasks.

For one leaf, one row x and one background row z only the features on the
leaf's path matter. Hybrids of x and z reach the leaf exactly if every path
feature that z fails is taken from x and every one that x fails is taken from z,
so a leaf's share of the Shapley value follows from two counts: features only x
satisfies, and features only z satisfies. Where the leaf can be reached, these are the features that z fails and those
that x fails, so one follows from the pattern of z and the other from that of x.

Neighbouring leaves of a tree share most of their path, so they are explained together: the bounds of their conditions cut
the features into cells, a table has what all of them give a row of each cell, and a row is one look into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial, prod

import numpy as np

# Rows explained at a time where each pair has its own scale; bounds the row-by-background matrices.
CHUNK = 131_072
# Rows that look into the tables at a time, so that what they read and add up stays in the cache.
LOOKS = 16_384
# Cells of a table of several leaves, at most, and how many rows there are for each; fewer where each pair has its own scale.
MOST_CELLS, ROWS_A_CELL = 4096, 4
SCALED_CELLS, SCALED_ROWS = 4096, 16
LEAST_CELLS = 256
# How far slopes may be off, all of which are 0.5 at most, where they are kept as a product of narrow matrices.
NARROWED = 1e-13
# Paths of at most so many features have their patterns counted in a table.
TABLE_BITS = 12
# Paths of at most so many have the weights of all pairs of patterns in a table: 8 MB for the longest.
PAIR_BITS = 10


@dataclass(frozen=True)
class Leaf:
    """A leaf as a box: ``low < x[feature] <= high`` for the features on its path."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float

    def satisfied(self, x: np.ndarray) -> np.ndarray:
        part = x[:, self.features]
        return ((part > self.low) & (part <= self.high)).astype(float)


@dataclass(frozen=True)
class Group:
    """Leaves that are explained together: their features, how many cells each has and what a rank adds to the number of the
    cell; and by leaf the axes of its features, the bits that a cell meets, and its value."""

    features: list[int]
    shape: list[int]
    steps: list[np.ndarray]
    leaves: list[tuple[list[int], np.ndarray, float]]

    def cell(self, ranks: list[np.ndarray]) -> np.ndarray:
        found = np.zeros(len(ranks[0]) if ranks else 0, np.int64)
        part = np.empty_like(found)
        for f, step in zip(self.features, self.steps):
            # No rank lies outside, so nothing is clipped; this is the mode that writes without a copy.
            found += step.take(ranks[f], out=part, mode="clip")
        return found


class Ensemble:
    """Leaves whose values add up over the trees; ``logistic`` marks margins of log-odds halves.

    The leaves are kept in flat arrays, so that a large forest travels to the
    tasks as a few buffers.
    """

    def __init__(self, leaves: Sequence[Leaf], n_features: int, logistic: bool = False):
        self.n_features, self.logistic = n_features, logistic
        self.depth = max((len(leaf.features) for leaf in leaves), default=0)
        self._ends = np.cumsum([len(leaf.features) for leaf in leaves], dtype=np.int64)
        self._features = np.concatenate([np.zeros(0, np.int32), *[leaf.features for leaf in leaves]]).astype(np.int32)
        self._low = np.concatenate([np.zeros(0), *[leaf.low for leaf in leaves]])
        self._high = np.concatenate([np.zeros(0), *[leaf.high for leaf in leaves]])
        self._values = np.array([leaf.value for leaf in leaves], dtype=float)
        self._groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._cells: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        # The bounds that features are compared with, and each condition as places among them: from, to.
        self._grids, self._from, self._to = [], np.zeros(len(self._low), np.int64), np.zeros(len(self._low), np.int64)
        for f in range(n_features):
            mine = np.flatnonzero(self._features == f)
            bounds = np.concatenate([self._low[mine], self._high[mine]])
            grid = np.unique(bounds[np.isfinite(bounds)])
            self._grids.append(grid)
            self._from[mine] = np.where(np.isfinite(self._low[mine]), np.searchsorted(grid, self._low[mine]) + 1, 0)
            self._to[mine] = np.searchsorted(grid, self._high[mine])

    def ranks(self, x: np.ndarray) -> list[np.ndarray]:
        """By feature, how many bounds lie below each row's value; a value that is not a number is above all ranks."""
        out = []
        for f, grid in enumerate(self._grids):
            rank = np.searchsorted(grid, x[:, f], side="left")
            rank[np.isnan(x[:, f])] = len(grid) + 1
            out.append(rank)
        return out

    def patterns(self, *ranked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, float, tuple[np.ndarray, ...]]]:
        """For each leaf its features, its value and, for each table of ranks, a bit per condition that a row meets."""
        # By feature and bound, who is above it: one byte per row, the same for all leaves.
        above = [[[(rank >= i).view(np.uint8) for i in range(len(grid) + 2)] for rank, grid in zip(ranks, self._grids)] for ranks in ranked]
        # A value that is no number is above every bound, also the last one; where there is none, no row is.
        odd = [[bool(len(rank)) and int(rank.max()) > len(grid) for rank, grid in zip(ranks, self._grids)] for ranks in ranked]
        start = 0
        for end, value in zip(self._ends.tolist(), self._values.tolist()):
            features = self._features[start:end]
            kind = np.uint8 if end - start <= 8 else np.uint16 if end - start <= 16 else np.int64
            conditions = list(zip(features.tolist(), self._from[start:end].tolist(), self._to[start:end].tolist()))
            found = []
            for ranks, sides, unknown in zip(ranked, above, odd):
                code = np.zeros(len(ranks[0]) if ranks else 0, kind)
                for k, (f, low, high) in enumerate(conditions):
                    met = sides[f][low]
                    if high < len(self._grids[f]) or unknown[f]:
                        met = (met > sides[f][high + 1]).view(np.uint8)
                    code |= met if not k else met * kind(1 << k)
                found.append(code)
            yield features, value, tuple(found)
            start = end

    def groups(self, most: int) -> list[tuple[int, int]]:
        """Runs of leaves (from, to) whose conditions make at most ``most`` cells; leaves of long paths stay alone."""
        key = most, PAIR_BITS
        if key not in self._groups:
            found, start, kinds = [], 0, {}
            ends = [0, *self._ends.tolist()]
            features, low, high = self._features.tolist(), self._from.tolist(), self._to.tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                new = dict(kinds)
                for f, condition in zip(features[a:b], zip(low[a:b], high[a:b])):
                    before = new.get(f, ((), 1))
                    if condition not in before[0]:
                        every = (*before[0], condition)
                        new[f] = every, len(self._cells_of(f, every)[1])
                long = b - a > PAIR_BITS
                if i > start and (long or prod(n for _, n in new.values()) > most):
                    found.append((start, i))
                    start = i
                    new = {f: ((c,), len(self._cells_of(f, (c,))[1])) for f, c in zip(features[a:b], zip(low[a:b], high[a:b]))}
                kinds = new
                if long:
                    found.append((i, i + 1))
                    start, kinds = i + 1, {}
            if start < len(self._ends):
                found.append((start, len(self._ends)))
            self._groups[key] = found
        return self._groups[key]

    def long(self, leaf: int) -> bool:
        return self._ends[leaf] - (self._ends[leaf - 1] if leaf else 0) > PAIR_BITS

    def path(self, leaf: int, *ranked: list[np.ndarray]) -> tuple:
        """Features and value of a leaf and, for each table of ranks, a bit per condition that a row meets."""
        a, b = (int(self._ends[leaf - 1]) if leaf else 0), int(self._ends[leaf])
        conditions = list(zip(self._features[a:b].tolist(), self._from[a:b].tolist(), self._to[a:b].tolist()))
        codes = (sum(((ranks[f] >= low) & (ranks[f] <= high)).astype(np.int64) << k for k, (f, low, high) in enumerate(conditions)) for ranks in ranked)
        return [f for f, _, _ in conditions], float(self._values[leaf]), *codes

    def _cells_of(self, feature: int, conditions: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each rank of a feature, and which of the conditions (columns) each cell meets."""
        key = feature, conditions
        if key not in self._cells:
            rank = np.arange(len(self._grids[feature]) + 2)
            code = sum(((rank >= low) & (rank <= high)).astype(np.int64) << i for i, (low, high) in enumerate(conditions))
            kinds, cell = np.unique(code, return_inverse=True)
            self._cells[key] = cell.astype(np.int64), ((kinds[:, None] >> np.arange(len(conditions))) & 1).astype(np.int64)
        return self._cells[key]

    def group(self, start: int, end: int) -> Group:
        ends = [0, *self._ends[start:end].tolist()] if not start else self._ends[start - 1:end].tolist()
        conditions: dict[int, list[tuple[int, int]]] = {}
        leaves = []
        for a, b, value in zip(ends, ends[1:], self._values[start:end].tolist()):
            of = list(zip(self._features[a:b].tolist(), self._from[a:b].tolist(), self._to[a:b].tolist()))
            for f, low, high in of:
                known = conditions.setdefault(f, [])
                if (low, high) not in known:
                    known.append((low, high))
            if of:
                leaves.append((of, value))
        features = sorted(conditions)
        cells, meets = zip(*(self._cells_of(f, tuple(conditions[f])) for f in features)) if features else ((), ())
        shape = [len(m) for m in meets]
        axis, strides = {f: i for i, f in enumerate(features)}, [prod(shape[i + 1:]) for i in range(len(shape))]
        met = []
        for of, value in leaves:
            code = np.zeros([1] * len(features), np.int64)
            for k, (f, low, high) in enumerate(of):
                side = [-1 if i == axis[f] else 1 for i in range(len(features))]
                code = code + (meets[axis[f]][:, conditions[f].index((low, high))] << k).reshape(side)
            met.append(([axis[f] for f, _, _ in of], code, value))
        return Group(features, shape, [c * s for c, s in zip(cells, strides)], met)

    @property
    def leaves(self) -> Iterator[Leaf]:
        start = 0
        for end, value in zip(self._ends, self._values):
            yield Leaf(self._features[start:end], self._low[start:end], self._high[start:end], value)
            start = end

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for features, value, (codes,) in self.patterns(self.ranks(x)):
            total += value * (codes == (1 << len(features)) - 1)
        return total

    def output(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return 1.0 / (1.0 + np.exp(-2.0 * raw)) if self.logistic else raw


def leaves_of(nodes: Iterable[dict], weight: float) -> list[Leaf]:
    """Boxes of one tree. A node has id, value and, unless a leaf, left, right, feature, threshold."""
    by_id = {n["id"]: n for n in nodes}
    found: list[Leaf] = []
    pending: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
    while pending:
        node_id, box = pending.pop()
        node = by_id[node_id]
        if node["left"] < 0:
            features = sorted(box)
            found.append(Leaf(
                np.array(features, dtype=int), np.array([box[f][0] for f in features]),
                np.array([box[f][1] for f in features]), weight * node["value"],
            ))
            continue
        feature, threshold = node["feature"], node["threshold"]
        low, high = box.get(feature, (-np.inf, np.inf))
        pending.append((node["left"], {**box, feature: (low, min(high, threshold))}))
        pending.append((node["right"], {**box, feature: (max(low, threshold), high)}))
    return found


def _weights(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a feature only the row, or only the background row, satisfies, by the two counts."""
    own, other = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1):
            if a:
                own[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                other[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return own, other


def shapley_values(ensemble: Ensemble, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Rows x features, averaged over the background; rows sum to output minus mean background output."""
    if ensemble.logistic:
        return _scaled_values(ensemble, x, background)
    own, other = _weights(ensemble.depth)
    values, ways = np.zeros((ensemble.n_features, len(x))), _Ways(own, other)
    ranks, ranks_z = ensemble.ranks(x), ensemble.ranks(background)
    most, taken = cells_for(ensemble, len(x)), np.empty(min(LOOKS, len(x)))
    for start, end in ensemble.groups(most):
        if ensemble.long(start):
            _add_long(ensemble, start, ranks, ranks_z, own, other, values)
            continue
        group = ensemble.group(start, end)
        if not group.features:
            continue
        # What some leaves give a row depends only on its cell: far fewer than rows.
        behind = group.cell(ranks_z)
        table = np.zeros((len(group.features), *group.shape))
        for axes, met, value in group.leaves:
            size = len(axes)
            given = _given(np.broadcast_to(met, group.shape).reshape(-1)[behind], size, ways[size]) * value
            for k, axis in enumerate(axes):
                table[axis] += given[k].take(met)
        table = table.reshape(len(group.features), -1)
        for a in range(0, len(x), LOOKS):
            cell = group.cell([rank[a:a + LOOKS] for rank in ranks])
            there = taken[:len(cell)]
            for row, f in zip(table, group.features):
                values[f, a:a + LOOKS] += row.take(cell, out=there, mode="clip")
    return values.T / len(background)


def cells_for(ensemble: Ensemble, rows: int) -> int:
    """Cells of a table at most, where so many rows look into it: a power of two, so that few groupings are made."""
    most, each = (SCALED_CELLS, SCALED_ROWS) if ensemble.logistic else (MOST_CELLS, ROWS_A_CELL)
    return min(most, max(LEAST_CELLS, 1 << max(rows // each, 1).bit_length() - 1))


class _Ways(dict):
    """By the length of a path the weights of all pairs of patterns."""

    def __init__(self, own: np.ndarray, other: np.ndarray):
        super().__init__()
        self.own, self.other = own, other

    def __missing__(self, size: int) -> tuple[np.ndarray, ...]:
        every = np.arange(1 << size)
        self[size] = _pairs(every, every, size, self.own, self.other)
        return self[size]


def _add_long(ensemble: Ensemble, leaf: int, ranks, ranks_z, own: np.ndarray, other: np.ndarray, values: np.ndarray) -> None:
    """Adds what a leaf gives whose path is too long for a table of all patterns: only those that occur are worked out."""
    features, value, codes, behind = ensemble.path(leaf, ranks, ranks_z)
    patterns, pattern_of = _distinct(codes, len(features))
    theirs, place = np.unique(behind, return_inverse=True)
    given = _given(place, len(features), _pairs(patterns, theirs, len(features), own, other)) * value
    for k, feature in enumerate(features):
        values[feature] += given[k].take(pattern_of)


def _pairs(patterns: np.ndarray, theirs: np.ndarray, size: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights by background pattern and row pattern, 0 where they do not reach the leaf together; and the bits of both."""
    in_x, in_z = _bits(patterns, size), _bits(theirs, size)
    fails_x, fails_z = (size - in_x.sum(1)).astype(int)[None, :], (size - in_z.sum(1)).astype(int)[:, None]
    reached = _reached(patterns, theirs, size).T
    return own[fails_z, fails_x] * reached, other[fails_z, fails_x] * reached, np.ascontiguousarray(in_x.T), 1.0 - in_z


def _given(behind: np.ndarray, size: int, pairs: tuple[np.ndarray, ...]) -> np.ndarray:
    """What a leaf of value 1 gives each of its features, by the pattern of the row."""
    gains, losses, in_x, fails_z = pairs
    times = np.bincount(behind, minlength=len(gains))
    theirs = np.flatnonzero(times)
    times = times[theirs].astype(float)
    gain = (fails_z[theirs] * times[:, None]).T @ gains[theirs]
    return in_x * gain - (1.0 - in_x) * (times @ losses[theirs])


def _of_pairs(patterns: np.ndarray, behind: np.ndarray, size: int, own: np.ndarray, other: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What a leaf of value 1 gives, by row pattern, column of ``basis`` (background rows x columns) and feature."""
    in_x, in_z = _bits(patterns, size), _bits(behind, size)
    fails_x, fails_z = (size - in_x.sum(1)).astype(int)[:, None], (size - in_z.sum(1)).astype(int)[None, :]
    reached = _reached(patterns, behind, size)
    gain, loss = own[fails_z, fails_x] * reached, other[fails_z, fails_x] * reached
    gains = np.stack([(gain * (1.0 - in_z[:, k])) @ basis for k in range(size)], axis=-1)
    return in_x[:, None, :] * gains - (1.0 - in_x)[:, None, :] * (loss @ basis)[:, :, None]


def _reached(patterns: np.ndarray, theirs: np.ndarray, size: int) -> np.ndarray:
    """Which patterns of rows and of the background together meet all conditions."""
    return (patterns.astype(np.int64)[:, None] | theirs.astype(np.int64)[None, :]) == (1 << size) - 1


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, and the place of each code among them."""
    if size > TABLE_BITS:
        return np.unique(codes, return_inverse=True)
    place = np.zeros(1 << size, np.int64)
    place[codes] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place.take(codes)


def _bits(codes: np.ndarray, size: int) -> np.ndarray:
    return ((codes.astype(np.int64)[:, None] >> np.arange(size)) & 1).astype(float)


def _scaled_values(ensemble: Ensemble, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """The same behind a logistic link, whose slope differs from pair to pair: rows of a cell are one product of matrices."""
    values = np.zeros((len(x), ensemble.n_features))
    own, other = _weights(ensemble.depth)
    raw_z, ranks_z = ensemble.raw(background), ensemble.ranks(background)
    for start in range(0, len(x), CHUNK):
        some = x[start:start + CHUNK]
        ranks, mine = ensemble.ranks(some), values[start:start + CHUNK]
        scale, basis = _narrowed(ensemble.raw(some), raw_z)
        for first, end in ensemble.groups(cells_for(ensemble, len(some))):
            if ensemble.long(first):
                features, value, codes, behind = ensemble.path(first, ranks, ranks_z)
                patterns, cell = _distinct(codes, len(features))
                table = value * _of_pairs(patterns, behind, len(features), own, other, basis)
            else:
                group = ensemble.group(first, end)
                features, inside = group.features, group.cell(ranks_z)
                if not features:
                    continue
                present, cell = _distinct(group.cell(ranks), (prod(group.shape) - 1).bit_length())
                table = np.zeros((len(present), basis.shape[1], len(features)))
                for axes, met, value in group.leaves:
                    codes = np.broadcast_to(met, group.shape).reshape(-1)
                    patterns, pattern_of = _distinct(codes[present], len(axes))
                    table[:, :, axes] += (value * _of_pairs(patterns, codes[inside], len(axes), own, other, basis))[pattern_of]
            order = np.argsort(cell.astype(np.uint16 if len(table) < 1 << 16 else np.int64), kind="stable")
            ends = np.cumsum(np.bincount(cell, minlength=len(table))).tolist()
            given = np.zeros((len(some), len(features)))
            for part, a, b in zip(table, [0, *ends], ends):
                if a < b and part.any():
                    given[order[a:b]] = scale[order[a:b]] @ part
            mine[:, features] += given
    return values / len(background)


def _narrowed(raw_x: np.ndarray, raw_z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slopes of all pairs as a product of a narrow matrix and the transposed second one, the same but for rounding.

    Slopes are a smooth function of two margins, so the columns of the background rows are mixtures of few. These are taken
    from some rows and kept only if all rows are given back.
    """
    parts = [raw_x[a:a + LOOKS] for a in range(0, len(raw_x), LOOKS)]
    some = np.sort(raw_x)[np.linspace(0, len(raw_x) - 1, min(len(raw_x), 4 * len(raw_z))).astype(int)]
    _, sizes, mixtures = np.linalg.svd(_link_scale(some, raw_z), full_matrices=False)
    basis, narrow = np.ascontiguousarray(mixtures[sizes > 1e-15 * sizes[0]].T), []
    for part in parts:
        scale = _link_scale(part, raw_z)
        narrow.append(scale @ basis)
        if np.abs(narrow[-1] @ basis.T - scale).max() > NARROWED:
            return np.concatenate([_link_scale(p, raw_z) for p in parts]), np.eye(len(raw_z))
    return np.concatenate(narrow), basis


def _link_scale(raw_x: np.ndarray, raw_z: np.ndarray) -> np.ndarray:
    """Slope of the logistic link between the margins of each pair.

    The difference of the chances is ``sinh(x - z) / (2 cosh(x) cosh(z))``, which does not cancel where margins are near.
    """
    p_x, p_z = 1.0 / (1.0 + np.exp(-2.0 * raw_x)), 1.0 / (1.0 + np.exp(-2.0 * raw_z))
    run = raw_x[:, None] - raw_z[None, :]
    near = np.abs(run) < 1.0
    small = np.where(near & (run != 0.0), run, 1.0)
    flat_x, flat_z = (2.0 * np.exp(-np.abs(raw)) / (1.0 + np.exp(-2.0 * np.abs(raw))) for raw in (raw_x, raw_z))
    at = 0.5 * flat_x[:, None] * flat_z[None, :] * np.where(run == 0.0, 1.0, np.sinh(small) / small)
    return np.where(near, at, (p_x[:, None] - p_z[None, :]) / np.where(near, 1.0, run))
