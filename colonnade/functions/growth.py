"""Trees grown level by level from histograms of binned features: the kernel run inside tasks.

Targets and weights are whole numbers at a fixed scale, so sums are exact and a tree is the same however rows are spread and
in whatever order they are added up. A tree may be grown from rows at hand (``grow``), or a level at a time from histograms
that were added up elsewhere (``Growing``); both choose cuts with the same function.

Rows at hand whose bins are all equal end in the same leaf, so they are added up first where that makes them much fewer
(``Alike``), and features are counted several at a time (``bundled``). Sums of whole numbers are the same either way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Bins of a feature, scale of the whole numbers, and cells of a level's histograms that are held at once.
BINS = 64
SCALE = 1 << 20
CELLS = 2_000_000
# Added to the curvature of a leaf of a classifier, so that a leaf of few rows takes no huge step.
RIDGE = 1.0
# Combinations of bins that are counted in one pass, and how many rows there are at least for each kind of them that is kept.
JOINT = 4096
ROWS_A_KIND = 8
IDENTITY, LOGISTIC, SOFTMAX = "identity", "logistic", "softmax"


@dataclass(frozen=True)
class Rule:
    """How a family of trees grows. ``trees`` are rounds for boosting; with several classes each round has a tree per class."""

    boosted: bool
    link: str
    outputs: int
    trees: int
    depth: int
    step: float = 1.0
    rate: float = 1.0
    least: int = 1
    subset: int = 0
    seed: int = 42

    def grown_alike(self) -> tuple:
        """Rules of equal value here differ in the number of trees only, or for forests in depth as well: one growth serves them."""
        same = (self.boosted, self.link, self.outputs, self.step, self.rate, self.least, self.subset, self.seed)
        return (*same, self.depth) if self.boosted else same


@dataclass
class Tree:
    """Nodes as parallel arrays; a node's children are ``left`` and the one behind it, ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray, steps: int | None = None, limits: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """The node that each column of ``x`` (features x rows), or each of ``rows``, ends in; ``limits`` replaces the cuts where
        ``x`` is not binned."""
        inner, n = self.feature >= 0, x.shape[1]
        # Leaves lead to themselves.
        feature, left = np.where(inner, self.feature, 0).astype(np.int64), np.where(inner, self.left, np.arange(len(inner))).astype(np.int32)
        cut = np.where(inner, self.cut, np.uint8(255)) if limits is None else np.where(inner, limits, np.inf)
        flat, at = np.ascontiguousarray(x).reshape(-1), np.arange(n) if rows is None else rows
        node = np.zeros(len(at), np.int32)
        for _ in range(len(inner) if steps is None else steps):
            if not inner[node].any():
                break
            place = feature[node]
            place *= n
            place += at
            node = left[node] + (flat[place] > cut[node])
        return node


def hashed(place: np.ndarray, *keys: int) -> np.ndarray:
    """Even 64-bit hashes of integers under some keys."""
    x = place.astype(np.uint64)
    for key in keys:
        x = (x ^ np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


class Steps:
    """How many of some rising limits (as parts of all hashes) a hash has passed, by its first bits where these tell."""

    def __init__(self, limits):
        self.limits = np.asarray(limits, float) * 2.0**64
        edges = np.arange(4097) * 2.0**52
        passed = np.searchsorted(self.limits, edges, side="right")
        self.passed, self.open = passed[:-1], passed[:-1] != passed[1:]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        first = (hashes >> np.uint64(52)).astype(np.int64)
        found = self.passed.take(first)
        some = np.flatnonzero(self.open.take(first))
        found[some] = np.searchsorted(self.limits, hashes[some].astype(np.float64), side="right")
        return found


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_DRAWN = Steps(_POISSON)


def bootstrap(place: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers of mean 1."""
    return _DRAWN.of(hashed(place, seed, tree, 1)).astype(np.float64)


def drawn(place: np.ndarray, rule: Rule, tree: int) -> np.ndarray | None:
    """Weights of rows in a tree; None if all count once."""
    if not rule.boosted:
        return bootstrap(place, rule.seed, tree)
    return None if rule.rate >= 1 else (hashed(place, rule.seed, tree, 2) < rule.rate * 2.0**64).astype(np.float64)


@dataclass(frozen=True)
class Cells:
    """Where the bins of each feature lie in a flat row of all features' bins."""

    starts: np.ndarray

    @classmethod
    def of(cls, bins: list[int]) -> Cells:
        return cls(np.concatenate([[0], np.cumsum(bins)]).astype(np.int64))

    @property
    def features(self) -> int:
        return len(self.starts) - 1

    @property
    def feature(self) -> np.ndarray:
        return np.repeat(np.arange(self.features), np.diff(self.starts))


def histograms(x, rows, slot, nodes: int, allowed, cells: Cells, weights, targets) -> tuple[np.ndarray, np.ndarray]:
    """Weights and targets by node and cell. ``slot`` says which of the ``nodes`` each of ``rows`` is in, ``allowed`` (nodes x
    features) which features count there; None allows all."""
    tried = allowed.sum(axis=1) if allowed is not None and len(allowed) else np.zeros(1)
    if 0 < tried[0] == tried.max() == tried.min() < cells.features:
        return _tried_histograms(x, rows, slot, nodes, np.nonzero(allowed)[1].reshape(nodes, -1), cells, weights, targets)
    counts, sums = np.zeros((nodes, cells.starts[-1])), np.zeros((len(targets), nodes, cells.starts[-1]))
    for f in range(cells.features):
        some, of = rows, slot
        if allowed is not None:
            fine = allowed[:, f]
            if not fine.any():
                continue
            if not fine.all():
                at = np.flatnonzero(fine[slot])
                some, of = rows[at], slot[at]
        a, b = cells.starts[f], cells.starts[f + 1]
        index = of.astype(np.int64) * (b - a) + x[f][some]
        counts[:, a:b] = np.bincount(index, None if weights is None else weights[some], nodes * (b - a)).reshape(nodes, b - a)
        for k, target in enumerate(targets):
            sums[k, :, a:b] = np.bincount(index, target[some], nodes * (b - a)).reshape(nodes, b - a)
    return counts, sums


def _tried_histograms(x, rows, slot, nodes: int, tried: np.ndarray, cells: Cells, weights, targets) -> tuple[np.ndarray, np.ndarray]:
    """``histograms`` where each node has as many features (``tried``, nodes x some): a row is counted once for each of them."""
    width, flat = int(cells.starts[-1]), x.reshape(-1)
    mine = [v if v is None else v[rows] for v in (weights, *targets)]
    found = [np.zeros(nodes * width) for _ in mine]
    from_row, from_cell = tried * x.shape[1], np.arange(nodes)[:, None] * width + cells.starts[tried]
    for k in range(tried.shape[1]):
        place = from_row[:, k].take(slot)
        place += rows
        index = from_cell[:, k].take(slot)
        index += flat.take(place)
        for total, values in zip(found, mine):
            total += np.bincount(index, values, nodes * width)
    counts, *sums = (v.reshape(nodes, width) for v in found)
    return counts, np.stack(sums)


@dataclass(frozen=True)
class Bundle:
    """Features that are counted together: one number for the combination of a row's bins."""

    features: list[int]
    sizes: list[int]
    code: np.ndarray

    @property
    def width(self) -> int:
        return math.prod(self.sizes)

    def pays(self, rows: int, nodes: int) -> bool:
        """Whether a pass over the rows costs more than adding up the combinations."""
        k = len(self.features)
        return k > 1 and nodes * self.width <= CELLS and nodes * self.width * k <= 4 * rows * (k - 1)


def bundled(x: np.ndarray, cells: Cells) -> list[Bundle]:
    """All features, the finest first, each in the first bundle that has room."""
    sizes = np.diff(cells.starts)
    groups: list[list[int]] = []
    for f in sorted(range(cells.features), key=lambda f: (-sizes[f], f)):
        room = next((g for g in groups if math.prod(int(sizes[i]) for i in (*g, f)) <= JOINT), None)
        groups.append([f]) if room is None else room.append(f)
    out = []
    for g in groups:
        code = x[g[0]].astype(np.uint16)
        for f in g[1:]:
            code = code * np.uint16(sizes[f]) + x[f].astype(np.uint16)
        out.append(Bundle(g, [int(sizes[f]) for f in g], code))
    return out


def bundle_histograms(x, bundles: list[Bundle], rows, slot, nodes: int, cells: Cells, weights, targets) -> tuple[np.ndarray, np.ndarray]:
    """``histograms`` of all features, counted by bundles where that pays."""
    every = len(rows) == x.shape[1]
    mine = [v if every or v is None else v[rows] for v in (weights, *targets)]
    counts, sums = np.zeros((nodes, cells.starts[-1])), np.zeros((len(targets), nodes, cells.starts[-1]))
    at = slot.astype(np.int64)

    def count(code: np.ndarray, features: list[int], sizes: list[int]) -> None:
        width = math.prod(sizes)
        index = at * width
        index += code if every else code[rows]
        for k, values in enumerate(mine):
            found = np.bincount(index, values, nodes * width).reshape(nodes, *sizes)
            for axis, f in enumerate(features, 1):
                others = tuple(a for a in range(1, len(sizes) + 1) if a != axis)
                (sums[k - 1] if k else counts)[:, cells.starts[f]:cells.starts[f + 1]] = found.sum(axis=others)

    for b in bundles:
        if b.pays(len(rows), nodes):
            count(b.code, b.features, b.sizes)
        else:
            for f, size in zip(b.features, b.sizes):
                count(x[f], [f], [size])
    return counts, sums


@dataclass
class Cuts:
    """Per node the best cut: gain (0 if none), feature, bin, rows and target sums to the left, and in all."""

    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    rows_left: np.ndarray
    sums_left: np.ndarray
    rows: np.ndarray
    sums: np.ndarray

    @classmethod
    def joined(cls, parts: list[Cuts]) -> Cuts:
        return cls(*(np.concatenate([getattr(p, n) for p in parts], axis=-1) for n in cls.__dataclass_fields__))


def best_cuts(counts: np.ndarray, sums: np.ndarray, cells: Cells, least: int) -> Cuts:
    """The cut that lowers the squared error most; of equal ones the first feature's, then the lowest.

    A feature that a node may not be cut at has no counts there.
    """
    nodes, of = np.arange(len(counts)), cells.feature

    def upto(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums within each feature, and the sum over one feature that has counts."""
        run = values.cumsum(axis=-1)
        ends = run[..., cells.starts[1:] - 1]
        before = np.concatenate([np.zeros_like(ends[..., :1]), ends[..., :-1]], axis=-1)
        return run - before[..., of], ends - before

    (left, by_feature), (sums_left, sums_by_feature) = upto(counts), upto(sums)
    known = by_feature.argmax(axis=1)
    rows, total = by_feature[nodes, known], sums_by_feature[:, nodes, known]
    right, sums_right = rows[:, None] - left, total[:, :, None] - sums_left
    before = (total * total).sum(axis=0) / np.maximum(rows, 1)
    gain = (sums_left * sums_left).sum(axis=0) / np.maximum(left, 1)
    gain += (sums_right * sums_right).sum(axis=0) / np.maximum(right, 1)
    gain -= before[:, None]
    gain[(left < max(least, 1)) | (right < max(least, 1)) | (by_feature[:, of] == 0)] = 0
    at = gain.argmax(axis=1)
    best = gain[nodes, at]
    # What rounding alone can make of a node without any difference does not count.
    best = np.where(best > 1e-10 * before, best, 0.0)
    return Cuts(best, of[at], at - cells.starts[of[at]], left[nodes, at], sums_left[:, nodes, at], rows, total)


class Growing:
    """A tree under growth, its open nodes, and how it goes on."""

    def __init__(self, rule: Rule, features: int, outputs: int, number: int):
        self.rule, self.features, self.number = rule, features, number
        self.feature, self.cut, self.left = np.full(1, -1, np.int32), np.zeros(1, np.uint8), np.zeros(1, np.int32)
        self.gain, self.rows, self.sums = np.zeros(1), np.zeros(1), np.zeros((outputs, 1))
        self.open, self.cut_before = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def allowed(self) -> np.ndarray | None:
        """Which features (columns) each open node may be cut at; None for all."""
        if not 0 < self.rule.subset < self.features:
            return None
        every = np.arange(self.features, dtype=np.int64)
        keys = hashed(self.open[:, None] * self.features + every[None, :], self.rule.seed, self.number, 3)
        fine = np.zeros((len(self.open), self.features), bool)
        np.put_along_axis(fine, np.argsort(keys, axis=1, kind="stable")[:, :self.rule.subset], True, axis=1)
        return fine

    def split(self, cuts: Cuts) -> None:
        """Cuts the open nodes, in their order, where that gains; their children are open if they can be cut."""
        self.rows[self.open], self.sums[:, self.open] = cuts.rows, cuts.sums
        self.cut_before = np.flatnonzero(cuts.gain > 0)
        parents, n = self.open[self.cut_before], len(self.feature)
        some = self.cut_before
        self.feature[parents], self.cut[parents], self.gain[parents] = cuts.feature[some], cuts.bin[some], cuts.gain[some]
        self.left[parents] = n + 2 * np.arange(len(some))

        def children(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
            return np.stack([left, whole - left], axis=-1).reshape(*left.shape[:-1], -1)

        rows = children(cuts.rows_left[some], cuts.rows[some])
        self.rows = np.concatenate([self.rows, rows])
        self.sums = np.concatenate([self.sums, children(cuts.sums_left[:, some], cuts.sums[:, some])], axis=1)
        self.feature = np.concatenate([self.feature, np.full(2 * len(some), -1, np.int32)])
        self.cut, self.left, self.gain = (np.concatenate([v, np.zeros(2 * len(some), v.dtype)]) for v in (self.cut, self.left, self.gain))
        self.open = n + np.flatnonzero(rows >= 2 * max(self.rule.least, 1))

    def tree(self) -> Tree:
        """The nodes so far; ``value`` has the target sums."""
        return Tree(self.feature.copy(), self.cut.copy(), self.left.copy(), self.rows.copy(), self.gain.copy(), self.sums.copy())


def grow(x: np.ndarray, weights: np.ndarray | None, targets: list[np.ndarray], rule: Rule, number: int, cells: Cells) -> Tree:
    """One tree from rows at hand. Targets count ``weights`` times."""
    return grown(x, bundled(x, cells), weights, targets if weights is None else [t * weights for t in targets], rule, number, cells)[0]


def grown(x, bundles: list[Bundle], weights, targets, rule: Rule, number: int, cells: Cells) -> tuple[Tree, np.ndarray]:
    """One tree and the node that each row of some weight ends in. Targets have the weights in them already."""
    growing = Growing(rule, len(x), len(targets), number)
    total, flat = x.shape[1], np.ascontiguousarray(x).reshape(-1)
    live = np.arange(total) if weights is None else np.flatnonzero(weights)
    growing.rows[0], growing.sums[:, 0] = float(len(live)) if weights is None else weights.sum(), [t.sum() for t in targets]
    node, held = np.zeros(total, np.int32), None
    at_once = max(1, CELLS // (int(cells.starts[-1]) * (1 + len(targets))))
    for depth in range(rule.depth):
        nodes = growing.open
        if not len(nodes) or not len(live):
            break
        allowed = growing.allowed()
        place = np.full(len(growing.feature), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        slot = place[node[live]]
        if (slot < 0).any():
            live, slot = live[slot >= 0], slot[slot >= 0]
        # Counting all features is worth it as long as half of the children follow from their parents.
        whole = allowed is None or (len(nodes) * JOINT <= 2 * len(live) and (not depth or held is not None))
        if len(nodes) <= at_once and whole:
            held = (*_level(x, bundles, live, slot, cells, weights, targets, growing, held), nodes)
            if allowed is None:
                cuts = best_cuts(*held[:2], cells, rule.least)
            else:
                fine = allowed[:, cells.feature]
                cuts = best_cuts(held[0] * fine, held[1] * fine, cells, rule.least)
        else:
            parts, held = [], None
            for a in range(0, len(nodes), at_once):
                some, n = (slot >= a) & (slot < a + at_once), min(at_once, len(nodes) - a)
                fine = None if allowed is None else allowed[a:a + at_once]
                parts.append(best_cuts(*histograms(x, live[some], slot[some] - a, n, fine, cells, weights, targets), cells, rule.least))
            cuts = Cuts.joined(parts)
        growing.split(cuts)
        n = node[live]
        f = growing.feature[n]
        if (f < 0).any():
            live, n, f = live[f >= 0], n[f >= 0], f[f >= 0]
        at = f * np.int64(total)
        at += live
        node[live] = growing.left[n] + (flat[at] > growing.cut[n])
    return growing.tree(), node


def _level(x, bundles, live, slot, cells, weights, targets, growing, held):
    """Histograms of the open nodes. Of two open children the smaller is counted, the other is what is left of their parent's."""
    nodes = growing.open
    if held is None:
        return bundle_histograms(x, bundles, live, slot, len(nodes), cells, weights, targets)
    counts_before, sums_before, nodes_before = held
    left = growing.left[nodes_before[growing.cut_before]]
    is_open = np.zeros(len(growing.feature), bool)
    is_open[nodes] = True
    small = np.where(growing.rows[left] <= growing.rows[left + 1], left, left + 1)
    small = np.where(is_open[small], small, 2 * left + 1 - small)
    wanted = is_open[small]
    left, small, before = left[wanted], small[wanted], growing.cut_before[wanted]
    where = np.full(len(growing.feature), -1, np.int32)
    where[small] = np.arange(len(small))
    mine = where[nodes][slot]
    some = np.flatnonzero(mine >= 0)
    counts_small, sums_small = bundle_histograms(x, bundles, live[some], mine[some], len(small), cells, weights, targets)
    counts, sums = np.empty((len(nodes), counts_small.shape[1])), np.empty((len(targets), len(nodes), counts_small.shape[1]))
    place = np.full(len(growing.feature), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    counts[place[small]], sums[:, place[small]] = counts_small, sums_small
    large = 2 * left + 1 - small
    both = is_open[large]
    counts[place[large[both]]] = counts_before[before[both]] - counts_small[both]
    sums[:, place[large[both]]] = sums_before[:, before[both]] - sums_small[:, both]
    return counts, sums


class Alike:
    """Rows by kind: those of one kind have equal bins and, for classes, equal labels.

    Trees are grown on kinds, weighed by their rows. Where kinds would not be much fewer than rows, every row is its own.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, place: np.ndarray, start, spread: float, rule: Rule, cells: Cells):
        self.rule, self.place, self.of = rule, place, None
        number = rule.link == IDENTITY
        # How far numbers are from where margins start, as whole numbers; of classes the label itself.
        own = np.rint((y - start[0]) * (SCALE / spread)) if number else y
        columns = [(x[f], int(size)) for f, size in enumerate(np.diff(cells.starts))]
        of = kinds_of(columns if number else [(y.astype(np.int64), int(y.max(initial=0)) + 1), *columns], len(y))
        if of is None:
            self.x, self.y, self.rows = x, own, None
        else:
            self.of, kinds = of
            first = np.zeros(kinds, np.int64)
            first[self.of] = np.arange(len(self.of))
            self.x, self.rows = np.ascontiguousarray(x[:, first]), np.bincount(self.of, minlength=kinds).astype(float)
            self.own, self.y = own, np.bincount(self.of, own, kinds) if number else y[first]
        self.bundles = bundled(self.x, cells)

    def drawn(self, tree: int) -> tuple[np.ndarray | None, np.ndarray]:
        """Weights of the kinds in a tree, None if all are rows that count once; and sums of numbers, or labels."""
        weights = drawn(self.place, self.rule, tree)
        if self.of is None:
            return weights, self.y if weights is None or self.rule.link != IDENTITY else self.y * weights
        if weights is None:
            return self.rows, self.y
        count = len(self.rows)
        summed = self.y if self.rule.link != IDENTITY else np.bincount(self.of, self.own * weights, count)
        return np.bincount(self.of, weights, count), summed


class Counted:
    """Kinds whose rows were counted where they lie: by tree the weights and, of numbers, the sums, None for every tree alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cells: Cells, counts: dict, sums: dict):
        self.x, self.y, self.bundles, self.counts, self.sums = x, y, bundled(x, cells), counts, sums

    def drawn(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        key = tree if tree in self.counts else None
        return self.counts[key], self.sums.get(key, self.y)


def codes_of(x: np.ndarray, y: np.ndarray | None, sizes: list[int], classes: int) -> np.ndarray:
    """A whole number for each combination of bins and, of classes, the label."""
    code = np.zeros(x.shape[1], np.int64) if y is None else y.astype(np.int64)
    width = 1 if y is None else classes
    for column, size in zip(x, sizes):
        code += column.astype(np.int64) * width
        width *= size
    return code


def kinds_from(codes: np.ndarray, labelled: bool, sizes: list[int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins (features x kinds) and labels that codes stand for."""
    y, rest = (codes % classes, codes // classes) if labelled else (np.zeros(len(codes), np.int64), codes)
    x = np.empty((len(sizes), len(codes)), np.uint8)
    for f, size in enumerate(sizes):
        x[f], rest = rest % size, rest // size
    return x, y.astype(float)


def kinds_of(columns: list[tuple[np.ndarray, int]], rows: int) -> tuple[np.ndarray, int] | None:
    """A number for each distinct combination and how many there are; None if there are too few rows for each."""
    of, kinds, most = np.zeros(rows, np.int64), 1, rows // ROWS_A_KIND
    for column, size in columns:
        if kinds * size > max(4 * rows, 1):
            return None
        of = of * size + column
        seen = np.zeros(kinds * size, bool)
        seen[of] = True
        kinds = int(seen.sum())
        if kinds > most:
            return None
        of = (np.cumsum(seen) - 1)[of]
    return of, kinds


# Boosting.

def chances(margins: np.ndarray, link: str) -> np.ndarray:
    """Margins (outputs x rows) as what is predicted."""
    if link == LOGISTIC:
        return 1.0 / (1.0 + np.exp(-margins))
    if link == SOFTMAX:
        e = np.exp(margins - margins.max(axis=0))
        return e / e.sum(axis=0)
    return margins


def gone(margins: np.ndarray, start, spread: float) -> np.ndarray:
    """How far margins have gone from where they start, as whole numbers."""
    return np.rint((margins - start[0]) * (SCALE / spread))


def pulls(y: np.ndarray, margins: np.ndarray, rule: Rule, start, spread: float) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """By output, how far rows are from their labels and how fast that changes, as whole numbers."""
    if rule.link == IDENTITY:
        return [np.rint((y - start[0]) * (SCALE / spread)) - gone(margins[0], start, spread)], None
    p = chances(margins, rule.link)
    truth = [y] if rule.link == LOGISTIC else [(y == k).astype(float) for k in range(rule.outputs)]
    return [np.rint((t - q) * SCALE) for t, q in zip(truth, p)], [np.rint(q * (1 - q) * SCALE) for q in p]


def leaf_sums(leaf: np.ndarray, nodes: int, weights: np.ndarray | None, pull: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Pull and curvature of the drawn rows by node."""
    both = [v if weights is None else v * weights for v in (pull, curve)]
    return np.stack([np.bincount(leaf, v, nodes) for v in both])


def finished(tree: Tree, rule: Rule, spread: float, sums: np.ndarray | None = None) -> Tree:
    """The tree of a round with what its leaves add to the margin."""
    if sums is None:
        tree.value = rule.step * (spread / SCALE) * tree.value / np.maximum(tree.rows, 1)
    else:
        part = 1.0 if rule.link == LOGISTIC else (rule.outputs - 1) / rule.outputs
        tree.value = (rule.step * part * sums[0] / (sums[1] + RIDGE * SCALE))[None, :]
    return tree


def boost(x, y, place, start, spread, rule: Rule, cells: Cells, seen) -> None:
    """Grows a tree per output in each round and shows them to ``seen``."""
    boost_on(Alike(x, y, place, start, spread, rule, cells), start, spread, rule, cells, seen)


def boost_on(alike: Alike | Counted, start, spread, rule: Rule, cells: Cells, seen) -> None:
    margins = np.repeat(np.asarray(start, float)[:, None], alike.x.shape[1], axis=1)
    for t in range(rule.trees):
        weights, own = alike.drawn(t)
        if rule.link == IDENTITY:
            moved = gone(margins[0], start, spread)
            targets, pull, curve = [own - (moved if weights is None else moved * weights)], None, None
        else:
            pull, curve = pulls(own, margins, rule, start, spread)
            targets = pull if weights is None else [p * weights for p in pull]
        trees = []
        for k in range(rule.outputs):
            tree, leaf = grown(alike.x, alike.bundles, weights, [targets[k]], rule, t, cells)
            if weights is not None:
                left_out = np.flatnonzero(weights == 0)
                leaf[left_out] = tree.leaf_of(alike.x[:, left_out], rule.depth)
            trees.append(finished(tree, rule, spread, None if curve is None else leaf_sums(leaf, len(tree.feature), weights, pull[k], curve[k])))
            margins[k] += trees[k].value[0][leaf]
        seen(t, trees)


# Forests.

def forest_targets(y: np.ndarray, rule: Rule, start: np.ndarray, spread: float) -> list[np.ndarray]:
    """What a tree of a forest averages: the distance from the mean, or membership of each class (of two, the second)."""
    if rule.link == IDENTITY:
        return [np.rint((y - start[0]) * (SCALE / spread))]
    return [y.astype(float)] if rule.outputs == 1 else [(y == k).astype(float) for k in range(rule.outputs)]


def averaged(tree: Tree, rule: Rule, start: np.ndarray, spread: float) -> Tree:
    """The tree with the means of its nodes."""
    mean = tree.value / np.maximum(tree.rows, 1)
    tree.value = start[:, None] + mean * (spread / SCALE) if rule.link == IDENTITY else mean
    return tree


def plant(x, y, place, start, spread, rule: Rule, cells: Cells, numbers, seen) -> None:
    """Grows the trees of a forest with the given numbers and shows each to ``seen``."""
    plant_on(Alike(x, y, place, start, spread, rule, cells), start, spread, rule, cells, numbers, seen)


def plant_on(alike: Alike | Counted, start, spread, rule: Rule, cells: Cells, numbers, seen) -> None:
    for t in numbers:
        weights, own = alike.drawn(t)
        # The sums of numbers have the weights in them; labels say where each class is.
        targets = [own] if rule.link == IDENTITY else [v * weights for v in forest_targets(own, rule, start, spread)]
        seen(t, [averaged(grown(alike.x, alike.bundles, weights, targets, rule, t, cells)[0], rule, start, spread)])
