"""Boosted trees and forests, grown for many models at once.

Fold and combination are group keys: the rows of all folds lie in one written table of binned blocks, and one job serves
every model that still grows, so the number of jobs does not rise with folds, combinations or classes. Where the binned rows
of a fold are many, a job adds up the histograms of one level of all trees (``_Spread``). Where they are few, at most
``IN_TASK_BYTES``, a task gets the rows of one model's fold, and all models are one job (``_in_tasks``). Both use the same
kernel on the same whole numbers, so they grow the same trees: the size decides the plan and never the result.

Rows are drawn by a hash of their place, which is a hash of their keys. Without keys equal rows are drawn together.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import growth
from colonnade.functions.columns import TASK_GROUPS, by_task_group
from colonnade.functions.growth import BINS, IDENTITY, LOGISTIC, SOFTMAX, Cells, Cuts, Growing, Rule, Tree
from colonnade.operators.metrics import classification_scores, regression_scores
from colonnade.plans.labels import LABEL, PREDICTION, PROBABILITY
from colonnade.plans.steps import _Fitted
from colonnade.session import scratch_path

# The kernel travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(growth)

# A hash of each row's keys, where the caller has one.
PLACE = "__place"
BLOCK_ROWS = 16_384
# Bytes of a fold's binned training rows, labels and places up to which a task grows whole models; it needs some four times
# as much. Only the plan depends on it.
IN_TASK_BYTES = 320 << 20
# Tasks that share the trees of a forest where tasks grow whole trees.
FOREST_PARTS = 12
# Rounds whose trees are applied again by each job before margins are written.
KEEP_ROUNDS = 8
# Trees of a forest that grow together where rows are spread, and blocks that a task counts at once there.
TOGETHER, BLOCKS_AT_ONCE = 24, 8
# Cells of histograms that a task of a level's job holds.
TASK_CELLS = 8_000_000

# Rows of a fold from which kinds are counted where the rows lie, and how many kinds of a fold there may be for that.
COUNT_ROWS = 50_000
MOST_KINDS = 20_000

BLOCKS = "fold int, held boolean, block bigint, n int, y binary, place binary, x binary"
PREDICTIONS = "model int, fold int, label double, prediction double"
OUTPUTS = "model int, fold int, part int, block bigint, y binary, raw binary, seconds double"


class TreeFamily(Estimator):
    """What forests and boosting have in common. ``classes`` is 0 for regression."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of cuts", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows on either side of a cut", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "what rows and features are drawn by", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(minInstancesPerNode=1, classes=0, seed=42)
        self._set(**params)

    def rule(self, features: int) -> Rule:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TreeModel:
        folds = Folds(df.sparkSession)
        folds.add(0, df, None, {"": self})
        return folds.models()[0, ""]


class TreeForest(TreeFamily):
    """Trees on bootstrapped rows; a forest for classes averages class shares."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    featureSubset = Param(Params._dummy(), "featureSubset", "all, or sqrt: features tried at a node", TypeConverters.toString)

    def __init__(self, **params):
        super().__init__(**{"numTrees": 200, "maxDepth": 10, "featureSubset": "all", **params})

    def rule(self, features: int) -> Rule:
        get, classes = self.getOrDefault, self.getOrDefault(self.classes)
        subset = max(1, int(np.sqrt(features))) if get(self.featureSubset) == "sqrt" else 0
        return Rule(
            False, "shares" if classes else IDENTITY, classes if classes > 2 else 1, get(self.numTrees), get(self.maxDepth),
            least=get(self.minInstancesPerNode), subset=subset, seed=get(self.seed),
        )


class TreeBoosting(TreeFamily):
    """Gradient boosting: squared error, logistic loss, or the joint loss of several classes with a tree per class and round."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree that is added", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a round sees", TypeConverters.toFloat)

    def __init__(self, **params):
        super().__init__(**{"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 1.0, **params})

    def rule(self, features: int) -> Rule:
        get, classes = self.getOrDefault, self.getOrDefault(self.classes)
        link = IDENTITY if not classes else LOGISTIC if classes <= 2 else SOFTMAX
        return Rule(
            True, link, classes if classes > 2 else 1, get(self.maxIter), get(self.maxDepth), get(self.stepSize),
            get(self.subsamplingRate), get(self.minInstancesPerNode), seed=get(self.seed),
        )


@dataclass
class Fold:
    """What is known of a fold's training rows: edges of the bins, where margins start, the spread of the labels."""

    edges: list[np.ndarray]
    rows: int
    mean: float
    spread: float
    shares: list[float]

    @property
    def cells(self) -> Cells:
        return Cells.of([len(e) + 1 for e in self.edges])

    def start(self, rule: Rule) -> np.ndarray:
        if rule.link == IDENTITY:
            return np.array([self.mean])
        shares = np.clip(self.shares or [0.0], 1e-6, 1 - 1e-6)
        if rule.link == LOGISTIC:
            p = shares[1] if len(shares) > 1 else 1e-6
            return np.array([np.log(p / (1 - p))])
        return np.log(shares) if rule.link == SOFTMAX else np.zeros(rule.outputs)

    def scale(self, rule: Rule) -> float:
        return self.spread if rule.link == IDENTITY else 1.0


@dataclass
class Job:
    """Members of one fold that one growth serves: (number, trees, depth)."""

    fold: int
    rule: Rule
    members: list[tuple[int, int, int]]


class Folds:
    """Binned rows of some folds and the models to grow on each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.paths = spark, {}, []
        self.names: list[tuple[int, str]] = []
        self.rules: list[Rule] = []

    def add(self, fold: int, seen: DataFrame, unseen: DataFrame | None, families: Mapping[str, TreeFamily]) -> None:
        """Bins a fold's rows by edges from its training rows and writes them. Rows have a label, features and may have a place."""
        classes = max(f.getOrDefault(f.classes) for f in families.values())
        known = _fold_of(seen, classes)
        self.known[fold] = known
        for name, family in families.items():
            rule = family.rule(len(known.edges))
            softmax = rule.outputs > 1
            self.names.append((fold, name))
            self.rules.append(replace(rule, outputs=max(rule.outputs, len(known.shares))) if softmax else rule)
        for df, held in ((seen, False), (unseen, True)):
            if df is not None:
                path = scratch_path(self.spark, "binned")
                _binned(df, known.edges, fold, held).write.parquet(path)
                self.paths.append(path)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(*self.paths)

    def jobs(self) -> list[Job]:
        groups: dict[tuple, list[int]] = {}
        for i, ((fold, _), rule) in enumerate(zip(self.names, self.rules)):
            groups.setdefault((fold, rule.grown_alike()), []).append(i)
        return [
            Job(fold, replace(self.rules[some[0]], trees=max(self.rules[i].trees for i in some), depth=max(self.rules[i].depth for i in some)),
                [(i, self.rules[i].trees, self.rules[i].depth) for i in some])
            for (fold, _), some in groups.items()
        ]

    def few(self) -> bool:
        return max(k.rows * (len(k.edges) + 16) for k in self.known.values()) <= IN_TASK_BYTES

    def outputs(self) -> DataFrame:
        """What each model makes of the blocks of its fold's held-out rows, written once: sums over the trees of a part."""
        if self.few():
            found = _in_tasks(self, _outputs_of_part, OUTPUTS)
        else:
            found = _applied(self, _Spread(self).grown())
        path = scratch_path(self.spark, "tree-outputs")
        found.write.parquet(path)
        return self.spark.read.schema(OUTPUTS).parquet(path)

    def models(self) -> dict[tuple[int, str], TreeModel]:
        """The fitted models, whose trees come to the driver. Only for models that are kept."""
        jobs = self.jobs()
        counted = _Counted.of(self)
        if counted or self.few():
            trees = "job int, round int, trees binary"
            rows = counted.in_tasks(_trees_of_part, trees).collect() if counted else _in_tasks(self, _trees_of_part, trees).collect()
            grown: list[list[list[Tree]]] = [[] for _ in jobs]
            for r in sorted(rows, key=lambda r: (r["job"], r["round"])):
                grown[r["job"]].append([Tree(*parts) for parts in pickle.loads(r["trees"])])
        else:
            grown = _Spread(self).grown()
        out = {}
        for job, rounds in zip(jobs, grown):
            known = self.known[job.fold]
            for i, trees, depth in job.members:
                kept = [pruned(t, depth) for r in rounds[:trees] for t in r]
                out[self.names[i]] = TreeModel.grown(self.rules[i], known.start(job.rule), kept, known.edges)
        return out

    def scores(self, problem_is_classes: bool) -> list[tuple]:
        """(fold, name, {metric: score}, seconds) of each model on its fold's held-out rows."""
        counted = _Counted.of(self)
        outputs = counted.outputs() if counted else self.outputs()
        rules = dict(enumerate(self.rules))
        seconds = {r["model"]: r["s"] for r in outputs.groupBy("model", "part").agg(F.max("seconds").alias("s")).groupBy("model").agg(F.sum("s").alias("s")).collect()}

        def guesses(found: pa.Table) -> pa.Table:
            found = found.sort_by("part")
            model, fold = found.column("model")[0].as_py(), found.column("fold")[0].as_py()
            rule, y = rules[model], np.frombuffer(found.column("y")[0].as_py())
            raw = reduce(np.add, [np.frombuffer(b.as_py()) for b in found.column("raw")]).reshape(rule.outputs, len(y))
            return pa.table({"model": pa.array([model] * len(y), pa.int32()), "fold": pa.array([fold] * len(y), pa.int32()), "label": y, "prediction": decided(raw, rule)})

        if counted:
            predictions = counted.predictions(outputs)
        else:
            predictions = outputs.groupBy("model", "fold", "block").applyInArrow(guesses, PREDICTIONS)
        by = ["model", "fold"]
        if problem_is_classes:
            scored = classification_scores(predictions, by=by).select(*by, F.create_map(F.lit("accuracy"), "accuracy", F.lit("f1"), "f1").alias("scores"))
        else:
            scored = regression_scores(predictions, by=by).select(*by, F.create_map(F.lit("neg_rmse"), -F.col("rmse"), F.lit("r2"), F.col("r2")).alias("scores"))
        return [(r["fold"], self.names[r["model"]][1], r["scores"], seconds[r["model"]]) for r in scored.orderBy("model").collect()]


def decided(raw: np.ndarray, rule: Rule) -> np.ndarray:
    """Predictions from sums over all trees: the number, or the likeliest class."""
    if rule.link == IDENTITY:
        return raw[0] if rule.boosted else raw[0] / rule.trees
    if rule.outputs > 1:
        return raw.argmax(axis=0).astype(float)
    return (raw[0] > 0 if rule.boosted else raw[0] / rule.trees > 0.5).astype(float)


def pruned(tree: Tree, depth: int) -> Tree:
    """The tree cut off below a depth."""
    level = np.zeros(len(tree.feature), np.int64)
    for node in np.flatnonzero(tree.feature >= 0):
        level[tree.left[node]] = level[tree.left[node] + 1] = level[node] + 1
    if level.max(initial=0) <= depth:
        return tree
    kept = level <= depth
    feature = np.where(level < depth, tree.feature, -1)[kept]
    # Nodes lie level by level, so those that stay keep their numbers.
    return Tree(feature, tree.cut[kept], np.where(feature >= 0, tree.left[kept], 0), tree.rows[kept], np.where(feature >= 0, tree.gain[kept], 0.0), tree.value[:, kept])


def packed(items: list) -> bytes:
    """Trees or cuts as their arrays: classes that travelled with a task are not those of the driver."""
    return pickle.dumps([tuple(vars(item).values()) for item in items])


# Binning.

def _fold_of(seen: DataFrame, classes: int) -> Fold:
    x, y = vector_to_array(F.col("features")), F.col(LABEL)
    features = len(seen.select("features").first()["features"])
    points = [i / BINS for i in range(1, BINS)]
    stats = seen.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high")).first()
    # A row for each group of tasks, so nothing that the driver gets grows with the table.
    arrays = by_task_group(seen.select(x.alias("x")))
    sketches = arrays.agg(*[F.percentile_approx(F.col("x")[i], points, 2000).alias(f"q{i}") for i in range(features)],
                          F.max("x").alias("any")).collect()
    edges = [_edges([r[f"q{i}"] for r in sketches]) for i in range(features)]
    shares = []
    if classes:
        counts = {int(r["y"]): r["n"] for r in seen.groupBy(y.alias("y")).agg(F.count("*").alias("n")).collect()}
        shares = [counts.get(k, 0) / stats["n"] for k in range(max(classes, 2))]
    spread = max(stats["high"] - stats["mean"], stats["mean"] - stats["low"]) or 1.0
    return Fold(edges, stats["n"], stats["mean"], spread, shares)


def _edges(lists: list[list[float]]) -> np.ndarray:
    """Values that bins end at. Groups of tasks have about as many rows each, so their quantiles are pooled."""
    pooled = np.sort(np.concatenate([np.asarray(v, float) for v in lists if v]))
    values = np.unique(pooled)
    if len(values) > BINS:
        values = np.unique(pooled[(np.arange(1, BINS + 1) * len(pooled)) // BINS - 1])
    return values[:-1] if len(values) > 1 else values


def _binned(df: DataFrame, edges: list[np.ndarray], fold: int, held: bool) -> DataFrame:
    place = F.col(PLACE).cast("bigint") if PLACE in df.columns else F.xxhash64(LABEL, vector_to_array("features"))
    source = df.select(F.col(LABEL).cast("double").alias("y"), place.alias("place"), vector_to_array("features").alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, waiting, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            y, place, x = (np.concatenate(v, axis=-1) for v in zip(*waiting))
            row = [fold], [held], [base + number], [len(y)], [y.tobytes()], [place.tobytes()], [x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)
            waiting.append((batch.column("y").to_numpy(zero_copy_only=False), batch.column("place").to_numpy(zero_copy_only=False), x))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                number, waiting, rows = number + 1, [], 0
        if waiting:
            yield block()

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return source.mapInArrow(run, BLOCKS)


def _arrays(y: bytes, place: bytes, x: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(y), np.frombuffer(place, np.int64), np.frombuffer(x, np.uint8).reshape(-1, n)


def _some_blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Fold, labels, places, bins and margins of blocks, several at a time where no margins are kept beside them."""
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "y", "place", "x", "margins"))))
    for (fold, plain), some in groupby(rows, key=lambda r: (r[0], r[5] is None)):
        some = list(some)
        for a in range(0, len(some), BLOCKS_AT_ONCE if plain else 1):
            part = some[a:a + (BLOCKS_AT_ONCE if plain else 1)]
            yield fold, *(np.concatenate(v, axis=-1) for v in zip(*(_arrays(y, place, x, n) for _, n, y, place, x, _ in part))), part[0][5]


# Whole models in tasks.

def _in_tasks(folds: Folds, of_part, schema: str) -> DataFrame:
    """``of_part`` over the rows of each part's fold: a part is a job, or some trees of a forest."""
    parts, known = _parts(folds.jobs()), folds.known
    # A row for each part, with a key: models times parts of a forest at most.
    listed = folds.spark.createDataFrame([(i, job.fold) for i, (_, job, _, _) in enumerate(parts)], "part int, fold int")
    arrow = _arrow_schema(folds.spark, schema)

    def run(found: pa.Table) -> pa.Table:
        began = time.perf_counter()
        j, job, numbers, p = parts[found.column("part")[0].as_py()]
        found = found.sort_by("block")
        rows = list(zip(*(found.column(c).to_pylist() for c in ("held", "block", "n", "y", "place", "x"))))
        y, place, x = (np.concatenate(v, axis=-1) for v in zip(*(_arrays(r[3], r[4], r[5], r[2]) for r in rows if not r[0])))
        held = [(r[1], *_arrays(r[3], r[4], r[5], r[2])) for r in rows if r[0]]
        fold = known[job.fold]
        del found, rows

        def grow(seen) -> None:
            ours = np.ascontiguousarray(x), y, place, fold.start(job.rule), fold.scale(job.rule), job.rule, fold.cells
            growth.boost(*ours, seen) if job.rule.boosted else growth.plant(*ours, numbers, seen)

        return pa.Table.from_pylist(list(of_part(j, job, p, held, fold, grow, began)), arrow)

    paired = folds.blocks.join(F.broadcast(listed), "fold").repartitionByRange(max(1, len(parts)), "part")
    return paired.groupBy("part").applyInArrow(run, schema)


def _parts(jobs: list[Job]) -> list[tuple[int, Job, range, int]]:
    """What tasks grow: the number of a job, the job, the numbers of its trees, and which part of the job that is."""
    parts = []
    for j, job in enumerate(jobs):
        share = 1 if job.rule.boosted else min(FOREST_PARTS, job.rule.trees)
        parts += [(j, job, range(p, job.rule.trees, share), p) for p in range(share)]
    return parts


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


class _Tally:
    """Sums over trees for the members of a job, on some held-out rows. Rows of equal bins get the same, so they are one."""

    def __init__(self, job: Job, x: np.ndarray, start: np.ndarray, cells: Cells):
        self.job, self.x, self.of = job, x, None
        alike = growth.kinds_of([(x[f], int(size)) for f, size in enumerate(np.diff(cells.starts))], x.shape[1])
        if alike is not None:
            self.of, kinds = alike
            first = np.zeros(kinds, np.int64)
            first[self.of] = np.arange(len(self.of))
            self.x = np.ascontiguousarray(x[:, first])
        n = self.x.shape[1]
        first = np.repeat(start[:, None], n, axis=1) if job.rule.boosted else np.zeros((job.rule.outputs, n))
        self.sums = {i: first.copy() for i, _, _ in job.members} if not job.rule.boosted else {}
        self.margins = first

    @property
    def raw(self) -> dict[int, np.ndarray]:
        return self.sums if self.of is None else {i: sums[:, self.of] for i, sums in self.sums.items()}

    def add(self, number: int, trees: list[Tree]) -> None:
        if self.job.rule.boosted:
            for k, tree in enumerate(trees):
                self.margins[k] += tree.value[0][tree.leaf_of(self.x)]
            for i, count, _ in self.job.members:
                if number == count - 1:
                    self.sums[i] = self.margins.copy()
            return
        for depth in {d for _, n, d in self.job.members if number < n}:
            values = trees[0].value[:, trees[0].leaf_of(self.x, depth)]
            for i, count, d in self.job.members:
                if d == depth and number < count:
                    self.sums[i] += values


def _outputs_of_part(j: int, job: Job, part: int, held, fold: Fold, grow, began: float) -> Iterator[dict]:
    if not held:
        return
    blocks, ys, _, xs = zip(*held)
    tally = _Tally(job, np.concatenate(xs, axis=1), fold.start(job.rule), fold.cells)
    grow(tally.add)
    seconds = time.perf_counter() - began
    ends = np.cumsum([len(y) for y in ys])
    for i, raw in tally.raw.items():
        for block, y, end in zip(blocks, ys, ends):
            yield {"model": i, "fold": job.fold, "part": part, "block": block, "y": y.tobytes(), "raw": raw[:, end - len(y):end].tobytes(), "seconds": seconds}


def _trees_of_part(j: int, job: Job, part: int, held, fold: Fold, grow, began: float) -> Iterator[dict]:
    found = []
    grow(lambda number, trees: found.append({"job": j, "round": number, "trees": packed(trees)}))
    return iter(found)


# Kinds of rows, counted where the rows lie.

class _Counted:
    """Rows of equal bins (and, of classes, equal labels) by kind, where kinds are few.

    What a tree sees of the rows are weights and sums by kind. These are counted by jobs over the blocks, once for all models
    that draw by the same seed: boosting by several rates shares the hashes, and forests share the draws of a tree. Trees then
    grow on kinds, as many as they are, however many rows there are.
    """

    def __init__(self, folds: Folds, codes: dict[int, np.ndarray]):
        self.folds, self.codes, self.jobs = folds, codes, folds.jobs()
        # By fold and way of drawing: the trees that draw by it and the rates, () for bootstraps, (1.0,) for all rows.
        self.ways: dict[int, dict[tuple, tuple[int, list[float]]]] = {}
        for job in self.jobs:
            way, rate = self._way(job.rule)
            trees, rates = self.ways.setdefault(job.fold, {}).get(way, (0, []))
            self.ways[job.fold][way] = max(trees, job.rule.trees), sorted({*rates, rate})

    @staticmethod
    def _way(rule: Rule) -> tuple[tuple, float]:
        if not rule.boosted:
            return ("bootstrap", rule.seed), 1.0
        return (("all", 0), 1.0) if rule.rate >= 1 else (("rate", rule.seed), rule.rate)

    @classmethod
    def of(cls, folds: Folds) -> _Counted | None:
        """None where the rows are few, or the kinds are not."""
        if "counted" not in vars(folds):
            folds.counted = cls._made(folds)
        return folds.counted

    @classmethod
    def _made(cls, folds: Folds) -> _Counted | None:
        shapes = _shapes(folds)
        most = min(MOST_KINDS, TASK_CELLS // (2 * max(len(folds.names), 1)), min(k.rows for k in folds.known.values()) // growth.ROWS_A_KIND)
        if max(k.rows for k in folds.known.values()) < COUNT_ROWS or any(w >= 2**62 for _, _, _, w in shapes.values()):
            return None

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for fold, n, y, x in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "y", "x"))):
                    codes = _codes(shapes[fold], np.frombuffer(y), np.frombuffer(x, np.uint8).reshape(-1, n))
                    found[fold] = np.union1d(found.get(fold, codes[:0]), codes)
                    if len(found[fold]) > most:
                        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary())], ["fold", "codes"])
                        return
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([c.tobytes() for c in found.values()], pa.binary())], ["fold", "codes"])

        def merge(table: pa.Table) -> pa.Table:
            codes = np.unique(np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("codes")]))
            return pa.table({"fold": table.column("fold")[:1], "codes": pa.array([codes[:most + 1].tobytes()], pa.binary())})

        rows = folds.blocks.mapInArrow(run, "fold int, codes binary").groupBy("fold").applyInArrow(merge, "fold int, codes binary").collect()
        found = {r["fold"]: np.frombuffer(r["codes"], np.int64) for r in rows}
        return None if -1 in found or any(len(c) > most for c in found.values()) else cls(folds, found)

    def _draws(self) -> DataFrame:
        """``(fold, way, rate, tree, counts, sums)``: weights and sums of numbers by kind, written once."""
        shapes, known, codes_by_fold = _shapes(self.folds), self.folds.known, self.codes
        ways = {fold: list(enumerate(mine.items())) for fold, mine in self.ways.items()}
        # Weights and sums of all folds by tree that a task holds at once.
        cells = 2 * sum(len(codes_by_fold[f]) * sum(len(rates) for _, (_, (_, rates)) in mine) for f, mine in ways.items())
        at_once = max(1, TASK_CELLS // max(cells, 1))
        trees = max(n for mine in ways.values() for _, (_, (n, _)) in mine)
        schema, path = "fold int, way int, rate int, tree int, counts binary, sums binary", scratch_path(self.folds.spark, "draws")
        names = [c.split()[0] for c in schema.split(", ")]

        def job(first: int, end: int) -> None:
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                totals: dict[tuple, np.ndarray] = {}
                steps = {(fold, way): growth.Steps(rates) for fold, mine in ways.items() for way, ((name, _), (_, rates)) in mine if name == "rate"}

                def add(fold: int, way: int, tree: int, kind, place, weights, own, kinds: int) -> None:
                    """``place`` is the first rate that a row is drawn at, None if it is at all."""
                    index, n = (kind, kinds) if place is None else (place * kinds + kind, kinds * (len(ways[fold][way][1][1][1]) + 1))
                    new = np.stack([np.bincount(index, weights, n), np.bincount(index, own if weights is None else own * weights, n)])
                    key = fold, way, tree
                    totals[key] = totals[key] + new if key in totals else new

                for batch in batches:
                    for fold, n, *data in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "y", "place", "x"))):
                        y, place, x = _arrays(*data, n)
                        kinds = len(codes_by_fold[fold])
                        kind = np.searchsorted(codes_by_fold[fold], _codes(shapes[fold], y, x))
                        own = np.zeros(n) if shapes[fold][0] else np.rint((y - known[fold].mean) * (growth.SCALE / known[fold].spread))
                        for way, ((name, seed), (count, rates)) in ways[fold]:
                            if name == "all":
                                if not first:
                                    add(fold, way, 0, kind, None, None, own, kinds)
                                continue
                            for t in range(first, min(end, count)):
                                if name == "bootstrap":
                                    add(fold, way, t, kind, None, growth.bootstrap(place, seed, t), own, kinds)
                                else:
                                    add(fold, way, t, kind, steps[fold, way].of(growth.hashed(place, seed, t, 2)), None, own, kinds)
                for (fold, way, tree), (counts, sums) in totals.items():
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (fold, way, 0, tree)), *(pa.array([v.tobytes()], pa.binary()) for v in (counts, sums))], names)

            def added(table: pa.Table) -> pa.Table:
                fold, way, tree = (table.column(c)[0].as_py() for c in ("fold", "way", "tree"))
                counts, sums = (reduce(np.add, (np.frombuffer(b.as_py()) for b in table.column(c))).reshape(-1, len(codes_by_fold[fold])) for c in ("counts", "sums"))
                rates = ways[fold][way][1][1][1]
                if len(counts) > 1:
                    # Rows that are drawn at a rate are drawn at all higher ones.
                    counts, sums = counts.cumsum(axis=0)[:-1], sums.cumsum(axis=0)[:-1]
                return pa.Table.from_arrays([*(pa.array([v] * len(rates), pa.int32()) for v in (fold, way)), pa.array(range(len(rates)), pa.int32()), pa.array([tree] * len(rates), pa.int32()),
                                             *(pa.array([v.tobytes() for v in values], pa.binary()) for values in (counts, sums))], names)

            rows = self.folds.blocks.where("NOT held")
            tasks = max(1, min(rows.rdd.getNumPartitions(), self.folds.spark.sparkContext.defaultParallelism * 2))
            rows.coalesce(tasks).mapInArrow(run, schema).groupBy("fold", "way", "tree").applyInArrow(added, schema).write.mode("append").parquet(path)

        for first in range(0, trees, at_once):
            job(first, min(trees, first + at_once))
            if all(name == "all" for mine in ways.values() for _, ((name, _), _) in mine):
                break
        return self.folds.spark.read.schema(schema).parquet(path)

    def in_tasks(self, of_part, schema: str) -> DataFrame:
        """``of_part`` over the kinds of each part's fold: a part is a job, or some trees of a forest."""
        parts, listed = _parts(self.jobs), []
        for i, (_, job, _, p) in enumerate(parts):
            way, rate = self._way(job.rule)
            order = list(self.ways[job.fold])
            listed.append((i, job.fold, order.index(way), self.ways[job.fold][way][1].index(rate), 1 if job.rule.boosted else min(FOREST_PARTS, job.rule.trees), p, job.rule.trees))
        wanted = self.folds.spark.createDataFrame(listed, "part int, fold int, way int, rate int, share int, number int, trees int")
        arrow, known, codes, shapes = _arrow_schema(self.folds.spark, schema), self.folds.known, self.codes, _shapes(self.folds)

        def run(found: pa.Table) -> pa.Table:
            began = time.perf_counter()
            j, job, numbers, p = parts[found.column("part")[0].as_py()]
            fold, rule = known[job.fold], job.rule
            x, y = growth.kinds_from(codes[job.fold], *shapes[job.fold][:3])
            every = rule.boosted and rule.rate >= 1
            trees = [None] if every else found.column("tree").to_pylist()
            counts, sums = (dict(zip(trees, (np.frombuffer(b.as_py()) for b in found.column(c)))) for c in ("counts", "sums"))
            counted = growth.Counted(x, y, fold.cells, counts, sums if rule.link == IDENTITY else {})

            def grow(seen) -> None:
                ours = counted, fold.start(rule), fold.scale(rule), rule, fold.cells
                growth.boost_on(*ours, seen) if rule.boosted else growth.plant_on(*ours, numbers, seen)

            held = [(0, y, None, x)]
            return pa.Table.from_pylist(list(of_part(j, job, p, held, fold, grow, began)), arrow)

        mine = (F.col("tree") % F.col("share") == F.col("number")) & (F.col("tree") < F.col("trees"))
        paired = self._draws().join(F.broadcast(wanted), ["fold", "way", "rate"]).where(mine).repartitionByRange(max(1, len(parts)), "part")
        return paired.groupBy("part").applyInArrow(run, schema)

    def outputs(self) -> DataFrame:
        """What each model makes of the kinds of its fold: sums over the trees of a part."""
        path = scratch_path(self.folds.spark, "tree-outputs")
        self.in_tasks(_outputs_of_part, OUTPUTS).write.parquet(path)
        return self.folds.spark.read.schema(OUTPUTS).parquet(path)

    def predictions(self, outputs: DataFrame) -> DataFrame:
        rules, codes, shapes = dict(enumerate(self.folds.rules)), self.codes, _shapes(self.folds)

        def added(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            model = table.column("model")[0].as_py()
            raw = reduce(np.add, [np.frombuffer(b.as_py()) for b in table.column("raw")]).reshape(rules[model].outputs, -1)
            return pa.table({"model": table.column("model")[:1], "fold": table.column("fold")[:1], "guess": pa.array([decided(raw, rules[model]).tobytes()], pa.binary())})

        # A number for each kind and model, within TASK_CELLS.
        guesses: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in outputs.groupBy("model").applyInArrow(added, "model int, fold int, guess binary").collect():
            guesses.setdefault(r["fold"], []).append((r["model"], np.frombuffer(r["guess"])))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fold, n, y, x in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "y", "x"))):
                    y = np.frombuffer(y)
                    kind = np.searchsorted(codes[fold], _codes(shapes[fold], y, np.frombuffer(x, np.uint8).reshape(-1, n)))
                    for model, guess in guesses.get(fold, []):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, model, np.int32)), pa.array(np.full(n, fold, np.int32)), pa.array(y), pa.array(guess[kind])], ["model", "fold", "label", "prediction"])

        return self.folds.blocks.where("held").mapInArrow(run, PREDICTIONS)


def _shapes(folds: Folds) -> dict[int, tuple[bool, list[int], int, int]]:
    """By fold: whether labels are classes, bins by feature, number of classes, number of codes."""
    out = {}
    for fold, known in folds.known.items():
        sizes, classes = [len(e) + 1 for e in known.edges], max(len(known.shares), 1)
        out[fold] = bool(known.shares), sizes, classes, reduce(lambda a, b: a * b, sizes, classes)
    return out


def _codes(shape: tuple, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    labelled, sizes, classes, _ = shape
    return growth.codes_of(x, y if labelled else None, sizes, classes)


# A level of all trees at a time.

class _Spread:
    """Growth over all rows where they lie. Margins are written every ``KEEP_ROUNDS`` rounds; trees since then are applied again."""

    def __init__(self, folds: Folds):
        self.folds, self.jobs_, self.spark = folds, folds.jobs(), folds.spark
        self.rows = folds.blocks.where("NOT held").withColumn("margins", F.lit(None).cast("binary"))
        self.tasks = self.rows.rdd.getNumPartitions()
        self.recent: list[list[list[Tree]]] = [[] for _ in self.jobs_]

    def grown(self) -> list[list[list[Tree]]]:
        """By job, the trees of each round."""
        out: list[list[list[Tree]]] = [[] for _ in self.jobs_]
        for t in range(max(self._steps(job.rule) for job in self.jobs_)):
            live = [j for j, job in enumerate(self.jobs_) if t < self._steps(job.rule)]
            trees = {(j, k): Growing(self.jobs_[j].rule, len(self.folds.known[self.jobs_[j].fold].edges), self._outputs(j), self._number((j, k), t))
                     for j in live for k in self._trees(j, t)}
            for depth in range(max(self.jobs_[j].rule.depth for j in live)):
                wanted = {key: g for key, g in trees.items() if len(g.open) and depth < g.rule.depth}
                if not wanted:
                    break
                for key, cuts in self._level(wanted, t).items():
                    wanted[key].split(cuts)
            self._finish(trees, t, out)
            if (t + 1) % KEEP_ROUNDS == 0:
                self._write_margins()
        return out

    @staticmethod
    def _steps(rule: Rule) -> int:
        return rule.trees if rule.boosted else -(-rule.trees // TOGETHER)

    def _trees(self, j: int, t: int) -> range:
        """Trees that grow together: those of a round by output, or some of a forest by number."""
        rule = self.jobs_[j].rule
        return range(rule.outputs) if rule.boosted else range(t * TOGETHER, min((t + 1) * TOGETHER, rule.trees))

    def _number(self, key: tuple[int, int], t: int) -> int:
        return t if self.jobs_[key[0]].rule.boosted else key[1]

    def _outputs(self, j: int) -> int:
        return 1 if self.jobs_[j].rule.boosted else self.jobs_[j].rule.outputs

    def _finish(self, growing: dict, t: int, out: list) -> None:
        found = {key: g.tree() for key, g in growing.items()}
        bent = {key: tree for key, tree in found.items() if self.jobs_[key[0]].rule.boosted and self.jobs_[key[0]].rule.link != IDENTITY}
        sums = self._leaf_sums(bent, t) if bent else {}
        for j in sorted({j for j, _ in found}):
            job, fold = self.jobs_[j], self.folds.known[self.jobs_[j].fold]
            mine = [found[j, k] for k in self._trees(j, t)]
            if job.rule.boosted:
                mine = [growth.finished(tree, job.rule, fold.scale(job.rule), sums.get((j, k))) for k, tree in enumerate(mine)]
                self.recent[j].append(mine)
                out[j].append(mine)
            else:
                out[j] += [[growth.averaged(tree, job.rule, fold.start(job.rule), fold.scale(job.rule))] for tree in mine]

    def _margins_of(self):
        """A function that gives the margins of a block's rows under a job."""
        jobs, known, recent = self.jobs_, self.folds.known, self.recent
        offsets, width = {}, {}
        for j, job in enumerate(jobs):
            if job.rule.boosted:
                offsets[j] = width.get(job.fold, 0)
                width[job.fold] = offsets[j] + job.rule.outputs

        def margins(j: int, x: np.ndarray, kept: bytes | None) -> np.ndarray:
            rule, n = jobs[j].rule, x.shape[1]
            if kept is None:
                found = np.repeat(known[jobs[j].fold].start(rule)[:, None], n, axis=1)
            else:
                found = np.frombuffer(kept).reshape(-1, n)[offsets[j]:offsets[j] + rule.outputs].copy()
            for trees in recent[j]:
                for k, tree in enumerate(trees):
                    found[k] += tree.value[0][tree.leaf_of(x)]
            return found

        return margins

    def _write_margins(self) -> None:
        jobs, margins = self.jobs_, self._margins_of()
        boosted = [j for j, job in enumerate(jobs) if job.rule.boosted]
        if not boosted:
            return

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for fold, n, x, kept in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "x", "margins"))):
                    x = np.frombuffer(x, np.uint8).reshape(-1, n)
                    out.append(np.concatenate([margins(j, x, kept) for j in boosted if jobs[j].fold == fold]).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(out, pa.binary())], batch.schema.names)

        path, shape = scratch_path(self.spark, "margins"), self.rows.schema
        self.rows.mapInArrow(run, shape).write.parquet(path)
        self.rows = self.spark.read.schema(shape).parquet(path)
        self.recent = [[] for _ in jobs]

    def _targets_of(self):
        """A function that gives the weights, pulls (or targets of a forest) and curvatures of a block's rows in a tree of a job."""
        jobs, known, margins = self.jobs_, self.folds.known, self._margins_of()

        def targets(j: int, number: int, y, place, x, kept):
            rule, fold = jobs[j].rule, known[jobs[j].fold]
            weights = growth.drawn(place, rule, number)
            if rule.boosted:
                return weights, *growth.pulls(y, margins(j, x, kept), rule, fold.start(rule), fold.scale(rule))
            return weights, growth.forest_targets(y, rule, fold.start(rule), fold.scale(rule)), None

        return targets

    def _level(self, wanted: dict, t: int) -> dict:
        """The best cuts of the open nodes of some trees, a bounded number of cells at a time."""
        asked, size, found = [], 0, {key: {} for key in wanted}
        for key, growing in wanted.items():
            cells = int(self.folds.known[self.jobs_[key[0]].fold].cells.starts[-1]) * (1 + self._outputs(key[0]))
            at_once = max(1, TASK_CELLS // cells)
            for a in range(0, len(growing.open), at_once):
                n = len(growing.open[a:a + at_once]) * cells
                if asked and size + n > TASK_CELLS:
                    self._cuts(wanted, asked, t, found)
                    asked, size = [], 0
                asked.append((key, a, a + at_once))
                size += n
        self._cuts(wanted, asked, t, found)
        return {key: Cuts.joined([cuts for _, cuts in sorted(parts.items(), key=lambda p: p[0])]) for key, parts in found.items()}

    def _cuts(self, wanted: dict, asked: list, t: int, found: dict) -> None:
        jobs, known, targets_of = self.jobs_, self.folds.known, self._targets_of()
        trees = {key: growing.tree() for key, growing in wanted.items()}
        allowed = {key: growing.allowed() for key, growing in wanted.items()}
        spots = []
        for key, a, b in asked:
            place = np.full(len(trees[key].feature), -1, np.int32)
            place[wanted[key].open[a:b]] = np.arange(len(wanted[key].open[a:b]))
            spots.append((key, a, place, None if allowed[key] is None else allowed[key][a:b]))
        by_fold: dict[int, dict[tuple[int, int], list[int]]] = {}
        for s, (key, *_) in enumerate(spots):
            by_fold.setdefault(jobs[key[0]].fold, {}).setdefault((key[0], self._number(key, t)), []).append(s)
        schema = "spot int, at int, n bigint, counts binary, sums binary"

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for fold, y, place, x, kept in _some_blocks(batch):
                    for (j, number), mine in by_fold.get(fold, {}).items():
                        weights, targets, _ = targets_of(j, number, y, place, x, kept)
                        drawn = np.arange(len(y)) if weights is None else np.flatnonzero(weights)
                        for s in mine:
                            (_, k), _, where, fine = spots[s]
                            slot = where[trees[j, k].leaf_of(x, rows=drawn)]
                            there = slot >= 0
                            live, slot = drawn[there], slot[there]
                            own = [targets[k]] if jobs[j].rule.boosted else targets
                            own = own if weights is None else [v * weights for v in own]
                            new = growth.histograms(x, live, slot, int(where.max()) + 1, fine, known[fold].cells, weights, own)
                            totals[s] = [a + b for a, b in zip(totals[s], new)] if s in totals else list(new)
            for s, (counts, sums) in totals.items():
                some = np.flatnonzero(counts.any(axis=1))
                for a in range(0, len(some), 64):
                    part = some[a:a + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([counts.shape[1]] * len(part), pa.int64()),
                        pa.array([counts[i].tobytes() for i in part], pa.binary()), pa.array([sums[:, i].tobytes() for i in part], pa.binary()),
                    ], ["spot", "at", "n", "counts", "sums"])

        def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            return tuple(reduce(np.add, (np.frombuffer(b.as_py()) for b in table.column(c))) for c in ("counts", "sums"))

        def merge(table: pa.Table) -> pa.Table:
            counts, sums = added(table)
            return table.slice(0, 1).select(["spot", "at", "n"]).append_column("counts", pa.array([counts.tobytes()], pa.binary())).append_column(
                "sums", pa.array([sums.tobytes()], pa.binary()))

        def choose(table: pa.Table) -> pa.Table:
            s = table.column("spot")[0].as_py()
            counts, sums = added(table)
            rule, cells = jobs[spots[s][0][0]].rule, known[jobs[spots[s][0][0]].fold].cells
            cuts = growth.best_cuts(counts[None, :], sums.reshape(-1, 1, len(counts)), cells, rule.least)
            return pa.table({"spot": table.column("spot")[:1], "at": table.column("at")[:1], "cuts": pa.array([packed([cuts])], pa.binary())})

        counted = self.rows.mapInArrow(count, schema)
        if self.tasks > TASK_GROUPS:
            # Two steps, so that no task adds up the histograms of very many others.
            grouped = counted.withColumn("group", F.spark_partition_id() % TASK_GROUPS)
            counted = grouped.groupBy("spot", "at", "group").applyInArrow(lambda t: merge(t.drop(["group"])), schema)
        for r in counted.groupBy("spot", "at").applyInArrow(choose, "spot int, at int, cuts binary").collect():
            key, a, _, _ = spots[r["spot"]]
            found[key][a + r["at"]] = Cuts(*pickle.loads(r["cuts"])[0])

    def _leaf_sums(self, trees: dict, t: int) -> dict:
        """Pull and curvature by node of the trees of a round."""
        jobs, targets_of = self.jobs_, self._targets_of()
        by_fold: dict[int, dict[int, list[int]]] = {}
        for j, k in trees:
            by_fold.setdefault(jobs[j].fold, {}).setdefault(j, []).append(k)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for fold, n, *data, kept in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "y", "place", "x", "margins"))):
                    y, place, x = _arrays(*data, n)
                    for j, mine in by_fold.get(fold, {}).items():
                        weights, pull, curve = targets_of(j, t, y, place, x, kept)
                        for k in mine:
                            new = growth.leaf_sums(trees[j, k].leaf_of(x), len(trees[j, k].feature), weights, pull[k], curve[k])
                            totals[j, k] = totals[j, k] + new if (j, k) in totals else new
            for (j, k), sums in totals.items():
                some = np.flatnonzero(sums.any(axis=0))
                yield pa.RecordBatch.from_arrays([
                    pa.array([j] * len(some), pa.int32()), pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()),
                    pa.array(sums[0, some].astype(np.int64)), pa.array(sums[1, some].astype(np.int64)),
                ], ["job", "output", "node", "pull", "curve"])

        found = self.rows.mapInArrow(run, "job int, output int, node int, pull bigint, curve bigint")
        out = {key: np.zeros((2, len(tree.feature))) for key, tree in trees.items()}
        for r in found.groupBy("job", "output", "node").agg(F.sum("pull").alias("pull"), F.sum("curve").alias("curve")).collect():
            out[r["job"], r["output"]][:, r["node"]] = r["pull"], r["curve"]
        return out


def _applied(folds: Folds, grown: list[list[list[Tree]]]) -> DataFrame:
    """The trees of all jobs over the held-out blocks."""
    jobs, known = folds.jobs(), folds.known
    arrow = _arrow_schema(folds.spark, OUTPUTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for job, rounds in zip(jobs, grown):
                    if job.fold == row["fold"]:
                        began = time.perf_counter()
                        tally = _Tally(job, np.frombuffer(row["x"], np.uint8).reshape(-1, row["n"]), known[job.fold].start(job.rule), known[job.fold].cells)
                        for number, trees in enumerate(rounds):
                            tally.add(number, trees)
                        seconds = time.perf_counter() - began
                        yield from pa.Table.from_pylist([
                            {"model": i, "fold": job.fold, "part": 0, "block": row["block"], "y": row["y"], "raw": raw.tobytes(), "seconds": seconds}
                            for i, raw in tally.raw.items()
                        ], arrow).to_batches()

    return folds.blocks.where("held").mapInArrow(run, OUTPUTS)


# Fitted models.

class TreeModel(_Fitted):
    """A fitted forest or boosting; adds ``prediction`` and, for classes, ``probability`` under the library's names."""

    _trees: list[Tree] = []
    _limits: list[np.ndarray] = []

    @classmethod
    def grown(cls, rule: Rule, start: np.ndarray, trees: list[Tree], edges: list[np.ndarray]) -> TreeModel:
        model = cls.of({"rule": asdict(rule), "start": [float(v) for v in start], "features": len(edges)})
        model._trees = trees
        widest = np.zeros((len(edges), max(len(e) for e in edges) + 1))
        for i, e in enumerate(edges):
            widest[i, :len(e)] = e
        model._limits = [np.where(t.feature >= 0, widest[np.maximum(t.feature, 0), t.cut], 0.0) for t in trees]
        return model

    @property
    def rule(self) -> Rule:
        return Rule(**self.learned["rule"])

    @property
    def trees(self) -> list[tuple[Tree, np.ndarray]]:
        """The trees, with the value that each node is cut at; in boosting with several classes one after another by class."""
        return list(zip(self._trees, self._limits))

    @property
    def featureImportances(self) -> DenseVector:
        total = np.zeros(self.learned["features"])
        for tree in self._trees:
            inner = tree.feature >= 0
            if inner.any():
                total += np.bincount(tree.feature[inner], tree.gain[inner], len(total)) / tree.gain.sum()
        return Vectors.dense(total / total.sum() if total.any() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        rule, start, trees = self.rule, np.array(self.learned["start"]), self.trees

        def raw(x: pd.Series) -> pd.Series:
            columns = np.ascontiguousarray(np.stack(x.to_numpy()).T) if len(x) else np.zeros((1, 0))
            return pd.Series(list(chances(rule, raw_of(trees, rule, start, columns)).T))

        # One value for a number or the second of two classes, else one for each class.
        made = F.pandas_udf(raw, "array<double>")(vector_to_array(F.col("features")))
        out = df.withColumn("__made", made)
        first = F.col("__made")[0]
        if rule.link == IDENTITY:
            return out.withColumn(PREDICTION, first).drop("__made")
        shares = F.col("__made") if rule.outputs > 1 else F.array(1 - first, first)
        out = out.withColumn("__shares", shares)
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return out.withColumn(PROBABILITY, array_to_vector("__shares")).withColumn(PREDICTION, best.cast("double")).drop("__made", "__shares")

    def write(self) -> MLWriter:
        return _TreeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreeReader(cls)


def raw_of(trees: list[tuple[Tree, np.ndarray]], rule: Rule, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Margins, or means over the trees, by output; ``x`` is features x rows."""
    total = np.repeat(start[:, None], x.shape[1], axis=1) if rule.boosted else np.zeros((rule.outputs, x.shape[1]))
    for i, (tree, limits) in enumerate(trees):
        leaf = tree.leaf_of(x, limits=limits)
        if rule.boosted:
            total[i % rule.outputs] += tree.value[0][leaf]
        else:
            total += tree.value[:, leaf] / rule.trees
    return total


def chances(rule: Rule, raw: np.ndarray) -> np.ndarray:
    return growth.chances(raw, rule.link) if rule.boosted else raw


TREE_TABLE = "tree int, feature array<int>, cut array<int>, limit array<double>, left array<int>, n array<double>, gain array<double>, value array<array<double>>"


class _TreeWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        rows = [
            (i, t.feature.tolist(), t.cut.tolist(), limit.tolist(), t.left.tolist(), t.rows.tolist(), t.gain.tolist(), t.value.tolist())
            for i, (t, limit) in enumerate(self.instance.trees)
        ]
        self.sparkSession.createDataFrame(rows, TREE_TABLE).write.parquet(f"{path}/trees")


class _TreeReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        rows = sorted(self.sparkSession.read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
        model._trees = [
            Tree(np.array(r["feature"], np.int32), np.array(r["cut"], np.uint8), np.array(r["left"], np.int32), np.array(r["n"]),
                 np.array(r["gain"]), np.array(r["value"], dtype=float))
            for r in rows
        ]
        model._limits = [np.array(r["limit"]) for r in rows]
        return model


__all__ = ["Folds", "TreeBoosting", "TreeFamily", "TreeForest", "TreeModel"]
