"""Training one linear classifier per label, all labels in the same distributed passes.

Rows are packed once into sparse blocks that stay on the executors. Every pass evaluates loss and
gradient of all unfinished classifiers at once; the driver only sees model-sized sums and advances
one L-BFGS state per classifier. A pass costs one scan of the blocks, whatever the number of labels.
After some passes, the curvature of every label is estimated on the executors where its classifiers now
stand; steps scaled by that estimate need far fewer passes. Losses, gradients and the point where a
classifier counts as finished are always those of all rows.

Blocks that are small altogether are broadcast instead, and tasks share out the classifiers: the same
steps on the same sums, without a job for every pass.

Calibration computes the margins of held-out rows once, folds them to a table of distinct margins with
their class counts, and takes its Newton steps on that.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows
from labelloom.operators.scoring import LinearModel, sigmoid
from labelloom.session import cut_lineage, discard, work_path

ALGORITHMS = ("logistic_regression", "linear_svm")
FOLDS = 3
BLOCK_CELLS = 2_000_000  # rows x features of one block when dense: bounds a task's memory
GROUP_CELLS = 1_000_000  # features x classifiers optimised together: bounds the driver's memory
HISTORY = 30  # step and gradient pairs kept per classifier, at every model size
RANKED_TOGETHER = 512  # rows ranked in one window partition, on average
DIRECT_PARTIALS = 64  # more partial sums than this are added up on the executors, slice by slice,
DIRECT_CELLS = 32_768  # and so are those of more doubles altogether
SLICE_CELLS = 16_384  # doubles of one slice
SPARSE_BELOW = 1 / 48  # blocks filled less than this are multiplied by index
FEW = 8  # classifiers that are multiplied by index one by one
INDEX_COST = 5  # a product by index costs as much as so many cells of a dense matrix
LOCAL_VALUES = 8_000_000  # non-zero values (12 bytes each) of all blocks that may be broadcast
LOCAL_CELLS = 40_000_000  # rows x features a task may hold as doubles; above, it multiplies by index
CURVED_FEATURES = 4096  # features squared are doubles of one task: above, no curvature is estimated
CURVED_ROWS = 8  # rows for each feature that an estimate rests on
CURVED_LINES = 512  # lines of a factor that are made and stored together
CURVED_EVERY = 15  # passes between two estimates, at least
PASS_WEIGHT = 8  # an operation of a pass takes as long as so many of an estimate

_BLOCK = "n int, starts binary, idx binary, val binary, y binary, fold binary"
_PARTIAL = "slice int, sums binary"
_DRAWN = "task int, starts binary, idx binary, val binary, curve binary"
_FACTOR = "task int, first int, lines binary"

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fold_ranks(members: DataFrame, rows: int) -> DataFrame:
    """(_key, pos, fold) of (_key, pos, v): ranked by hash within (pos, v) and dealt out in turn.

    One rule for every class size. A histogram over the leading hash bits gives each cell's first
    rank, and only the rows of a cell are ranked against each other. More rows mean more cells, which
    leaves the ranks as they are.
    """
    bits = min(max(ceil(log2(max(rows, 1) / RANKED_TOGETHER)) if rows > RANKED_TOGETHER else 0, 0), 40)
    digest = F.conv(F.substring(F.md5(F.col("_key").cast("string")), 1, 15), 16, 10).cast("long")
    hashed = members.withColumn("_h", digest).withColumn("_cell", F.shiftright("_h", 60 - bits))
    first = F.sum("n").over(W.partitionBy("pos", "v").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    cells = hashed.groupBy("pos", "v", "_cell").agg(F.count(F.lit(1)).alias("n")).select(
        "pos", "v", "_cell", F.coalesce(first, F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("pos", "v", "_cell").orderBy("_h", F.col("_key").cast("string")))
    ranked = hashed.withColumn("_rank", inside).join(cells, ["pos", "v", "_cell"])
    return ranked.select("_key", "pos", ((F.col("_first") + F.col("_rank") - 1) % FOLDS).cast("int").alias("fold"))


def assign_folds(encoded: DataFrame, n_labels: int, key: str = "prompt") -> DataFrame:
    """Adds ``fold ARRAY<INT>``, the calibration fold of the row for every label.

    Folds are balanced within each class of each label, so three members always reach three folds.
    ``key`` must be unique. Narrow (key, label, class) rows are shuffled, not the features.
    """
    members = encoded.select(F.col(key).alias("_key"), F.posexplode("y").alias("pos", "v"))
    dealt = fold_ranks(members, encoded.count()).groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "fold"))).alias("_own"))
    joined = encoded.join(dealt, F.col(key) == F.col("_key"))
    return joined.withColumn("fold", F.transform("_own", lambda f: f["fold"])).drop("_key", "_own")


def pack(rows: DataFrame, n_features: int) -> DataFrame:
    """Blocks of encoded rows (indices, values, y and, for calibration, fold)."""
    block_rows = max(16, BLOCK_CELLS // max(1, n_features))
    has_fold = "fold" in rows.columns

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                idx, val, y = (part.column(i) for i in range(3))
                starts = idx.offsets.to_numpy().astype(np.int64)
                fold = part.column(3).flatten().to_numpy().astype(np.uint8).tobytes() if has_fold else b""
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": pa.array([part.num_rows], pa.int32()),
                        "starts": [(starts - starts[0]).tobytes()],
                        "idx": [idx.flatten().to_numpy().astype(np.int32).tobytes()],
                        "val": [val.flatten().to_numpy().astype(np.float64).tobytes()],
                        "y": [y.flatten().to_numpy().astype(np.uint8).tobytes()],
                        "fold": [fold],
                    }
                )

    columns = ["indices", "values", "y"] + (["fold"] if has_fold else [])
    return cut_lineage(rows.select(*columns).mapInArrow(blocks, _BLOCK)).persist()


class Rows:
    """Rows of a block: a dense matrix where it is filled enough, else indices and values."""

    def __init__(self, block: dict, n_features: int, n_labels: int, sparse: bool = False):
        n = block["n"]
        self.shape = n, n_features
        self.starts = np.frombuffer(block["starts"], np.int64)
        self.idx, self.val = np.frombuffer(block["idx"], np.int32), np.frombuffer(block["val"])
        self.y = np.frombuffer(block["y"], np.uint8).reshape(n, n_labels)
        self.fold = np.frombuffer(block["fold"], np.uint8).reshape(n, -1) if block["fold"] else None
        self.x = None
        if not sparse and len(self.idx) >= SPARSE_BELOW * n * n_features:
            self.x = np.zeros(self.shape)
            self.x[np.repeat(np.arange(n), np.diff(self.starts)), self.idx] = self.val

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows times a features x members matrix."""
        if self.x is not None:
            # The few columns lie in lines, here and below: the other way a product took up to twice as long.
            return (np.ascontiguousarray(weights.T) @ self.x.T).T
        if weights.shape[1] > FEW:
            out = np.empty((self.shape[0], weights.shape[1]))
            for r, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
                out[r] = self.val[a:b] @ weights[self.idx[a:b]]
            return out
        out = np.zeros((self.shape[0], weights.shape[1]))
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            for j in range(weights.shape[1]):
                out[filled, j] = np.add.reduceat(self.val * weights[:, j][self.idx], self.starts[filled])
        return out

    def transposed_times(self, slope: np.ndarray) -> np.ndarray:
        """Transposed rows times a rows x members matrix; a row's indices are different."""
        if self.x is not None:
            return (np.ascontiguousarray(slope.T) @ self.x).T
        out = np.zeros((self.shape[1], slope.shape[1]))
        if slope.shape[1] > FEW:
            for r, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
                out[self.idx[a:b]] += self.val[a:b, None] * slope[r]
            return out
        row, val, feature, first = self.by_feature
        for j in range(slope.shape[1] if len(first) else 0):
            out[feature, j] = np.add.reduceat(val * slope[:, j][row], first)
        return out

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and values in the order of their features, the features that occur, and where each begins."""
        order = np.argsort(self.idx, kind="stable")
        idx = self.idx[order]
        first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]]) if len(idx) else np.empty(0, np.int64)
        return np.repeat(np.arange(self.shape[0]), np.diff(self.starts))[order], self.val[order], idx[first], first


@dataclass(frozen=True)
class Blocks:
    """Packed rows and what every pass needs to know about them."""

    frame: DataFrame
    n_parts: int
    n_features: int
    n_labels: int
    rows: int
    values: int

    def small(self) -> bool:
        """Whether all blocks may be broadcast."""
        return self.values <= LOCAL_VALUES


def _pass(blocks: Blocks, kernel: Callable, payload: dict, size: int) -> np.ndarray:
    """Sum of ``kernel(rows, payload)`` over all blocks; ``size`` doubles per partial."""
    n_features, n_labels = blocks.n_features, blocks.n_labels
    shared = blocks.frame.sparkSession.sparkContext.broadcast(payload)

    spread = blocks.n_parts > DIRECT_PARTIALS or (blocks.n_parts > 1 and blocks.n_parts * size > DIRECT_CELLS)
    slices = ceil(size / SLICE_CELLS) if spread else 1
    edges = np.linspace(0, size, slices + 1).astype(int)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.to_pylist():
                total += kernel(Rows(block, n_features, n_labels), shared.value)
        cut = [total[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "sums": cut})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        total = np.zeros(edges[number + 1] - edges[number])
        for batch in batches:
            for value in batch.column("sums"):
                total += np.frombuffer(value.as_buffer())
        yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "sums": [total.tobytes()]})

    out = blocks.frame.mapInArrow(partial, _PARTIAL)
    if spread:
        out = out.groupBy("slice").applyInArrow(add, _PARTIAL)
    total = np.zeros(size)
    for row in out.collect():
        total[edges[row["slice"]]:edges[row["slice"] + 1]] += np.frombuffer(row["sums"])
    shared.destroy()
    return total


def _signed_margins(rows: Rows, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes as signs, weights and signed margins of the rows for the classifiers in the payload."""
    z = np.where(rows.y[:, p["label"]] == 1, 1.0, -1.0)
    s = np.where(z > 0, p["w_pos"], p["w_neg"])
    if rows.fold is not None:
        s = np.where(rows.fold[:, p["label"]] == p["held_out"], 0.0, s)
    return z, s, z * (rows.times(p["theta"][:-1]) + p["theta"][-1])


def _curves(rows: Rows, p: dict) -> np.ndarray:
    """Second derivatives of the losses in the margins."""
    _, s, m = _signed_margins(rows, p)
    if p["hinge"]:
        return 2.0 * s * (m < 1.0)
    q = sigmoid(m)
    return s * q * (1.0 - q)


def _curve_kernel(rows: Rows, p: dict) -> np.ndarray:
    return _curves(rows, p).sum(0)


def _loss_kernel(rows: Rows, p: dict) -> np.ndarray:
    """Losses, weight gradients and intercept gradients of the classifiers in the payload."""
    z, s, m = _signed_margins(rows, p)
    if p["hinge"]:
        h = np.maximum(0.0, 1.0 - m)
        loss, slope = s * h * h, -2.0 * s * z * h
    else:
        loss, slope = s * np.logaddexp(0.0, -m), -s * z * sigmoid(-m)
    return np.concatenate([loss.sum(0), rows.transposed_times(slope).ravel(), slope.sum(0)])


def inverse_factor(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First line and lines, as far as their diagonal, of the inverse of a matrix's Cholesky factor.

    The lower triangle is read and replaced, lines after lines, so that no second matrix is held; right of the
    diagonal blocks the matrix must be zero.
    """
    for a in range(0, len(matrix), CURVED_LINES):
        b = min(a + CURVED_LINES, len(matrix))
        left = matrix[a:b, :a] @ matrix[:a, :a].T
        block = matrix[a:b, a:b] - left @ left.T
        try:
            own = np.linalg.inv(np.linalg.cholesky(block))
        except np.linalg.LinAlgError:  # indefinite by rounding: any scale serves a step
            own = np.diag(1.0 / np.sqrt(np.maximum(matrix[a:b, a:b].diagonal(), 1.0)))
        matrix[a:b, :a] = -own @ (left @ matrix[:a, :a])
        matrix[a:b, a:b] = own
        yield a, matrix[a:b, :b]


@dataclass
class Curvature:
    """Estimated inverse curvatures (Hessian matrices) of labels, as factors that stay on the executors.

    A label's classifiers share the mean of their curvatures. Rows are drawn by their share in it, with
    known chances, so that a label's estimate is one task's work at any number of rows. Only the
    lengths and directions of steps depend on it. A factor F stands for F'F, which no rounding makes indefinite.
    """

    blocks: Blocks
    spec: dict  # of the classifiers optimised together
    hinge: bool
    c: float
    every: int  # passes between two estimates
    tasks: dict[int, int] | None = None  # labels that have a factor
    path: str = ""
    factors: DataFrame | None = None

    @staticmethod
    def of(blocks: Blocks, spec: dict, hinge: bool, c: float) -> Curvature | None:
        size, members, labels = blocks.n_features + 1, len(spec["label"]), len(np.unique(spec["label"]))
        if size > CURVED_FEATURES:
            return None
        one = 4 * max(1, blocks.rows) * size * members
        estimate = labels * size * size * (min(blocks.rows, CURVED_ROWS * size) + size)
        return Curvature(blocks, spec, hinge, c, max(CURVED_EVERY, ceil(estimate / (PASS_WEIGHT * one))))

    def estimate(self, theta: np.ndarray, cols: np.ndarray) -> None:
        """New factors for the labels of some classifiers, whose parameters are lines of ``theta``."""
        blocks, c, hinge = self.blocks, self.c, self.hinge
        n_features, n_labels, size = blocks.n_features, blocks.n_labels, blocks.n_features + 1
        spark = blocks.frame.sparkSession
        payload = {"theta": np.ascontiguousarray(theta[cols].T), "hinge": hinge}
        payload |= {k: self.spec[k][cols] for k in ("label", "held_out", "w_pos", "w_neg")}
        total = _pass(blocks, _curve_kernel, payload, len(cols))
        owner = payload["label"]
        labels = [int(l) for l in np.unique(owner) if total[owner == l].sum() > 0]
        self.close()
        self.tasks = {l: i for i, l in enumerate(labels)}
        if not labels:
            return
        groups = [(np.flatnonzero(owner == l), CURVED_ROWS * size / total[owner == l].mean()) for l in labels]
        shared = spark.sparkContext.broadcast((payload, groups))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            payload, groups = shared.value
            for batch in batches:
                for block in batch.to_pylist():
                    rows = Rows(block, n_features, n_labels)
                    curves = _curves(rows, payload)
                    random = np.random.default_rng(zlib.crc32(block["idx"]))  # a repeated task draws the same rows
                    for task, (members, share) in enumerate(groups):
                        curve = curves[:, members].mean(1)
                        chance = np.minimum(1.0, curve * share)
                        at = np.flatnonzero(random.random(len(curve)) < chance)
                        if not len(at):
                            continue
                        n = rows.starts[at + 1] - rows.starts[at]
                        ends = np.cumsum(n)
                        cells = np.repeat(rows.starts[at] - (ends - n), n) + np.arange(ends[-1])
                        yield pa.RecordBatch.from_pydict({
                            "task": pa.array([task], pa.int32()), "starts": [np.r_[0, ends].tobytes()],
                            "idx": [rows.idx[cells].tobytes()], "val": [rows.val[cells].tobytes()],
                            "curve": [(c * curve[at] / chance[at]).tobytes()]})

        def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, task = np.zeros((size, size)), None
            held, filled = np.zeros((2 * CURVED_LINES, size)), 0

            def add() -> None:
                for a in range(0, size, CURVED_LINES):
                    b = min(a + CURVED_LINES, size)
                    total[a:b, :b] += held[:, a:b].T @ held[:, :b]

            for batch in batches:
                for r in batch.to_pylist():
                    task = r["task"]
                    starts, curve = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["curve"])
                    idx, val = np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"])
                    at = 0
                    while at < len(curve):
                        end = min(len(curve), at + len(held) - filled)
                        root, n = np.sqrt(curve[at:end]), np.diff(starts[at:end + 1])
                        line, cells = np.arange(filled, filled + end - at), slice(starts[at], starts[end])
                        held[np.repeat(line, n), idx[cells]] = val[cells] * np.repeat(root, n)
                        held[line, -1] = root
                        filled, at = filled + end - at, end
                        if filled == len(held):
                            add()
                            held[:], filled = 0.0, 0
            if task is None:
                return
            add()
            diagonal = np.arange(size - (not hinge))  # a logistic intercept is free
            total[diagonal, diagonal] += 1.0
            total[-1, -1] *= 1.0 + 1e-9
            for first, lines in inverse_factor(total):
                yield pa.RecordBatch.from_pydict({
                    "task": pa.array([task], pa.int32()), "first": pa.array([first], pa.int32()),
                    "lines": [lines.astype(np.float32).tobytes()]})

        self.path = work_path(spark, "curvature")
        drawn = blocks.frame.mapInArrow(draw, _DRAWN).repartitionById(len(labels), F.col("task"))
        drawn.mapInArrow(factor, _FACTOR).write.parquet(self.path)
        shared.destroy()
        self.factors = spark.read.schema(_FACTOR).parquet(self.path).persist()

    def times(self, vectors: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Estimated inverse curvatures of some classifiers times a vector each; a vector stays if there is none."""
        if self.factors is None:
            return vectors
        shared = self.factors.sparkSession.sparkContext.broadcast(
            (vectors, np.array([self.tasks.get(int(l), -1) for l in self.spec["label"][cols]])))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, task = shared.value
            out = {}
            for batch in batches:
                for r in batch.to_pylist():
                    of = np.flatnonzero(task == r["task"])
                    if not len(of):
                        continue
                    lines = np.frombuffer(r["lines"], np.float32)
                    # Lines first .. first + n - 1 reach to column first + n.
                    n = int(round((np.sqrt(r["first"] ** 2 + 4 * len(lines)) - r["first"]) / 2))
                    lines = lines.reshape(n, r["first"] + n).astype(np.float64)
                    sums = out.setdefault(r["task"], np.zeros((len(of), vectors.shape[1])))
                    sums[:, :lines.shape[1]] += (vectors[of, :lines.shape[1]] @ lines.T) @ lines
            for number, sums in out.items():
                yield pa.RecordBatch.from_pydict({"task": pa.array([number], pa.int32()), "products": [sums.tobytes()]})

        task, out = shared.value[1], vectors.copy()
        found = self.factors.mapInArrow(multiply, "task int, products binary").collect()
        for number in {r["task"] for r in found}:
            out[task == number] = sum(np.frombuffer(r["products"]) for r in found if r["task"] == number).reshape(
                -1, vectors.shape[1])
        shared.destroy()
        return out

    def close(self) -> None:
        """Drop the factors."""
        if self.factors is not None:
            self.factors.unpersist()
            discard(self.factors.sparkSession, self.path)
        self.factors, self.tasks = None, None


@dataclass
class Fit:
    """Classifiers of one optimisation: columns of ``theta`` (last row: intercepts)."""

    theta: np.ndarray
    gradient: np.ndarray  # largest gradient entry per classifier, divided by the row weight sum
    passes: int


def minimise(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rows: int, columns: int,
             scale: np.ndarray, tol: float, max_passes: int, memory: int = HISTORY, curvature: Curvature | None = None) -> Fit:
    """Independent L-BFGS per column; every pass serves one trial point of every unfinished column.

    A column whose step was too long retries with a shorter one while the others move on. With ``curvature``,
    directions start from estimated inverse curvatures once there are some, instead of a multiple of the identity.
    """
    theta = np.zeros((columns, rows))  # one classifier per line while searching

    def at(points: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, g = evaluate(np.ascontiguousarray(points.T), cols)
        return f, np.ascontiguousarray(g.T)

    loss, grad = at(theta, np.arange(columns))
    s_hist = np.zeros((columns, memory, rows))
    y_hist = np.zeros((columns, memory, rows))
    rho = np.zeros((columns, memory))
    stored = np.zeros(columns, int)  # pairs ever stored; the newest sits in slot (stored - 1) % memory
    direction = -grad
    step = 1.0 / np.maximum(np.linalg.norm(grad, axis=1), 1e-12)
    active = np.abs(grad).max(1) / scale > tol
    passes, since, times = 1, 1, None
    while active.any() and passes < max_passes:
        cols = np.flatnonzero(active)
        if curvature is not None and since >= curvature.every:
            curvature.estimate(theta, cols)
            since, times = 0, curvature.times
            direction[cols] = -_two_loop(grad[cols], cols, s_hist, y_hist, rho, stored, step, times)
            step[cols] = 1.0
        trial = theta[cols] + step[cols, None] * direction[cols]
        f, g = at(trial, cols)
        passes, since = passes + 1, since + 1
        slope = (grad[cols] * direction[cols]).sum(1)
        slack = 1e-10 * np.maximum(1.0, np.abs(loss[cols]))
        ok = f <= loss[cols] + 1e-4 * step[cols] * slope + slack
        retry = cols[~ok]
        if times is None:
            step[retry] *= 0.4
        else:  # to the least value of the parabola through both points
            first = step[retry] * slope[~ok]
            step[retry] *= np.clip(-first / (2.0 * np.maximum(f[~ok] - loss[retry] - first, 1e-300)), 0.1, 0.5)
        active[retry[step[retry] < 1e-14]] = False
        done = cols[ok]
        if not len(done):
            continue
        ds, dy = trial[ok] - theta[done], g[ok] - grad[done]
        theta[done], loss[done], grad[done] = trial[ok], f[ok], g[ok]
        sy = (ds * dy).sum(1)
        good = sy > 1e-12 * np.maximum((dy * dy).sum(1), 1e-300)
        kept, slot = done[good], stored[done[good]] % memory
        s_hist[kept, slot], y_hist[kept, slot], rho[kept, slot] = ds[good], dy[good], 1.0 / sy[good]
        stored[kept] += 1
        active[done] = np.abs(grad[done]).max(1) / scale[done] > tol
        more = done[active[done]]
        if len(more):
            direction[more] = -_two_loop(grad[more], more, s_hist, y_hist, rho, stored, step, times)
            step[more] = 1.0
    return Fit(theta.T.copy(), np.abs(grad).max(1) / scale, passes)


def _two_loop(grad, done, s_hist, y_hist, rho, stored, step, times=None) -> np.ndarray:
    """Inverse-Hessian estimate times gradient for the classifiers ``done``; ``times`` is what it starts from."""
    memory = s_hist.shape[1]
    depth = np.minimum(stored[done], memory)
    q = grad.copy()
    alpha = np.zeros((len(done), memory))
    for k in range(depth.max()):
        slot = (stored[done] - 1 - k) % memory
        alpha[:, k] = np.where(k < depth, rho[done, slot] * (s_hist[done, slot] * q).sum(1), 0.0)
        q -= alpha[:, k, None] * y_hist[done, slot]
    newest = (stored[done] - 1) % memory
    if times is None:
        yy = (y_hist[done, newest] ** 2).sum(1) * rho[done, newest]
        q *= np.where(depth > 0, 1.0 / np.where(yy > 0, yy, 1.0), step[done])[:, None]
    else:
        q, curved = np.split(times(np.vstack([q, y_hist[done, newest]]), np.r_[done, done]), 2)
        yy = (y_hist[done, newest] * curved).sum(1) * rho[done, newest]
        q *= np.where((depth > 0) & (yy > 0), 1.0 / np.where(yy > 0, yy, 1.0), 1.0)[:, None]
    for k in range(depth.max() - 1, -1, -1):
        slot = (stored[done] - 1 - k) % memory
        beta = rho[done, slot] * (y_hist[done, slot] * q).sum(1)
        q += np.where(k < depth, alpha[:, k] - beta, 0.0)[:, None] * s_hist[done, slot]
    return q


def _counts(rows: DataFrame, n_labels: int) -> np.ndarray:
    """(label, fold, class) row counts; without folds everything counts as fold 0."""
    fold = F.col("fold") if "fold" in rows.columns else F.array_repeat(F.lit(0), n_labels)
    cells = F.arrays_zip(F.col("y").alias("y"), fold.alias("f"))
    grouped = (
        rows.select(F.posexplode(cells).alias("pos", "c"))
        .groupBy("pos", F.col("c.f").alias("fold"))
        .agg(F.sum("c.y").alias("p"), F.count(F.lit(1)).alias("n"))
    )
    out = np.zeros((n_labels, FOLDS, 2))
    for r in bounded_rows(grouped, n_labels * FOLDS, "class counts"):
        out[r["pos"], r["fold"]] = (r["n"] - r["p"], r["p"])
    return out


def _balanced(neg: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = neg + pos
    return n / (2.0 * pos), n / (2.0 * neg)


def _newton(at: Callable[[np.ndarray, np.ndarray], np.ndarray], cal_neg: np.ndarray, cal_pos: np.ndarray,
            max_passes: int = 60) -> np.ndarray:
    """Sigmoid parameters per classifier by damped Newton steps; ``at`` gives six sums for points and classifiers."""
    c = len(cal_pos)
    ab = np.vstack([np.zeros(c), np.log((cal_neg + 1.0) / (cal_pos + 1.0))])
    current = at(ab, np.arange(c))
    step = np.ones(c)
    active = np.ones(c, bool)
    scale = np.maximum(cal_neg + cal_pos, 1.0)
    for _ in range(max_passes):
        active &= np.abs(current[1:3]).max(0) / scale > 1e-7
        cols = np.flatnonzero(active)
        if not len(cols):
            break
        _, ga, gb, haa, hab, hbb = current[:, cols]
        haa, hbb = haa + 1e-10, hbb + 1e-10
        det = np.maximum(haa * hbb - hab * hab, 1e-300)
        move = np.vstack([-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det])
        trial = ab[:, cols] + step[cols] * move
        found = at(trial, cols)
        drop = (np.vstack([ga, gb]) * move).sum(0)
        ok = found[0] <= current[0, cols] + 1e-4 * step[cols] * drop + 1e-12 * np.maximum(1.0, current[0, cols])
        ab[:, cols[ok]], current[:, cols[ok]] = trial[:, ok], found[:, ok]
        step[cols[ok]] = 1.0
        step[cols[~ok]] *= 0.5
        active[cols[step[cols] < 1e-8]] = False
    return ab


def _targets(cal_neg: np.ndarray, cal_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed targets of the sigmoid fit for positive and negative rows."""
    return (cal_pos + 1.0) / (cal_pos + 2.0), 1.0 / (cal_neg + 2.0)


def held_out_margins(blocks: Blocks, theta: np.ndarray, label: np.ndarray, held_out: np.ndarray) -> DataFrame:
    """(member, margin, positives, negatives) over the rows that a member has not seen: one scan of the blocks.

    A checkpointed table of distinct margins.
    """
    n_features, n_labels = blocks.n_features, blocks.n_labels
    shared = blocks.frame.sparkSession.sparkContext.broadcast((theta, label, held_out))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, label, held_out = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                rows = Rows(block, n_features, n_labels)
                margin = rows.times(theta[:-1]) + theta[-1]
                row, member = np.nonzero(rows.fold[:, label] == held_out)
                yield pa.RecordBatch.from_pydict({
                    "member": pa.array(member, pa.int32()), "margin": margin[row, member],
                    "y": pa.array(rows.y[row, label[member]], pa.int32())})

    found = blocks.frame.mapInArrow(cells, "member int, margin double, y int")
    return cut_lineage(found.groupBy("member", "margin").agg(
        F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives")))


def _platt(blocks: Blocks, theta: np.ndarray, label: np.ndarray, held_out: np.ndarray, cal_neg: np.ndarray,
           cal_pos: np.ndarray) -> np.ndarray:
    """Sigmoid parameters of members fitted over all blocks; a Newton step sums over distinct margins."""
    margins = held_out_margins(blocks, theta, label, held_out).persist()
    t_pos, t_neg = _targets(cal_neg, cal_pos)
    spark = blocks.frame.sparkSession
    f = F.col("a") * F.col("margin") + F.col("b")
    q, count = 1.0 / (1.0 + F.exp(f)), F.col("positives") + F.col("negatives")
    wanted = F.col("positives") * F.col("t_pos") + F.col("negatives") * F.col("t_neg")
    # log(1 + exp(f)) without overflow; log(1 + exp(-f)) is the same less f.
    softplus = F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f)))
    loss = wanted * softplus + (count - wanted) * (softplus - f)
    d, h = wanted - count * q, count * q * (1.0 - q)
    m = F.col("margin")
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate((loss, d * m, d, h * m * m, h * m, h))]

    def at(point: np.ndarray, cols: np.ndarray) -> np.ndarray:
        given = spark.createDataFrame(
            [(int(j), *map(float, (point[0, i], point[1, i], t_pos[j], t_neg[j]))) for i, j in enumerate(cols)],
            "member int, a double, b double, t_pos double, t_neg double")
        out, place = np.zeros((6, len(cols))), {int(j): i for i, j in enumerate(cols)}
        # One row per member on either side.
        for r in margins.join(F.broadcast(given), "member").groupBy("member").agg(*sums).collect():
            out[:, place[r["member"]]] = [r[f"s{i}"] for i in range(6)]
        return out

    ab = _newton(at, cal_neg, cal_pos)
    margins.unpersist()
    return ab


def _platt_rows(rows: list[Rows], theta: np.ndarray, label: np.ndarray, held_out: np.ndarray, cal_neg: np.ndarray,
                cal_pos: np.ndarray) -> np.ndarray:
    """The same from the rows of all blocks in one task."""
    t_pos, t_neg = _targets(cal_neg, cal_pos)
    parts = [(r.times(theta[:-1]) + theta[-1], r.fold[:, label] == held_out, r.y[:, label] == 1) for r in rows]
    found = []
    for j in range(len(label)):
        held = np.concatenate([h[:, j] for _, h, _ in parts])
        found.append((np.concatenate([m[:, j] for m, _, _ in parts])[held],
                      np.where(np.concatenate([y[:, j] for _, _, y in parts])[held], t_pos[j], t_neg[j])))

    def at(point: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.zeros((6, len(cols)))
        for i, j in enumerate(cols):
            m, t = found[j]
            f = point[0, i] * m + point[1, i]
            q = sigmoid(-f)
            d, h = t - q, q * (1.0 - q)
            loss = t * np.logaddexp(0.0, f) + (1.0 - t) * np.logaddexp(0.0, -f)
            out[:, i] = [v.sum() for v in (loss, d * m, d, h * m * m, h * m, h)]
        return out

    return _newton(at, cal_neg, cal_pos)


def _objective(sums: np.ndarray, point: np.ndarray, n_features: int, hinge: bool, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Regularised losses and gradients from the sums of ``_loss_kernel``."""
    k = point.shape[1]
    loss = c * sums[:k]
    grad = c * np.vstack([sums[k : k + n_features * k].reshape(n_features, k), sums[-k:]])
    reg = point if hinge else np.vstack([point[:-1], np.zeros(k)])
    return loss + 0.5 * (reg * reg).sum(0), grad + reg


def _solve_in_passes(blocks: Blocks, spec: dict, hinge: bool, c: float, tol: float, max_passes: int):
    """Parameters of all classifiers; every trial point is a job over the blocks."""
    size, members = blocks.n_features + 1, len(spec["label"])
    theta, gradient, passes = np.zeros((size, members)), np.zeros(members), 0
    slope, offset = np.full(members, -1.0), np.zeros(members)
    group = max(1, GROUP_CELLS // size)
    for at in range(0, members, group):
        part = np.arange(at, min(at + group, members))

        def evaluate(point: np.ndarray, cols: np.ndarray, part=part) -> tuple[np.ndarray, np.ndarray]:
            ids = part[cols]
            payload = {"theta": point, "hinge": hinge} | {k: spec[k][ids] for k in ("label", "held_out", "w_pos", "w_neg")}
            sums = _pass(blocks, _loss_kernel, payload, len(ids) * (size + 1))
            return _objective(sums, point, blocks.n_features, hinge, c)

        curvature = Curvature.of(blocks, {k: v[part] for k, v in spec.items()}, hinge, c)
        fit = minimise(evaluate, size, len(part), spec["weight"][part], tol, max_passes, curvature=curvature)
        if curvature is not None:
            curvature.close()
        theta[:, part], gradient[part] = fit.theta, fit.gradient
        passes += fit.passes
        if hinge:
            slope[part], offset[part] = _platt(
                blocks, fit.theta, *(spec[k][part] for k in ("label", "held_out", "cal_neg", "cal_pos")))
    return theta, gradient, slope, offset, passes


def _solve_in_tasks(blocks: Blocks, spec: dict, hinge: bool, c: float, tol: float, max_passes: int):
    """The same for blocks of at most ``LOCAL_VALUES`` non-zero values, which every task holds; tasks share out classifiers."""
    n_features, n_labels, members = blocks.n_features, blocks.n_labels, len(spec["label"])
    spark = blocks.frame.sparkSession
    shared = spark.sparkContext.broadcast(([r.asDict() for r in blocks.frame.collect()], spec))
    tasks = max(1, min(members, spark.sparkContext.defaultParallelism))
    # A dense matrix is read whole for every product, whether for one classifier or for a dozen.
    dense = blocks.rows * n_features
    by_index = dense > LOCAL_CELLS or blocks.values * ceil(members / tasks) * INDEX_COST < dense

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for batch in batches for i in batch.column(0).to_pylist()], int)
        if not len(ids):
            return
        packed, spec = shared.value
        rows = [Rows(b, n_features, n_labels, by_index) for b in packed]
        own = {k: v[ids] for k, v in spec.items()}

        def evaluate(point: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            payload = {"theta": point, "hinge": hinge} | {k: own[k][cols] for k in ("label", "held_out", "w_pos", "w_neg")}
            sums = np.zeros(len(cols) * (n_features + 2))
            for r in rows:
                sums += _loss_kernel(r, payload)
            return _objective(sums, point, n_features, hinge, c)

        fit = minimise(evaluate, n_features + 1, len(ids), own["weight"], tol, max_passes)
        ab = np.vstack([np.full(len(ids), -1.0), np.zeros(len(ids))])
        if hinge:
            ab = _platt_rows(rows, fit.theta, *(own[k] for k in ("label", "held_out", "cal_neg", "cal_pos")))
        yield pa.RecordBatch.from_pydict({
            "member": pa.array(ids, pa.int32()), "theta": [t.tobytes() for t in fit.theta.T], "gradient": fit.gradient,
            "slope": ab[0], "offset": ab[1], "passes": pa.array([fit.passes] * len(ids), pa.int32())})

    theta, gradient, passes = np.zeros((n_features + 1, members)), np.zeros(members), 0
    slope, offset = np.full(members, -1.0), np.zeros(members)
    if members:
        dealt = spark.range(members).select((F.col("id") % tasks).cast("int").alias("task"), F.col("id").cast("int").alias("member"))
        dealt = dealt.repartitionByRange(tasks, "task").select("member")
        solved = dealt.mapInArrow(solve, "member int, theta binary, gradient double, slope double, offset double, passes int")
        for r in solved.collect():
            j = r["member"]
            theta[:, j], gradient[j], slope[j], offset[j] = np.frombuffer(r["theta"]), r["gradient"], r["slope"], r["offset"]
            passes = max(passes, r["passes"])
    shared.destroy()
    return theta, gradient, slope, offset, passes


def fit_models(
    encoded: DataFrame,
    labels: Sequence[str],
    n_features: int,
    algorithm: str = "logistic_regression",
    c: float = 1.0,
    balanced: bool = True,
    tol: float = 1e-4,
    max_passes: int = 2000,
    key: str = "prompt",
    version: str = "unknown",
) -> tuple[LinearModel, list[dict]]:
    """Train every label of ``encoded`` (key, indices, values, y); returns the model and a report.

    logistic_regression: L2, free intercept. linear_svm: squared hinge, penalised intercept, three
    calibrated members per label whose probabilities are averaged. A label without positives or
    without negatives gets no member and scores 0.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    hinge = algorithm == "linear_svm"
    n_labels = len(labels)
    rows = assign_folds(encoded, n_labels, key) if hinge else encoded
    counts = _counts(rows, n_labels)
    total = counts.sum(1)
    label, held = [], []
    for j in range(n_labels):
        if total[j].min() == 0:
            continue
        if not hinge:
            label.append(j)
            held.append(255)
            continue
        for f in range(FOLDS):
            if (total[j] - counts[j, f]).min() > 0 and counts[j, f].sum() > 0:
                label.append(j)
                held.append(f)
    label, held = np.array(label, int), np.array(held, int)
    seen = total[label] - np.where((held < FOLDS)[:, None], counts[label, np.minimum(held, FOLDS - 1)], 0.0)
    if balanced:
        w_pos, w_neg = _balanced(seen[:, 0], seen[:, 1])
    else:
        w_pos = w_neg = np.ones(len(label))
    packed = pack(rows, n_features)
    held_rows, values = packed.agg(F.sum("n"), F.sum(F.octet_length("idx"))).first()
    blocks = Blocks(packed, packed.rdd.getNumPartitions(), n_features, n_labels, held_rows or 0, (values or 0) // 4)
    spec = {"label": label, "held_out": held, "w_pos": w_pos, "w_neg": w_neg, "weight": seen.sum(1),
            "cal_neg": counts[label, np.minimum(held, FOLDS - 1), 0], "cal_pos": counts[label, np.minimum(held, FOLDS - 1), 1]}
    solve = _solve_in_tasks if blocks.small() else _solve_in_passes
    theta, gradient, slope, offset, passes = solve(blocks, spec, hinge, c, tol, max_passes)
    packed.unpersist()
    model = LinearModel(tuple(labels), theta[:-1], theta[-1], label, slope, offset,
                        algorithm=algorithm, version=version)
    report = [
        {
            "label": labels[j], "positives": int(total[j, 1]), "negatives": int(total[j, 0]),
            "members": int((label == j).sum()),
            "gradient": float(gradient[label == j].max()) if (label == j).any() else None,
            "passes": passes,
        }
        for j in range(n_labels)
    ]
    return model, report
