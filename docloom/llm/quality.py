"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

Features are indicators of word and word-shape n-grams, hashed to a fixed number of columns. Every column is scaled
by its class log-count ratio, rows are brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve over cross-fitted margins turns margins into probabilities. The fit uses a bounded sample of
labelled rows (``FIT_ROWS``, the rows with the smallest hash of their id), in one task; the driver gets the model alone. Scoring reads
every whole text, narrowly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.hashing import run_hashes, runs

BITS = 18
FIT_ROWS = 8_000
FIT_BYTES = 128 << 20  # of column lists in the task that fits, 4 bytes a column
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("X"), ord("x"), ord("9"), ord("x")


def _shapes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' outlines: runs of capitals, small letters and digits are one sign each, so are repeated other signs."""
    kind = _CLASS[b]
    turn = np.ones(len(b), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    place = np.cumsum(turn)
    return run_hashes(kind[turn], place[starts] - 1, place[ends - 1])


class Features:
    """Column numbers of the indicators of a text."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.mark = np.zeros(1 << bits, bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct columns of one text; an empty text has none. Words are separated by blanks."""
        streams = []
        for kind, data in enumerate((text.lower(), text)):
            b = np.frombuffer(data.encode("utf-8", "surrogatepass"), np.uint8)
            starts, ends = runs(~_BLANK[b])
            if not len(starts):
                return np.zeros(0, np.int64)
            streams.append((_shapes(b, starts, ends), 3) if kind else (run_hashes(b, starts, ends), 2))
        with np.errstate(over="ignore"):
            for kind, (ids, most) in enumerate(streams):
                h = ids + np.uint64(kind * 1000 + 1)
                for n in range(1, min(most, len(ids)) + 1):
                    if n > 1:
                        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _M2 + ids[n - 1 :]
                    column = (h ^ (h >> np.uint64(32))) * _M2
                    column >>= np.uint64(40)
                    column &= self.mask
                    self.mark[column.view(np.int64)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over unit rows of scaled indicators; classes are weighted to balance half-way.

    A row's values are looked up at each step: lists of them would take several times the memory of ``rows``.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    norms = [np.linalg.norm(scale[r]) or 1.0 for r in rows]
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())]) / max(1, len(y))
    upper = cost * np.sqrt(0.5 / share)[(y > 0).astype(int)]
    alpha = np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r = rows[i].astype(np.intp, copy=False)
            v = scale[r] / norms[i]
            gradient = y[i] * (w[r] @ v + bias) - 1.0
            a = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), upper[i])
            if (step := a - alpha[i]) != 0.0:
                w[r] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = a
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Naive-Bayes log-count ratio of every column: positive where the column marks label 1."""
    p, q = np.full(size, smooth), np.full(size, smooth)
    for r, label in zip(rows, labels, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


class Model:
    """Weights per column with the scaling folded in, and the logistic curve."""

    def __init__(self, scale: np.ndarray, w: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.scale, self.weight, self.bias, self.slope, self.shift = scale.astype(np.float32), (w * scale).astype(np.float32), bias, slope, shift

    def margin(self, columns: np.ndarray) -> float:
        s = self.scale[columns].astype(np.float64)
        return float(self.weight[columns].astype(np.float64).sum() / (np.sqrt((s * s).sum()) or 1.0) + self.bias)

    def score(self, columns: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(columns) + self.shift, -60, 60))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, rounds: int = 12, folds: int = 3, seed: int = 5) -> Model:
    """Train on column lists. Without rows of both classes the score is the share of label 1 (0.5 without any rows)."""
    size, labels = 1 << bits, np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        p = min(max(float(np.mean(labels)) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(p / (1 - p))))

    def one(keep: np.ndarray) -> Model:
        own = [rows[i] for i in keep]
        scale = log_ratios(own, labels[keep], size)
        return Model(scale, *fit_hinge(own, labels[keep], scale, cost, rounds, seed))

    fold = np.random.default_rng(seed).integers(0, folds, len(labels))
    margins = np.zeros(len(labels))
    for k in range(folds):
        if len(set(labels[fold != k].tolist())) == 2:
            part = one(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
    model = one(np.arange(len(labels)))
    model.slope, model.shift = logistic(margins, labels)
    return model


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by damped Newton steps; targets are smoothed as Platt does."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, bits: int = BITS, target: str = "quality") -> Model:
    """Fit on at most ``fit_rows`` labelled rows that are not held out. Labels without a text, or null, are left out.

    The chosen labels are a bounded side and are broadcast; texts become column lists on the executors. One task takes rows in the
    order of a hash of their id, until there are ``FIT_BYTES``, and fits; of several texts under one id one is taken.
    """
    chance = F.xxhash64(F.col("doc_id").cast("long"), F.lit(11))
    chosen = (
        labels.where(~held_out() & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).alias("y"))
        .orderBy(chance, "doc_id").limit(fit_rows)
    )

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(bits).of
        for batch in batches:
            blobs = [of(t.as_py() or "").astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), batch.column(2)], names=["doc_id", "columns", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for doc, found, y in zip(*batch.columns, strict=True):
                if held <= FIT_BYTES:
                    blob = found.as_py()
                    held += len(blob)
                    if held <= FIT_BYTES or not kept:
                        kept.append((doc.as_py(), blob, y.as_py()))
        kept.sort()
        model = fit([np.frombuffer(x, "<i4") for _, x, _ in kept], np.array([y for _, _, y in kept], int), bits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = (
        docs.select(F.col("doc_id").cast("long"), F.col("text")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", F.col("y").cast("int")).mapInArrow(columns, "doc_id long, columns binary, y int")
        .groupBy("doc_id").agg(F.min("columns").alias("columns"), F.first("y").alias("y"))
        .repartition(1).sortWithinPartitions(chance, "doc_id")
    )
    row = found.mapInArrow(fitted, "model binary").first()
    return pickle.loads(row.model) if row else fit([], np.zeros(0, int), bits)  # no task runs over no rows


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """One row per document, see ``SCHEMA``. Null and empty texts get the score of no indicators.

    Repeated rows are scored each, rows without a doc_id too; extra columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Features(bits).of, shared.value
        for batch in batches:
            scores = np.array([m.score(of(t.as_py() or "")) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, bits: int = BITS, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, with all their columns; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Features(bits).of, shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(of(t.as_py() or "")) >= least for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
