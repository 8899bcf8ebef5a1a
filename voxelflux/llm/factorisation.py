"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pairs are never formed: for each factor they sum to half of the square
of the sum of v_i x_i minus the sum of its squares, so scoring is linear in the number of features. Training is stochastic gradient descent with
per-weight steps in numpy, on a bounded sample of labelled rows; a slice that it doesn't see fits a logistic calibration, weighted back to the shares of the classes.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashed import STATS, features, inputs, labelled
from .textops import chunks, held_out

BUCKETS, FACTORS = 1 << 14, 8


class Machine:
    """Weights of all features (words, then statistics), bias, factors, and the calibration (slope, offset)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(BUCKETS + len(STATS))
        self.v = rng.normal(0, 0.05, (BUCKETS + len(STATS), FACTORS))
        self.slope, self.offset = 1.0, 0.0

    def raw(self, idx, x) -> float:
        """One row, by the sum-of-squares identity."""
        vx = self.v[idx] * x[:, None]
        return self.bias + self.w[idx] @ x + 0.5 * ((vx.sum(axis=0) ** 2) - (vx ** 2).sum(axis=0)).sum()

    def raw_rows(self, row, bucket, x, dense) -> np.ndarray:
        """Many rows at once; `row` is in order."""
        n = len(dense)
        w, v = self.w[BUCKETS:], self.v[BUCKETS:]
        linear, sums, squares = self.bias + dense @ w, dense @ v, (dense ** 2) @ (v ** 2)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            vx = self.v[bucket] * x[:, None]
            linear = linear + np.bincount(row, self.w[bucket] * x, minlength=n)
            sums[row[first]] += np.add.reduceat(vx, first, axis=0)
            squares[row[first]] += np.add.reduceat(vx * vx, first, axis=0)
        return linear + 0.5 * (sums ** 2 - squares).sum(axis=1)

    def score(self, raw):
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))


def train(rows, stand_for: dict, epochs: int = 12, rate: float = 0.1, penalty: float = 1e-4, seed: int = 7) -> Machine:
    """`rows`: (label 0 or 1, buckets, weights, statistics); `stand_for`: labelled rows that one row of a class stands for. With one class or none,
    the score is the share of label 1 (one half without labels)."""
    m, rng = Machine(seed), np.random.default_rng(seed)
    data = [(int(y), np.concatenate([b, BUCKETS + np.arange(len(STATS))]).astype(np.int64), np.concatenate([x, s])) for y, b, x, s in rows]
    if len({y for y, _, _ in data}) < 2:
        m.slope, m.offset = 0.0, (30.0 if data[0][0] else -30.0) if data else 0.0
        return m
    order = rng.permutation(len(data))
    fit, hold = [data[k] for k in order[len(data) // 5:]], [data[k] for k in order[:len(data) // 5]]
    gw, gv, gb = np.full(len(m.w), 1e-8), np.full(m.v.shape, 1e-8), 1e-8
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            y, idx, x = fit[k]
            vx = m.v[idx] * x[:, None]
            s = vx.sum(axis=0)
            err = 1 / (1 + np.exp(-np.clip(m.bias + m.w[idx] @ x + 0.5 * (s ** 2 - (vx ** 2).sum(axis=0)).sum(), -30, 30))) - y
            dw = err * x + penalty * m.w[idx]
            dv = err * x[:, None] * (s - vx) + penalty * m.v[idx]
            gw[idx] += dw ** 2
            gv[idx] += dv ** 2
            gb += err ** 2
            m.w[idx] -= rate * dw / np.sqrt(gw[idx])
            m.v[idx] -= rate * dv / np.sqrt(gv[idx])
            m.bias -= rate * err / np.sqrt(gb)
    hold = hold if len({y for y, _, _ in hold}) == 2 else fit
    z, y = np.array([m.raw(i, x) for _, i, x in hold]), np.array([y for y, _, _ in hold])
    weight = np.array([stand_for.get(int(k), 1.0) for k in y])
    weight /= weight.sum()
    a, b = 1.0, 0.0
    for _ in range(2000):                                         # weighted logistic fit of (slope, offset), slightly held to slope 1
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - y)
        a, b = a - 0.05 * ((g * z).sum() + 0.01 * (a - 1)), b - 0.5 * g.sum()
    m.slope, m.offset = max(a, 0.0), b
    return m


def fit(docs: DataFrame, labels: DataFrame, label: Column | None = None, per_class: int = 1500) -> Machine:
    """A machine from labelled documents; about `per_class` rows of each class come to the driver, as bounded lists of buckets."""
    label = F.col("quality") if label is None else label
    return train(*labelled(docs, labels, F.when(label.isin(0, 1), label), per_class, BUCKETS))


def score(docs: DataFrame, machine: Machine, cut: float = 0.7) -> DataFrame:
    """One row per row of `docs` (doc_id, text, n_chars if there is such a column): doc_id, held_out, score, predicted (1 if score >= `cut`).
    Labels, language, source and doc_id are no inputs of a score.

    Null and empty texts are scored by their statistics; any length of text is read whole; rows that repeat are scored alone; a null doc_id
    stays null; other columns are ignored; an empty table gives no row.
    """
    def run(batches):
        for batch in batches:
            chars, out = np.asarray(batch.column("n_chars")), []
            for i, j, data, offs in chunks(batch.column("text")):
                out.append(machine.score(machine.raw_rows(*features(data, offs, chars[i:j], BUCKETS))))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return inputs(docs, held_out("doc_id").alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
