"""Mixing by soft membership: documents get rates so that expected domain token totals match targets.

A softmax classifier over hashed words and structure statistics, trained on a labelled table, gives each document a posterior over domains. A document of t tokens with
rate r adds r * t * posterior to the domain totals. Rates minimise

    sum over domains (total / scale - target share)^2 / 2 + ridge / 2 * sum over documents (t / scale) (r - 1)^2,   r >= 0,

by projected gradient steps (`matched` weighs the domains and moves the goals until the totals meet the targets themselves): the first term needs only the vector of totals, which Spark sums in every step, and a document's step
needs only its own posterior. Rates are a function of the posteriors and of the vectors so far, so the driver holds one vector of
domain totals for each step, and no document.
"""
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashed import STATS, features, inputs, labelled
from .textops import NONSPACE, Words, chunks, stored

BUCKETS = 1 << 13
#: Domains of the labelled table, by quality and toxic: 0 good, 1 poor, 2 toxic.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def domain_label() -> Column:
    """Number of a labelled row's domain; null where a label is missing or unknown."""
    known = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    return F.when(known, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0))


class Softmax:
    def __init__(self, classes: int):
        self.w, self.b = np.zeros((BUCKETS + len(STATS), classes)), np.zeros(classes)

    def posterior(self, row, bucket, x, dense) -> np.ndarray:
        z = dense @ self.w[BUCKETS:] + self.b
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            z[row[first]] += np.add.reduceat(self.w[bucket] * x[:, None], first, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(rows, stand_for: dict, classes: int, epochs: int = 15, rate: float = 0.5, seed: int = 7) -> Softmax:
    """Stochastic gradient descent with per-weight steps over (label, buckets, weights, statistics); the bias is corrected to the classes' shares in the table.
    Without rows the posterior is uniform; a class without rows gets next to nothing."""
    m, rng = Softmax(classes), np.random.default_rng(seed)
    if not rows:
        return m
    data = [(int(y), np.concatenate([b, BUCKETS + np.arange(len(STATS))]).astype(np.int64), np.concatenate([x, s])) for y, b, x, s in rows]
    seen = np.bincount([y for y, _, _ in data], minlength=classes)
    g = np.full(m.w.shape, 1e-8)
    gb = np.full(classes, 1e-8)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, idx, x = data[k]
            z = x @ m.w[idx] + m.b
            e = np.exp(z - z.max())
            err = e / e.sum()
            err[y] -= 1
            dw = x[:, None] * err[None, :] + 1e-5 * m.w[idx]
            g[idx] += dw ** 2
            gb += err ** 2
            m.w[idx] -= rate * dw / np.sqrt(g[idx])
            m.b -= rate * err / np.sqrt(gb)
    weight = np.array([stand_for.get(k, 1.0) for k in range(classes)])
    m.b += np.where(seen > 0, np.log(weight / weight.max() + 1e-12), -20)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Softmax:
    """A classifier of domains from the labelled table; about `per_class` rows of each domain come to the driver, as bounded lists of buckets."""
    return train(*labelled(docs, labels, domain_label(), per_class, BUCKETS), len(DOMAINS))


def memberships(docs: DataFrame, model: Softmax, *keep: Column) -> DataFrame:
    """Token counts (words) and domain posteriors of each row: doc_id, the columns `keep` (with names of their own), tokens, posterior."""
    source = inputs(docs, *keep)
    names = source.columns[3:]

    def run(batches):
        for batch in batches:
            chars, post, tokens = np.asarray(batch.column("n_chars")), [], []
            for i, j, data, offs in chunks(batch.column("text")):
                post.append(model.posterior(*features(data, offs, chars[i:j], BUCKETS)))
                w = Words(data, offs, NONSPACE)
                tokens.append(w.last - w.first)
            p = np.concatenate(post) if post else np.zeros((0, len(DOMAINS)))
            cut = pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(k) for k in names], pa.array(np.concatenate(tokens) if tokens else [], pa.int64()),
                                              pa.ListArray.from_arrays(cut, pa.array(p.ravel()))], names=["doc_id", *names, "tokens", "posterior"])
    extra = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in names)
    return source.mapInArrow(run, f"doc_id long, {extra}tokens long, posterior array<double>")


def rates(posterior: np.ndarray, pulls, step: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents after the steps whose gradients over domain totals are `pulls`, from rate 1, and the points where the next gradient
    is taken (projected gradient with constant momentum)."""
    keep = np.sqrt(step * ridge)
    momentum = (1 - keep) / (1 + keep)
    r = z = np.ones(len(posterior))
    for g in pulls:
        new = np.maximum(z - step * (posterior @ np.asarray(g) + ridge * (z - 1)), 0)
        r, z = new, np.maximum(new + momentum * (new - r), 0)
    return r, z


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(DOMAINS))


def _totals(pulls, step: float, ridge: float):
    """Sums of a partition: tokens per domain at the rates, and at the points of the next gradient."""
    def run(batches):
        out = np.zeros((2, len(DOMAINS)))
        for batch in batches:
            p = _matrix(batch.column("posterior"))
            t = np.asarray(batch.column("tokens"), np.float64)
            for k, x in enumerate(rates(p, pulls, step, ridge)):
                out[k] += (t * x) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * len(DOMAINS)), pa.int32()), pa.array(out.ravel())], names=["k", "total"])
    return run


def fitted(members: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = 0.01, steps: int = 80, tolerance: float = 2e-4):
    """Gradients of the projected-gradient fit and the totals that it reaches: (pulls, step, totals as shares of the input's tokens). `members`
    should be stored: every step reads its tokens and posteriors once. It ends when no domain share changes by over `tolerance`, or after `steps`."""
    goal = np.array([targets[d] for d in DOMAINS], float)
    step, pulls, last = 1.0 / (1.0 + ridge), [], None
    scale = float(members.agg(F.sum("tokens")).first()[0] or 0)
    if not scale:
        return pulls, step, np.zeros(len(DOMAINS))
    small = members.select("tokens", "posterior")
    while True:
        rows = small.mapInArrow(_totals(pulls, step, ridge), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
        share, ahead = np.array([r.total for r in sorted(rows)]).reshape(2, -1) / scale
        if len(pulls) == steps or last is not None and np.abs(share - last).max() <= tolerance:
            return pulls, step, share
        pulls.append((ahead - goal).tolist())
        last = share


def _told(share: np.ndarray, goal: np.ndarray, met: bool) -> np.ndarray:
    if not met:
        warnings.warn("targets are not met: " + ", ".join(f"{d} {x:.5f} of {g:.5f}" for d, x, g in zip(DOMAINS, share, goal)), stacklevel=3)
    return share


def matched(members: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = 0.01, steps: int = 80, tolerance: float = 0.01):
    """Gradients of the projected-gradient fit and the totals that it reaches: (pulls, step, totals as shares of the input's tokens). `members` should be stored: every step reads its
    tokens and posteriors once. Domains weigh by the inverse of their input shares (no eigenvalue grows beyond 1), and whenever the totals stand still the goals are
    moved by what is missing (method of multipliers), so that the ridge only chooses among rates that meet the targets. It ends when every total
    is within `tolerance` of its target, relative to it, when three moves bring nothing, or after `steps`; in the latter cases a warning names the totals. Without tokens all totals are 0."""
    goal = np.array([targets[d] for d in DOMAINS], float)
    step, pulls, last, aim = 1.0 / (1.0 + ridge), [], None, goal.copy()
    scale = float(members.agg(F.sum("tokens")).first()[0] or 0)
    if not scale:
        return pulls, step, np.zeros(len(DOMAINS))
    small, best, idle = members.select("tokens", "posterior"), np.inf, 0
    while True:
        rows = small.mapInArrow(_totals(pulls, step, ridge), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
        share, ahead = np.array([r.total for r in sorted(rows)]).reshape(2, -1) / scale
        if last is None:
            weight = np.divide(1, share, out=np.zeros_like(share), where=share > 0)
        gap = np.abs(share - goal) / np.maximum(goal, 1e-6)
        if len(pulls) == steps or gap.max() <= tolerance:
            return pulls, step, _told(share, goal, gap.max() <= tolerance)
        if last is not None and (np.abs(share - last) <= 0.1 * np.abs(share - goal) + tolerance / 10 * goal).all():
            idle = idle + 1 if gap.max() > 0.99 * best else 0
            best = min(best, gap.max())
            if idle == 3:
                return pulls, step, _told(share, goal, False)
            aim = aim + goal - share
        pulls.append(((ahead - aim) * weight).tolist())
        last = share


def mixed(docs: DataFrame, labels: DataFrame, *keep: Column, targets: dict[str, float] = TARGETS, ridge: float = 0.01, per_class: int = 1200) -> DataFrame:
    """One row per row of `docs` (doc_id, text, n_chars if there is such a column): doc_id, the columns `keep`, tokens, the posterior of each domain
    (p_good, p_poor, p_toxic), rate. Rates are expected copies: 0 leaves a document out, 2 takes it twice.

    Null and empty texts have no token, add nothing and keep a rate by their posterior; rows that repeat are rated alike; a null
    doc_id stays null; labels may be empty (posteriors are uniform then); an empty table gives no row. Targets are shares of the input's tokens.
    """
    members = stored(memberships(docs, fit(docs, labels, per_class), *keep))
    pulls, step, _ = matched(members, targets, ridge)
    names = members.columns

    def run(batches):
        for batch in batches:
            p = _matrix(batch.column("posterior"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], *[pa.array(p[:, k]) for k in range(len(DOMAINS))],
                                              pa.array(rates(p, pulls, step, ridge)[0])], names=[*names[:-1], *[f"p_{d}" for d in DOMAINS], "rate"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema.fields[:-1])
    return members.mapInArrow(run, schema + "".join(f", p_{d} double" for d in DOMAINS) + ", rate double")


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of `docs` with their columns, `rate` and `copies` (in place of columns of these names): copies is a draw with mean rate by a hash of doc_id and text, and rows of no copy
    go. Nulls, empty texts and tables as in `mixed`."""
    rows = mixed(docs, labels, F.struct("*").alias("_row"), targets=targets)
    draw = F.pmod(F.xxhash64("doc_id", "_row.text"), F.lit(1 << 30)) / (1 << 30)
    free = [c for c in docs.columns if c not in ("rate", "copies")]
    return rows.select(*[F.col("_row")[c].alias(c) for c in free], "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies")).where("copies > 0")
