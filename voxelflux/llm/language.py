"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 3 and 4 bytes of folded words, word edges included, hashed to buckets. A text is the average of its buckets'
embeddings; a linear layer and a softmax over it give probabilities. Both layers are trained by stochastic gradient
descent in numpy, on a bounded sample of labelled rows. As everything before the softmax is linear, scoring uses the product of both
layers: one row of class logits for each bucket. A slice of the sample that training doesn't see sets a temperature and the rejection threshold.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import BYTE_CODE, LETTERS, U64, chunks, held_out, scramble

BUCKETS, DIM, SIZES = 1 << 14, 16, (3, 4)
UNKNOWN = "und"


def subwords(data: np.ndarray, offs: np.ndarray):
    """Row and bucket of each subword of a chunk; rows are in order. A subword has letters, with a word edge at its ends at most."""
    rows = len(offs) - 1
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    code = np.zeros(len(data) + rows + 1, np.uint8)               # an edge before, between and after the rows
    at = np.arange(len(data)) + row_of + 1
    code[at] = LETTERS[data] if len(data) else data
    row = np.zeros(len(code), np.int64)
    row[at] = row_of
    h1 = np.where(code == 0, U64(0x5D), BYTE_CODE[code])
    letter, out = code != 0, []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = letter[1:m + 1].copy()
        for k in range(2, n - 1):
            ok &= letter[k:k + m]
        pos = np.flatnonzero(ok)
        h = np.zeros(len(pos), U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + h1[pos + k]
        out.append((row[pos + 1], (scramble(h) & U64(BUCKETS - 1)).astype(np.int64)))
    return out


def _counts(batches):
    """Buckets and counts of each row, for training."""
    for batch in batches:
        for i, j, data, offs in chunks(batch.column("text")):
            key = np.concatenate([r * BUCKETS + b for r, b in subwords(data, offs)] or [np.zeros(0, np.int64)])
            key, count = np.unique(key, return_counts=True)
            cut = np.searchsorted(key // BUCKETS, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("label").slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key % BUCKETS).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(count.astype(np.int32)))], names=["label", "bucket", "count"])


def class_sample(rows: DataFrame, label: str, per_class: int, max_classes: int = 256, max_rows: int = 8000) -> DataFrame:
    """About `per_class` rows of each of the `max_classes` most frequent labels, `max_rows` in all, picked by a hash of (doc_id, text): a bounded
    set to fit on."""
    n = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_classes).collect()
    if not n:
        return rows.limit(0)
    per_class = max(1, min(per_class, max_rows // len(n)))
    share = F.element_at(F.create_map(*[F.lit(x) for r in n for x in (r[0], min(1.0, per_class / r["count"]))]), F.col(label))
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)
    return rows.where(picked).limit(2 * per_class * len(n))


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Classes, logits of each bucket, bias, temperature, and the score under which a prediction is rejected."""

    def __init__(self, classes, table, bias, temperature=1.0, reject=0.0):
        self.classes, self.table, self.bias, self.temperature, self.reject = classes, table.astype(np.float32), bias, temperature, reject

    def probabilities(self, sums, counts):
        return _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)


def train(rows, epochs: int = 12, rate: float = 0.5, target_error: float = 0.01, most: float = 0.5, seed: int = 7) -> Model | None:
    """`rows`: (label, buckets, counts). One row in five calibrates: the temperature with the least log loss, then the least rejection threshold at
    which accepted rows have an error of `target_error` at most, but `most` at most: what is likelier right than wrong is not rejected. Rows are also seen as short excerpts, so short texts are calibrated too."""
    classes = sorted({r[0] for r in rows})
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    data = [(classes.index(y), np.asarray(b, np.int64), np.asarray(c, np.float64)) for y, b, c in rows if len(b)]
    order = rng.permutation(len(data))
    fit, hold = [data[k] for k in order[len(data) // 5:]], [data[k] for k in order[:len(data) // 5]]

    def excerpt(c):
        n = int(min(c.sum(), rng.integers(4, 60)))
        return rng.multinomial(n, c / c.sum()).astype(np.float64)

    emb, out, bias = rng.normal(0, 0.3, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, len(classes))), np.zeros(len(classes))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(fit)):
            y, b, c = fit[k]
            if rng.random() < 0.5:
                c = excerpt(c)
            x = c / c.sum()
            mean = x @ emb[b]
            err = _softmax(mean @ out + bias)
            err[y] -= 1
            emb[b] -= step * 10 * x[:, None] * (out @ err)[None, :]
            out -= step * np.outer(mean, err)
            bias -= step * 0.1 * err
    model = Model(classes, emb @ out, bias)
    hold = hold or fit
    logits, truth = [], []
    for y, b, c in hold:
        for w in (c, excerpt(c)):
            logits.append(w @ model.table[b] / w.sum() + bias)
            truth.append(y)
    if not logits:
        return model
    logits, truth = np.array(logits), np.array(truth)
    loss = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 5, 33)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    for t in [0.0, *np.sort(score)]:
        taken = score >= t
        if taken.sum() and 1 - right[taken].mean() <= target_error:
            model.reject = min(float(t), most)
            break
    else:
        model.reject = most
    return model


def fit(docs: DataFrame, label: str = "lang", per_class: int = 500) -> Model | None:
    """A model from labelled rows (doc_id, text, label); at most about 2 * `per_class` rows of a class come to the driver, as bounded lists of buckets."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias("label"))
    picked = class_sample(rows, "label", per_class).select("label", "text").mapInArrow(_counts, "label string, bucket array<int>, count array<int>").collect()
    return train([(r.label, r.bucket, r["count"]) for r in sorted(picked, key=lambda r: (r.label, r.bucket, r["count"]))])


def _scores(model: Model | None, keep):
    def run(batches):
        for batch in batches:
            lang, score, rejected = [], [], []
            for i, j, data, offs in chunks(batch.column("text")):
                n = j - i
                if model is None:
                    lang += [UNKNOWN] * n
                    score += [0.0] * n
                    rejected += [True] * n
                    continue
                sums, counts = np.zeros((n, len(model.classes))), np.zeros(n)
                for row, bucket in subwords(data, offs):
                    if len(row):
                        first = np.flatnonzero(np.diff(row, prepend=-1))
                        sums[row[first]] += np.add.reduceat(model.table[bucket], first, axis=0, dtype=np.float64)
                        counts += np.bincount(row, minlength=n)
                p = model.probabilities(sums, counts)
                ascii_letters = np.concatenate([[0], np.cumsum((LETTERS[data] != 0) & (data < 128))]) if len(data) else np.zeros(1)
                for k in range(n):
                    lettered = ascii_letters[offs[k + 1]] > ascii_letters[offs[k]] or any(map(str.isalpha, data[offs[k]:offs[k + 1]].tobytes().decode("utf-8", "replace")))
                    best = int(p[k].argmax())
                    lang.append(model.classes[best] if lettered else UNKNOWN)
                    score.append(float(p[k, best]) if lettered else 0.0)
                    rejected.append(not lettered or score[-1] < model.reject)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])
    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score, rejected. Only the text is an input of a prediction.

    Null text and text without a letter: `und`, score 0, rejected; so is every row if nothing was learned. Any length of text is read whole;
    rows that repeat are scored alone; a null doc_id stays null; other columns are ignored; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    return docs.mapInArrow(_scores(model, ("doc_id", "held_out")), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` whose language isn't rejected, with all their columns."""
    flag = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = flag.schema["row"].dataType.simpleString()
    out = flag.mapInArrow(_scores(model, ("row",)), f"row {kind}, lang_pred string, score double, rejected boolean")
    return out.where("not rejected").select("row.*")
