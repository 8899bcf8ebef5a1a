"""Hashed words and structure statistics of texts, as sparse rows for the classifiers."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import SPACES, Words, U64, chunks, lowered

#: Words between white space, with the letters A to Z in lower case and edge punctuation left on.
FOLD = lowered(lambda c: c not in SPACES and c != 0 and c not in b".,;:!?\"'()")
STATS = ("log_words", "word_length", "symbols", "capitals", "digits", "stops", "lines", "distinct", "exclaims", "log_chars")


def features(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray, buckets: int):
    """Row and bucket of each distinct word of a row, its weight (rows have length 1), and the dense statistics (rows x STATS)."""
    rows = len(offs) - 1
    words = Words(data, offs, FOLD)
    bucket = (words.hash & U64(buckets - 1)).astype(np.int64)
    key, count = np.unique(words.row * buckets + bucket, return_counts=True)
    row, bucket = key // buckets, key % buckets
    x = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, x * x, minlength=rows))
    x = x / norm[row] if len(row) else x

    def total(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offs[1:]] - sums[offs[:-1]]).astype(float)
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"\n", b"!")):
        kind[list(chars)] = k + 1
    code = kind[data] if len(data) else data
    symbols, capitals, digits, stops, lines, exclaims = (total(code == k + 1) for k in range(6))
    size = np.maximum(np.diff(offs), 1)
    n = np.bincount(words.row, minlength=rows)
    length = total(np.ones(len(data), bool)) / np.maximum(n, 1)
    distinct = np.bincount(row, minlength=rows) / np.maximum(n, 1)
    dense = np.stack([np.log1p(n) / 10, np.minimum(length, 50) / 10, 10 * symbols / size, 2 * capitals / size, 5 * digits / size, 5 * stops / size,
                      5 * lines / size, distinct, 10 * exclaims / size, np.log1p(np.maximum(n_chars, 0)) / 10], axis=1)
    return row, bucket, x, dense


def sparse_rows(buckets: int):
    """Arrow task: label, buckets, weights and statistics of each row, for training."""
    def run(batches):
        for batch in batches:
            chars = np.asarray(batch.column("n_chars"))
            for i, j, data, offs in chunks(batch.column("text")):
                row, bucket, x, dense = features(data, offs, chars[i:j], buckets)
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                wide = pa.array(np.arange(j - i + 1) * dense.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("label").slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(x)), pa.ListArray.from_arrays(wide, pa.array(dense.ravel()))], names=["label", "bucket", "x", "stats"])
    return run


SPARSE = "label int, bucket array<int>, x array<double>, stats array<double>"


def inputs(docs: DataFrame, *more):
    """doc_id, text and n_chars (the table's where it has such a column, a count otherwise) of each row, and the columns of `more`."""
    text = F.col("text").cast("string")
    chars = F.coalesce(F.col("n_chars").cast("long"), F.char_length(text), F.lit(0)) if "n_chars" in docs.columns else F.coalesce(F.char_length(text), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), chars.cast("long").alias("n_chars"), *more)


def labelled(docs: DataFrame, labels: DataFrame, label, per_class: int, buckets: int):
    """Training rows of labelled documents: about `per_class` of each class (a documented bound), with how many rows each
    stands for. `label`: an integer column over the columns of `labels`. Ids with several labels give several rows; null ids and labels are left out."""
    known = labels.select("doc_id", label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    count = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not count:
        return [], {}
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in count.items() for v in (k, min(1.0, per_class / n))]), F.col("label"))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * per_class * len(count))
    rows = inputs(docs).join(known, "doc_id").select("label", "text", "n_chars").mapInArrow(sparse_rows(buckets), SPARSE).collect()
    rows = sorted(((r.label, r.bucket, r.x, r.stats) for r in rows), key=lambda r: (r[0], r[1], r[3]))
    have = {k: sum(r[0] == k for r in rows) for k in count}
    return rows, {k: count[k] / max(have[k], 1) for k in count}
