"""Exact removal of repeated byte strings: a depth-limited radix sort of suffixes.

Every byte position starts a suffix; suffixes are ordered only through their first `length` bytes, by passes whose digits
get finer, and suffixes that a pass leaves alone drop out. Groups that stay equal through the last digit are exactly the
repeated windows.

The first digit of a window of `length` bytes is its pivot: the one of its 64-byte strings with the least hash (the last
of equals). It depends on the window alone, and neighbouring windows share it, so a pass moves one row for each run of
windows with one pivot (about one in 170 bytes) and not one for each suffix. A row has two keys:

- `core`: what all windows of the row's nominal range have in common. No window in a row with a unique core is repeated.
- `hull`: the whole content that the windows cover. All windows of rows with equal hulls are repeated.

Only rows with a core, but not a hull, in common go on to the next pass: first runs of 16 windows, then single windows,
where hull and core are the same. A class of rows with equal hulls goes on as one row with a weight, so the work doesn't grow with the
size of a group. Digests have 128 bits (the pivot 64: it only decides who is compared).
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import BASE, BYTE_CODE, U64, chunks, forget, scramble, stored

GRAM, CELL, PIECE = 64, 16, 1 << 22
KEY = ("d", "h")                                            # a document: its id (0 for null) and a hash of id and text
ROW = "d long, h long, lo int, hi int, pivot int, c1 long, c2 long, h1 long, h2 long, weight long"
RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "removed array<struct<start:long,end:long>>")
TEXTS = "d long, h long, lo int, hi int, pivot int, weight long, body binary"


def _digests(data: bytes, spans) -> np.ndarray:
    """128-bit digests of byte ranges, as two columns of int64."""
    b = hashlib.blake2b
    raw = b"".join(b(data[s:e], digest_size=16).digest() for s, e in spans)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _gram_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h, size, p = BYTE_CODE[data], 1, BASE
    while size < GRAM:
        h = h[:-size] * p + h[size:]
        p, size = U64(int(p) * int(p) % 2 ** 64), 2 * size
    return scramble(h)


def _pivots(data: np.ndarray, offs: np.ndarray, length: int):
    """Runs of windows with one pivot: (row, first window, last window, pivot, hash of the pivot), all from the chunk's start."""
    n = len(data)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)]
    begin, last = offs[:-1], offs[1:] - length
    rows = np.flatnonzero(last >= begin)
    if not len(rows):
        return none
    width, mask = length - GRAM + 1, (1 << 24) - 1
    g = _gram_hash(data)
    at = np.arange(len(g), dtype=U64)
    key = (g & ~U64(mask)) | (U64(mask) - at)
    pad = -len(key) % width
    block = np.concatenate([key, np.full(pad, ~U64(0), U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    m = n - length + 1
    pivot = mask - (np.minimum(ahead[:m], behind[width - 1:width - 1 + m]) & U64(mask)).astype(np.int64)
    cut = np.zeros(m + 1, bool)
    cut[1:m] = pivot[1:] != pivot[:-1]
    cut[begin[rows]] = True
    cut[last[rows] + 1] = True
    valid = np.zeros(m + 1, np.int32)
    np.add.at(valid, begin[rows], 1)
    np.add.at(valid, last[rows] + 1, -1)
    valid = np.cumsum(valid) > 0
    edges = np.flatnonzero(cut)
    keep = valid[edges]
    lo, hi = edges[keep], np.append(edges[1:], m)[keep] - 1
    return np.searchsorted(offs, lo, "right") - 1, lo, hi, pivot[lo], g[pivot[lo]]


def _first_pass(length):
    """Rows of the first pass, one for each run of windows with one pivot."""
    def run(batches):
        for batch in batches:
            for i, _, data, offs in chunks(batch.column("text")):
                # a text beyond PIECE goes in pieces that overlap by length - 1 bytes: no window is lost, runs are only cut
                for at in range(0, max(1, len(data) - length + 1), PIECE):
                    part = data[at:at + PIECE + length - 1]
                    cuts = offs if len(part) == len(data) else np.array([0, len(part)])
                    row, lo, hi, pivot, g = _pivots(part, cuts, length)
                    if not len(lo):
                        continue
                    raw = part.tobytes()
                    hull = _digests(raw, zip(lo.tolist(), (hi + length).tolist()))
                    base = cuts[row] - at
                    pick = pa.array(i + row)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("d").take(pick), batch.column("h").take(pick), pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)), pa.array((pivot - base).astype(np.int32)), pa.array(g.view(np.int64)),
                        pa.array(np.zeros(len(lo), np.int64)), pa.array(hull[:, 0]), pa.array(hull[:, 1]),
                        pa.array(np.ones(len(lo), np.int64))], names=[c.split()[0] for c in ROW.split(", ")])
    return run


def _bodies(length):
    """The bytes of the rows that go on, cut out of their documents."""
    names = [c.split()[0] for c in TEXTS.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.select(["d", "h", "text", "open"]).to_pylist():
                text = (r["text"] or "").encode()
                out += [(r["d"], r["h"], o["lo"], o["hi"], o["pivot"], o["weight"], text[o["lo"]:o["hi"] + length]) for o in r["open"]]
            cols = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _types())], names=names)
    return run


def _types():
    return [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _finer(length, cell):
    """Rows of a finer pass: runs of up to `cell` windows, aligned on their distance before the pivot. `want`, where
    there is such a column, lists the runs to split."""
    def run(batches):
        for batch in batches:
            keys, digests = [], []
            for r in batch.to_pylist():
                body, base, pivot = r["body"], r["lo"], r["pivot"]
                for w in r.get("want") or (r,):
                    lo0, hi, weight = w["lo"], w["hi"], w["weight"]
                    if not base <= lo0 <= hi <= r["hi"]:           # a run of the other piece of a text in pieces
                        continue
                    while hi >= lo0:
                        far = (pivot - hi) // cell                  # distances before the pivot: cell * far and on
                        lo = max(lo0, pivot - cell * far - cell + 1)
                        keys.append((r["d"], r["h"], lo, hi, pivot, weight))
                        core = (pivot - cell * far, pivot - cell * far - cell + 1 + length)
                        digests += [(body, core[0] - base, core[1] - base), (body, lo - base, hi + length - base)]
                        hi = lo - 1
            if not keys:
                continue
            b = hashlib.blake2b
            raw = np.frombuffer(b"".join(b(t[s:e], digest_size=16).digest() for t, s, e in digests), np.int64).reshape(-1, 4)
            d, h, lo, hi, pivot, weight = zip(*keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                pa.array(pivot, pa.int32()), *[pa.array(raw[:, k]) for k in range(4)], pa.array(weight, pa.int64())],
                names=[c.split()[0] for c in ROW.split(", ")])
    return run


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One radix pass: the rows whose windows are all repeated, and one row for each class that the next pass must split.
    A class with a weight over 1 is repeated already and goes on only to be met by others. Keys that rows are joined with are stored first: a join
    of two tables, unlike one with an aggregate, can be split at a hot key."""
    live = _shared(rows)
    classes = live.groupBy("c1", "c2", "h1", "h2").agg(
        F.sum("weight").alias("n"), F.min(F.struct("d", "h", "lo", "hi", "pivot")).alias("rep"))
    classes = stored(classes)
    again = live.where("weight = 1").join(classes.where("n > 1").select("c1", "c2", "h1", "h2"), ["c1", "c2", "h1", "h2"], "left_semi")
    mixed = stored(classes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1").select("c1", "c2"))
    split = classes.join(mixed, ["c1", "c2"], "left_semi").select("rep.*", F.col("n").alias("weight"))
    return again.select(*KEY, "lo", "hi"), split


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose core occurs twice or more; the others drop out. Only cores and counts meet in the aggregation."""
    cores = stored(rows.groupBy("c1", "c2").agg(F.sum("weight").alias("n")).where("n > 1").select("c1", "c2"))
    live = stored(rows.join(cores, ["c1", "c2"], "left_semi"))
    forget(rows, cores)
    return live


def _cut(length):
    """Join the removed ranges of each document, drop their bytes and report."""
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, runs = (text or "").encode(), []
                for s in sorted((x["lo"], x["hi"] + length) for x in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *[e for r in runs for e in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            n, removed, spans, sha, runs = zip(*out) if out else ([], [], [], [], [])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, span)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    return run


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of `docs` (doc_id, text): bytes covered by a string of `length` bytes that also starts anywhere else
    are removed. Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (list of byte ranges of the input).

    Null text is empty; a null doc_id is a document; rows that repeat are documents of their own, so a repeated row of
    `length` bytes or more loses all of them; texts of any length are done, in pieces; other columns are ignored; an empty
    table gives no row. `length` must exceed 80.
    """
    if length < GRAM + CELL:
        raise ValueError(f"length must be {GRAM + CELL} or more")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h")]
    docs = docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, split = _ranked(stored(docs.select("d", "h", "text").mapInArrow(_first_pass(length), ROW)))
    split = split.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "pivot", "weight")).alias("open"))
    bodies = stored(docs.select("d", "h", "text").join(split, list(KEY)).mapInArrow(_bodies(length), TEXTS))
    more, split = _ranked(stored(bodies.mapInArrow(_finer(length, CELL), ROW)))
    want = split.groupBy(*KEY, "pivot").agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("want"))
    last = _shared(stored(bodies.drop("weight").join(want, [*KEY, "pivot"]).mapInArrow(_finer(length, 1), ROW)))
    last = last.where("weight = 1").select(*KEY, "lo", "hi")
    spans = found.unionByName(more).unionByName(last).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans, list(KEY), "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), RESULT)
