"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last filled up with zeros). The perfect binary Golay code
gives each 23-bit word the one codeword within 3 bits, and a word's neighbours at 1 bit decode to one codeword or to six.
Two words that differ in one bit at most therefore meet: the codeword of one is among those of the other's neighbours.
Of 3 or fewer errors in all, at most one segment has 2 or more, so in two of the three segments each error count is 0 or 1
(pigeonhole), and every link is found by a pair of codeword indices. An index row holds a fingerprint's own codewords, a
query row those of its neighbours; a word of odd parity in the first segment of a pair flips nothing there, since a
neighbour at 1 bit has even parity and finds it.

Candidates are verified on the whole fingerprint. Only distinct fingerprints take part, and a bucket is cut into blocks by a
hash; a pair of blocks yields a spanning forest of its links and not all pairs, so neither memory nor rows grow with the
square of a group. Components come from `components`.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .textops import stored

SEGMENTS = ((0, 23), (23, 23), (46, 18))                     # lowest bit and width
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
BLOCK = 256


def _remainder(word: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GOLAY << bit - 11), word)
    return word


def _errors() -> np.ndarray:
    """The error of 3 bits or fewer for each of the 2048 remainders (the code is perfect)."""
    bit = [0] + [1 << i for i in range(23)]
    words = np.unique([a | b | c for a in bit for b in bit for c in bit])
    table = np.zeros(2048, np.int64)
    table[_remainder(words)] = words
    return table


ERRORS = _errors()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Number (0 to 4095) of the codeword within 3 bits of each 23-bit word."""
    return (words ^ ERRORS[_remainder(words)]) >> 11


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)


def _near(words: np.ndarray, width: int):
    """Distinct codeword indices of each word and its neighbours at 1 bit: a matrix, and which entries count."""
    flips = np.array([0] + [1 << b for b in range(width)])
    index = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    most = int(new.sum(axis=1).max())
    order = np.argsort(~new, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(index, order, 1), np.take_along_axis(new, order, 1)


def _keys(batches, wide: bool):
    """Rows (key, fp): own codewords of each pair of segments, or (wide) those of the neighbours."""
    for batch in batches:
        column = np.asarray(batch.column("fp"))
        for at in range(0, len(column), 8192):
            fp = column[at:at + 8192].view(np.uint64)
            words = [_segment(fp, k) for k in range(3)]
            own = [codeword_index(w)[:, None] for w in words]
            near = [_near(w, SEGMENTS[k][1]) for k, w in enumerate(words)] if wide else [(o, o >= 0) for o in own]
            for p, (i, j) in enumerate(PAIRS):
                (a, a_ok), (b, b_ok) = near[i], near[j]
                if wide:
                    odd = (np.bitwise_count(words[i]) & 1).astype(bool)
                    a, a_ok = a.copy(), a_ok.copy()
                    a[odd, :1], a_ok[odd, 1:] = own[i][odd], False
                key = (p << 24 | a[:, :, None] << 12 | b[:, None, :])
                ok = a_ok[:, :, None] & b_ok[:, None, :]
                who = np.broadcast_to(fp.view(np.int64)[:, None, None], key.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(who[ok])], names=["key", "fp"])


def _forest(bits: int):
    """For each pair of blocks, edges that connect what its links connect."""
    def run(batches):
        for batch in batches:
            a_out, b_out = [], []
            for left, right in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist()):
                x, y = np.array(left, np.int64), np.array(right, np.int64)
                near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= bits
                linked = near & (x[:, None] != y[None, :])
                todo = linked.any(axis=1)
                while todo.any():
                    root = int(np.argmax(todo))
                    rows, cols, grown = np.zeros(len(x), bool), np.zeros(len(y), bool), True
                    rows[root] = True
                    while grown:
                        new = linked[rows].any(axis=0) & ~cols
                        cols |= new
                        rows |= linked[:, cols].any(axis=1)
                        grown = bool(new.any())
                    members = np.concatenate([x[rows], y[cols]])
                    members = members[members != x[root]]
                    a_out.append(np.full(len(members), x[root]))
                    b_out.append(members)
                    todo &= ~rows
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
    return run


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at `bits` or fewer (at most 3) differing bits; not all such pairs, but enough to connect
    all that such pairs connect. `fps`: one bigint column fp, distinct."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    fps = fps.select("fp")
    index = fps.mapInArrow(lambda it: _keys(it, False), "key long, fp long")
    query = fps.mapInArrow(lambda it: _keys(it, True), "key long, fp long")
    size = index.groupBy("key").agg(F.count(F.lit(1)).alias("ni"), F.min("fp").alias("only"))
    # Keys are many rows a fingerprint, which the planner sizes as one; so each meets its other side in a merge join.
    met = stored(query.hint("merge").join(size, "key").where("ni > 1 or fp != only").select("key", "fp", "ni"))
    asked = met.groupBy("key").agg(F.count(F.lit(1)).alias("nq"))
    block = lambda n: F.pmod(F.xxhash64("fp"), F.ceil(F.col(n) / BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1))
    left = index.hint("merge").join(size.select("key", "ni"), "key").join(asked.hint("merge"), "key").select("key", "fp", block("ni").alias("i"), every("nq").alias("j"), F.lit(True).alias("mine"))
    right = met.hint("merge").join(asked, "key").select("key", "fp", block("nq").alias("j"), every("ni").alias("i"), F.lit(False).alias("mine"))
    pair = left.unionByName(right).groupBy("key", "i", "j").agg(
        F.collect_list(F.when(F.col("mine"), F.col("fp"))).alias("mine"), F.collect_list(F.when(~F.col("mine"), F.col("fp"))).alias("theirs"))
    return pair.where("size(mine) > 0 and size(theirs) > 0").select("mine", "theirs").mapInArrow(_forest(bits), "a long, b long")


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of a text's word shingles (XXH64, seed 42); 0 for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        digests = xxhash.xxh64_digest(b" ".join(words), 42)
    else:
        joined = b" ".join(words)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[s:e], 42) for s, e in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist())])
    packed = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for at in range(0, len(packed), 255):
        count += np.add.reduce(np.unpackbits(packed[at:at + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > len(packed)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): one row per row of `docs`; h is a hash of id and text, fp a signed 64-bit number."""
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(key.alias("doc_id"), F.xxhash64(key, text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, fp long")


def _rooted(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint of `rows`."""
    fps = rows.select("fp").distinct()
    roots = components(links(fps, bits))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable
    over links of `bits` or fewer differing bits).

    Null and empty texts have fingerprint 0 and link like any other; rows that repeat stay rows; a null doc_id gets its
    component's least non-null id (null if none); other columns are ignored; an empty table gives no row.
    """
    docs = stored(fingerprints(docs, shingle))
    rooted = _rooted(docs, bits).join(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    rooted = stored(rooted)
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))        # two tables: a large component's join can be split
    named = rooted.join(named, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each component, that with the least doc_id (null after all others; of one id's
    texts the one with the least hash; of rows that repeat any)."""
    rows = stored(fingerprints(docs, shingle))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    stay = best.join(_rooted(rows, bits), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.h").alias("_h"))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_h"))
    kept = keyed.join(stay, "_h", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy("_h")))
    return kept.where("_n = 1").select("_row.*")
