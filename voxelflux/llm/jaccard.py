"""Near-duplicates by the Jaccard similarity of word shingles: SimHash candidates (`simhash.links`, Golay-code keys), exact verification, a prefix-filter join
for the pairs that fingerprints lose, components.

SimHash links sets whose fingerprints over the same five-word shingles differ in 3 bits or fewer, in a forest; each of its edges is verified on the sets.
Fingerprints of similar sets may differ in more bits, so the prefix filter finds the rest, without loss.

Shingles of all documents are put in one order, rare ones first. Two sets of similarity 4/5 or more share at least 4/5 of the larger one, so their first
n - ceil(4n/5) + 1 shingles (the prefix) have one in common: joining prefixes finds every such pair, whatever the order is. The order only keeps buckets
small: shingles seen often in some stretch of documents stand last (at most `HOT` of them, the driver's only list), the others go by hash.

Only distinct sets take part. In each bucket all members are first held against one of them, which joins a large group in as many rows as it has members;
then, in blocks, against each other, but only where their components still differ. Pairs whose parity bitmaps differ in more bits than the sets could differ in
shingles go first; the others are verified on the whole sets, recomputed from the texts of the candidates.

A block yields no square of its members: each component gets its nearest pairs there, `WIDTH` at first and more in each round, and a round ends with the merge
of the components that verified pairs join; pairs found unlike aren't asked again. It goes on until no block has a pair left. Similar sets share most of the
shingles of their prefixes that others have too, and so meet in many buckets. Rounds begin with the few buckets of least hash (a min-hash) of each set, where a
pair is met once or twice, and end with all buckets, where few pairs are left.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .simhash import fingerprint, links as near_fingerprints
from .textops import NONSPACE, U64, Words, bitmap, chunks, forget, passes, scramble, stored

SHINGLE, OFTEN, HOT, STRETCH, BLOCK = 5, 32, 1 << 18, 1 << 21, 256
#: Pairs of a component and block in the first round, and how many shingles of a prefix make buckets, step by step (None: all of them).
WIDTH, FRONTS = 16, (2, 12, None)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle (five words; all words of a text with fewer), by row and hash. A text without words has none."""
    w = Words(data, offs, NONSPACE)
    at, g = w.grams(SHINGLE)
    row, out = [w.row[at]], [g]
    size = w.last - w.first
    for n in range(1, SHINGLE):
        at, g = w.grams(n)
        short = size[w.row[at]] == n
        row.append(w.row[at[short]])
        out.append(scramble(g[short] + U64(n)))
    row, g = np.concatenate(row), np.concatenate(out)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def _often(batches):
    """Shingles that occur more than once in a stretch of documents, with their counts there."""
    def counted(parts):
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(g[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["g", "n"])
    parts, size = [], 0
    for batch in batches:
        for _, _, data, offs in chunks(batch.column("text")):
            parts.append(shingles(data, offs)[1])
            size += len(parts[-1])
            if size >= STRETCH:
                yield counted(parts)
                parts, size = [], 0
    if parts:
        yield counted(parts)


def _parity(row, g, n) -> pa.Array:
    """For each set one bit per slot, set where an odd number of shingles falls; a power of two of slots, 512 and n at least."""
    slots = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.append(0, np.cumsum(slots))
    flat = at[row] + (g & (slots[row] - 1).astype(U64)).astype(np.int64)
    bits = np.packbits((np.bincount(flat, minlength=at[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(bits)])


def _possible(batches):
    """Pairs that may have a similarity of 4/5 or more: the sets would differ in a ninth of both sizes at most, and bitmaps differ in no more bits than that."""
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist()):
            size = min(len(x), len(y))
            a, b = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0) for v in (x, y))
            keep.append(9 * int(np.bitwise_count(a ^ b).sum()) <= n)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(hot, wanted=None):
    """h, k (hash of the set), n (its size) of each row, its prefix of shingles, its parity bitmap and its SimHash. With a bitmap `wanted` only rows whose h
    passes it, with all their shingles and without parity and SimHash."""
    whole = wanted is not None

    def run(batches):
        often, rank = hot.value
        for batch in batches:
            if whole:
                batch = batch.filter(pa.array(passes(np.asarray(batch.column("h")).view(U64), wanted.value)))
            for i, j, data, offs in chunks(batch.column("text")):
                row, g = shingles(data, offs)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                n = np.diff(cut)
                k = [xxhash.xxh64_intdigest(g[a:b].tobytes(), 1) for a, b in zip(cut[:-1], cut[1:])]
                bits = pa.nulls(j - i, pa.binary()) if whole else _parity(row, g, n)
                fp = pa.nulls(j - i, pa.int64()) if whole else pa.array(np.array(
                    [fingerprint(data[a:b].tobytes(), SHINGLE) for a, b in zip(offs[:-1], offs[1:])], np.uint64).view(np.int64))
                if not whole:
                    late = np.full(len(g), -1)
                    if len(often) and len(g):
                        at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                        late = np.where(often[at] == g, rank[at], -1)
                    g = g[np.lexsort((g, late, row))]
                    g = g[np.arange(len(g)) - cut[row] <= (n - (4 * n + 4) // 5)[row]]
                    cut = np.append(0, np.cumsum(np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(i, j - i) for c in ("doc_id", "h")], pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(g.view(np.int64))), bits, fp],
                    names=["doc_id", "h", "k", "n", "g", "bits", "fp"])
    return run


def _shared(bits):
    """A row for each prefix shingle of a set that passes the bitmap of those in several sets, with its place among these in an order by hash."""
    def run(batches):
        for batch in batches:
            g = batch.column("g")
            flat = np.asarray(g.flatten())
            at = np.flatnonzero(passes(flat.view(U64), bits.value)) if len(flat) else np.zeros(0, np.int64)
            size = np.asarray(g.value_lengths().fill_null(0)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)[at]
            at = at[np.lexsort((scramble(flat[at].view(U64)), row))]                          # rows stay where they are
            place = pa.array((np.arange(len(at)) - np.searchsorted(row, row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("k", "n")], pa.array(flat[at]), place], names=["k", "n", "g", "place"])
    return run


SET = "doc_id long, h long, k long, n int, g array<long>, bits binary, fp long"


def _similar(batches):
    """Pairs whose sets have a Jaccard similarity of 4/5 or more."""
    for batch in batches:
        keep = []
        x, y = batch.column("x"), batch.column("y")
        for r in range(batch.num_rows):
            a, b = np.asarray(x[r].values), np.asarray(y[r].values)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(5 * both >= 4 * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, hot) -> DataFrame:
    x, y = kinds.select(F.col("k").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("x")), kinds.select(F.col("k").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("y"))
    pairs = stored(pairs).join(x, "a").join(y, "b").select("a", "b", (F.col("nx") + F.col("ny")).alias("n"), "x", "y")
    pairs = stored(pairs.mapInArrow(_possible, "a long, b long"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(kinds.select("k", F.col("h").alias("g")), "k")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))          # few other rows pass it, so few sets are made and shuffled
    sets = stored(docs.mapInArrow(_sets(hot, held), SET).groupBy("k").agg(F.first("g").alias("g")))
    x, y = sets.select(F.col("k").alias("a"), F.col("g").alias("x")), sets.select(F.col("k").alias("b"), F.col("g").alias("y"))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"))


def _far(bits, bits2, a, b):
    """In how many bits bitmaps differ, for each pair (a, b); the larger of two is folded to the size of the smaller."""
    size, size2 = np.array([len(v) for v in bits]), np.array([len(v) for v in bits2])
    least, out = np.minimum(size[a], size2[b]), np.zeros(len(a), np.int64)
    for s in np.unique(least):
        at = np.flatnonzero(least == s)
        x, y = ({r: np.bitwise_xor.reduce(np.frombuffer(v[r], np.uint64).reshape(-1, s // 8), axis=0) for r in np.unique(i[at])} for v, i in ((bits, a), (bits2, b)))
        step = max(1, (1 << 21) // int(s))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            out[part] = np.bitwise_count(np.stack([x[r] for r in a[part]]) ^ np.stack([y[r] for r in b[part]])).sum(axis=1, dtype=np.int64)
    return out


def _nearest(roots, roots2, far, width):
    """Pairs (their numbers) that are among the `width` nearest of a component at either end."""
    at = np.tile(np.arange(len(far)), 2)
    order = np.lexsort((at, far[at], np.concatenate([roots, roots2])))
    root = np.concatenate([roots, roots2])[order]
    first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))[:len(root)]
    rank = np.arange(len(root)) - np.repeat(first, np.diff(np.append(first, len(root))))
    return np.unique(at[order[rank < width]])


def _blocks(batches, width=WIDTH):
    """Pairs of different components, of one member of each of two blocks, that sizes and parities leave possible: first 512 bits of all pairs, then the whole
    bitmaps of those left, since 512 bits tell large sets apart no more. Of these the nearest `width` of each component; so rows grow with the members, not
    with their square. A member may list sets (`no`) that it was found unlike."""
    def side(column, r):
        v = column[r].values
        whole = v.field("bits").to_pylist()
        bits = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, 8), axis=0) for b in whole]
        no = v.field("no").to_pylist() if v.type.get_field_index("no") >= 0 else [None] * len(v)
        return [np.asarray(v.field(c)) for c in ("k", "n", "root")] + [np.array(bits), whole, no]
    for batch in batches:
        for r in range(batch.num_rows):
            (k, n, root, x, bits, no), (k2, n2, root2, y, bits2, no2) = side(batch.column("mine"), r), side(batch.column("theirs"), r)
            far = np.zeros((len(k), len(k2)), np.int64)
            for w in range(8):
                far += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
            m, m2 = n[:, None].astype(np.int64), n2[None, :].astype(np.int64)
            may = (root[:, None] != root2) & (9 * far <= m + m2) & (5 * m >= 4 * m2) & (5 * m2 >= 4 * m)
            for i in (i for i, v in enumerate(no) if v):
                may[i] &= ~np.isin(k2, no[i])
            for i in (i for i, v in enumerate(no2) if v):
                may[:, i] &= ~np.isin(k, no2[i])
            a, b = np.nonzero(may)
            far, both = _far(bits, bits2, a, b), n[a].astype(np.int64) + n2[b]
            ok = np.flatnonzero(9 * far <= both)
            ok = ok[_nearest(root[a[ok]], root2[b[ok]], far[ok] / np.maximum(both[ok], 1), width)]
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[a], k2[b])), pa.array(np.maximum(k[a], k2[b]))], names=["a", "b"])


def _paired(left: DataFrame, kinds: DataFrame, unlike: DataFrame, width: int) -> DataFrame:
    """Possible pairs (a, b) of different components inside the buckets g of `left` (g, c, k, n, root) that `unlike` (a, b) doesn't hold, the nearest `width` of
    each component: a bucket is cut in blocks, and each two blocks meet."""
    no = unlike.groupBy(F.col("a").alias("k")).agg(F.collect_list("b").alias("no"))
    rows = left.join(kinds.select("k", "bits"), "k").join(no, "k", "left").withColumn("m", F.ceil(F.col("c") / BLOCK)).withColumn("x", F.pmod(F.xxhash64("k"), F.col("m")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    member = F.struct("k", "n", "root", "bits", "no")
    at = rows.select("g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("low"), (F.col("x") >= F.col("y")).alias("high"), member.alias("v"))
    both = at.groupBy("g", "i", "j").agg(F.collect_list(F.when(F.col("low"), F.col("v"))).alias("mine"), F.collect_list(F.when(F.col("high"), F.col("v"))).alias("theirs"))
    return both.where("size(mine) > 0 and size(theirs) > 0").select("mine", "theirs").mapInArrow(lambda it: _blocks(it, width), "a long, b long").distinct()


def _joined(met: DataFrame, kinds: DataFrame, docs: DataFrame, hot, named: DataFrame) -> DataFrame:
    """Links (a, b) that connect all that similar pairs of the buckets of `met` (g, place, k, n) connect, with the components `named` (node, root) known before."""
    spark = met.sparkSession
    links = unlike = spark.createDataFrame([], "a long, b long")
    before = lambda end: named.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    moved = spark.createDataFrame([], "old long, new long")                  # components of `named` that have merged since
    met = stored(met.join(named, met.k == named.node, "left").select("g", "place", "k", "n", F.coalesce("root", "k").alias("old")))
    for front in FRONTS:
        asked, width = met if front is None else met.where(F.col("place") < front), WIDTH
        while True:
            left = asked.join(moved, "old", "left").select("g", "place", "k", "n", "old", F.coalesce("new", "old").alias("root"))
            same = left.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("who"))
            same = stored(same.where("lo != hi").groupBy("c", "who").agg(F.min("g").alias("g")))       # buckets of the same members once
            pairs = stored(_paired(left.join(same, "g"), kinds, unlike, width))
            if pairs.isEmpty():
                break
            found = _verified(pairs, docs, kinds, hot)
            links, unlike = links.unionByName(found), unlike.unionByName(stored(pairs.join(found, ["a", "b"], "left_anti")))
            ends = left.select("root", "k").distinct().join(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k").select("root").distinct()
            asked = stored(left.join(ends, "root").select("g", "place", "k", "n", "old"))              # a component without a pair in this round gets none later
            if not found.isEmpty():
                edges = links.join(before("a"), "a", "left").join(before("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
                moved = stored(components(edges).select(F.col("node").alias("old"), F.col("root").alias("new")))
            elif front is not None:
                break
            width *= 8
    return links


def _alike(kinds: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets by SimHash: each set with the least of its fingerprint, and those of linked fingerprints with each other."""
    least = stored(kinds.groupBy("fp").agg(F.min("k").alias("least")))
    same = kinds.join(least, "fp").where("k != least").select(F.col("least").alias("a"), F.col("k").alias("b"))
    near = near_fingerprints(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(
        least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _keyed(docs: DataFrame) -> DataFrame:
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(key.alias("doc_id"), F.xxhash64(key, text).alias("h"), text.alias("text"))


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` (doc_id, text) as (doc_id, h, k), and links (a, b) between distinct sets k of similarity 4/5 or more:
    not all of them, but enough to connect all that they connect."""
    docs = _keyed(docs)
    counts = docs.mapInArrow(_often, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "g").limit(HOT).toPandas()
    often, n = top["g"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(often)
    hot = docs.sparkSession.sparkContext.broadcast((often[order], n[order]))
    rows = stored(docs.mapInArrow(_sets(hot), SET))
    kinds = stored(rows.groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("g").alias("g"), F.min("fp").alias("fp"), F.min("h").alias("h")))
    size = stored(kinds.select("k", "n", F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "n")).alias("star")).where("c > 1"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(size))
    # Rows by shingle, many a set, which the planner sizes as few: a merge join, so that they aren't broadcast.
    met = stored(kinds.mapInArrow(_shared(shared), "k long, n int, g long, place int").hint("merge").join(size, "g"))
    forget(size)
    kinds = kinds.drop("g")
    fits = lambda x, y: (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))
    star = met.where((F.col("k") != F.col("star.k")) & fits("n", "star.n")).select(F.col("star.k").alias("a"), F.col("k").alias("b")).distinct()
    first = _verified(star.unionByName(_alike(kinds.select("k", "fp"))).distinct(), docs, kinds, hot)
    named = stored(components(first))
    second = _joined(met.where(F.col("k") != F.col("star.k")).select("g", "place", "k", "n"), kinds, docs, hot, named)
    return rows.select("doc_id", "h", "k"), first.unionByName(second)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text) that stay, with all their columns: one of each group linked by similarities of 4/5 or more over five-word shingles
    (words between white space or NUL, A-Z in lower case), that with the least doc_id (null after all others; of one id's texts the one with the least
    hash; of rows that repeat any). Texts without words are alike; one of fewer than five words is like those with the same words."""
    rows, links = similar_sets(docs)
    best = rows.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    roots = components(links)
    best = best.join(roots, best.k == roots.node, "left").groupBy(F.coalesce("root", "k").alias("root")).agg(F.min("best").alias("best"))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_h"))
    kept = keyed.join(stored(best.select(F.col("best.h").alias("_h"))), "_h", "left_semi")
    return kept.groupBy("_h").agg(F.any_value("_row").alias("_row")).select("_row.*")               # rows that repeat are combined before they are shuffled
