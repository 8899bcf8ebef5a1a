"""Benchmark decontamination: seeds of one or two words join passages of documents to benchmark items, and a Smith-Waterman alignment scores each pair.

1. An alignment that scores `threshold` of an item of n words keeps at least (2 threshold - 1) n - 1 of its word pairs, and threshold * n of its words: every break
   between matched runs costs a point. An item's seeds are its pairs, or its words where that count of pairs is under 1. Of the count that must be there, half may
   be left out as the corpus' most frequent ones; of the other seeds the rest of the count is asked for. So no copy is lost, whatever other copies exist.
2. Such an alignment covers (3 - 2 threshold) n words of the document at most, so the seeds asked for lie that close together. A document is read once to count seeds
   and once to find, item by item, where enough seeds lie inside such a window; only the surroundings of these windows are passages.
3. Passages are aligned with their item over words, with gaps, many pairs at a time, and scored against the item's own length.

Items are dealt in blocks of about `BLOCK` words, and one block's words and seeds are broadcast at a time, whatever the benchmark's size; documents are not shuffled.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textops import ALNUM, BITS, U64, Words, bitmap, chunks, passes, stored

BLOCK, AREA = 1 << 21, 1 << 20
MATCH, MISS, GAP = 2, -1, -1


def _items(threshold: float, least_words: int):
    """Words of each item, its seeds in order, and how many of them a copy holds at least; all as hashes."""
    def run(batches):
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                w = Words(data, offs, ALNUM)
                (_, one), (at, two) = w.grams(1), w.grams(2)
                need, seeds = [], []
                for a, b in zip(w.first, w.last):
                    n = int(b - a)
                    pairs = int(np.ceil((2 * threshold - 1) * n - 1 - 1e-9))
                    need.append(pairs if pairs > 0 else max(1, int(np.ceil(threshold * n - 1e-9))))
                    seeds.append(one[:0] if n < least_words else two[np.searchsorted(at, a):np.searchsorted(at, b - 1)] if pairs > 0 else one[a:b])
                cut, g = np.append(0, np.cumsum([len(x) for x in seeds])), np.concatenate(seeds) if seeds else one
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.append(w.first, len(w.hash)), pa.int32()), pa.array(w.hash.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(g.view(np.int64))), pa.array(need, pa.int32())], names=["item_id", "item", "grams", "need"])
    return run


def _passing(w: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the words and word pairs that pass the bitmap, in order."""
    at, g = (np.concatenate(x) for x in zip(w.grams(1), w.grams(2)))
    ok = np.flatnonzero(passes(g, table))
    ok = ok[np.argsort(at[ok], kind="stable")]
    return at[ok], g[ok]


def _counts(bits):
    """Occurrences of the grams that pass the bitmap."""
    def run(batches):
        for batch in batches:
            found = [_passing(Words(data, offs, ALNUM), bits.value)[1] for _, _, data, offs in chunks(batch.column("text"))]
            g, n = np.unique(np.concatenate(found or [np.zeros(0, U64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])
    return run


def align(items: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item and its word sequence the best local alignment score, and the word after its end in the sequence (the first of equals)."""
    n, m = max(map(len, items)), max(map(len, words))
    a, b = np.full((len(items), n), -1, np.int64), np.full((len(items), m), -2, np.int64)     # filling never matches, so it never scores
    known_a, known_b = (np.arange(k) < np.array([len(x) for x in rows])[:, None] for k, rows in ((n, items), (m, words)))
    a[known_a], b[known_b] = np.concatenate(items), np.concatenate(words)
    step = (np.arange(m + 1) * -GAP).astype(np.int32)
    h, best, end = np.zeros((len(items), m + 1), np.int32), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for k in range(n):
        same = (b == a[:, k:k + 1]) & known_a[:, k:k + 1] & known_b
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISS)), h[:, 1:] + np.int32(GAP), out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + step, axis=1) - step            # gaps along the sequence
        at = h.argmax(axis=1)
        top = h[np.arange(len(h)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


class Block:
    """Items of a block: their words, how many seeds each asks for in how long a window, and the items of each seed."""

    def __init__(self, items, seeds, threshold: float):
        self.threshold = threshold
        self.item_id, self.words = [None if x is None or x != x else int(x) for x in items["item_id"]], [np.asarray(x, np.int64) for x in items["item"]]
        number = {int(i): k for k, i in enumerate(items["i"])}
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.span = np.ceil((1 + 2 * max(0.0, 1 - threshold)) * self.size - 1e-9).astype(np.int64)
        item = np.array([number[int(i)] for i in seeds["i"]], np.int64)
        self.ask = np.ones(len(self.words), np.int64)
        self.ask[item] = seeds["ask"].to_numpy(np.int64)
        g = seeds["g"].to_numpy(np.int64).view(U64)
        order = np.argsort(g, kind="stable")
        self.seeds, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.items = item[order]
        self.table = np.zeros(BITS // 32, np.uint32)
        for shift in (0, 32):
            p = (self.seeds >> U64(shift)) & U64(BITS - 1)
            np.bitwise_or.at(self.table, (p >> U64(5)).astype(np.int64), np.uint32(1) << (p & U64(31)).astype(np.uint32))

    def passages(self, w: Words):
        """Item, first word and word after the last of each stretch of a chunk that may hold an alignment, by row and item."""
        at, g = _passing(w, self.table)
        k = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
        hit = self.seeds[k] == g
        at, k = at[hit], k[hit]
        count = self.count[k]
        item = self.items[np.repeat(self.first[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        at = np.repeat(at, count)
        key = w.row[at] * len(self.words) + item
        order = np.lexsort((at, key))
        key, at, item = key[order], at[order], item[order]
        last = np.arange(len(key)) + self.ask[item] - 1
        ok = last < len(key)
        end = np.minimum(last, len(key) - 1)
        ok &= (key[end] == key) & (at[end] - at <= self.span[item])
        key, item, row = key[ok], item[ok], w.row[at[ok]]
        lo, hi = np.maximum(at[end[ok]] + 1 - self.span[item], w.first[row]), np.minimum(at[ok] + 1 + self.span[item], w.last[row])
        if not len(key):
            return key, lo, hi
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lo[1:] > hi[:-1])))
        return item[new], lo[new], hi[np.append(new[1:], len(key)) - 1]

    def scored(self, w: Words):
        """(item, score, first word, word after the last) of each passage that reaches the threshold."""
        item, lo, hi = self.passages(w)
        order, out, i = np.lexsort((self.size[item], hi - lo)), [], 0
        words = w.hash.view(np.int64)
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * (hi[order[j]] - lo[order[j]]) <= AREA:
                j += 1
            k = order[i:j]
            top, end = align([self.words[x] for x in item[k]], [words[a:b] for a, b in zip(lo[k], hi[k])])
            good = np.flatnonzero(top >= self.threshold * MATCH * self.size[item[k]] - 1e-9)
            if len(good):
                k, top, end = k[good], top[good], end[good]
                _, back = align([self.words[x][::-1] for x in item[k]], [words[a:a + e][::-1] for a, e in zip(lo[k], end)])
                out += zip(item[k].tolist(), (top / (MATCH * self.size[item[k]])).tolist(), (lo[k] + end - back).tolist(), (lo[k] + end).tolist())
            i = j
        return out


def _blocks(items: DataFrame, docs: DataFrame, threshold: float, least_words: int) -> list:
    """Broadcast blocks of the items; `docs` (text) tells how frequent seeds are."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    items = stored(items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null").distinct()
                   .mapInArrow(_items(threshold, least_words), "item_id long, item array<long>, grams array<long>, need int"))
    items = items.withColumn("i", F.xxhash64("item_id", "item"))
    grams = items.select("i", "need", F.posexplode("grams").alias("pos", "g"))
    often = docs.select(text.alias("text")).mapInArrow(_counts(spark.sparkContext.broadcast(bitmap(grams))), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    ranked = grams.join(often, "g", "left").withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc_nulls_last("n"), "pos")))
    spare = F.floor(F.col("need") / 2)
    seeds = stored(ranked.where((F.col("k") > spare) & F.col("n").isNotNull()).select("i", "g", (F.col("need") - spare).alias("ask")).distinct())
    blocks = -(-(items.agg(F.sum(F.size("item"))).first()[0] or 0) // BLOCK)
    mine = lambda df, b: df.where(F.pmod("i", F.lit(blocks)) == b)
    found = [(mine(items, b).select("i", "item_id", "item").dropDuplicates(["i"]).toPandas(), mine(seeds, b).toPandas()) for b in range(blocks)]
    return [spark.sparkContext.broadcast(Block(x, y, threshold)) for x, y in found if len(y)]


FOUND = "doc_id long, h long, item_id long, score double, begin int, finish int"


def _found(block):
    def run(batches):
        b = block.value
        for batch in batches:
            row, rest = [], []
            for i, _, data, offs in chunks(batch.column("text"), 1 << 20):
                w = Words(data, offs, ALNUM)
                for item, score, first, end in b.scored(w):
                    r = w.row[first]
                    row.append(i + r)
                    rest.append((b.item_id[item], score, int(w.start[first] - offs[r]), int(w.end[end - 1] - offs[r])))
            ids, score, begin, finish = zip(*rest) if rest else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "h")], pa.array(ids, pa.int64()), pa.array(score, pa.float64()),
                                              pa.array(begin, pa.int32()), pa.array(finish, pa.int32())], names=[c.split()[0] for c in FOUND.split(", ")])
    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_words: int = 1) -> DataFrame:
    """One row per pair of a document of `docs` (doc_id, text) and an item of `items` (item_id, text) that it holds: doc_id, item_id, score (best alignment score
    over that of the item with itself, at least `threshold`), begin_byte and end_byte of the best passage (the first of equals),
    and h, a hash of id and text (texts with one doc_id are documents of their own).

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Null and empty texts match nothing, as do items without words, or with fewer than
    `least_words`; rows that repeat give one row; a null doc_id or item_id stays null and is one document or item; other columns are ignored; empty tables give no row.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(key.alias("doc_id"), F.xxhash64(key, text).alias("h"), text.alias("text"))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in _blocks(items, docs, threshold, least_words):
        found = found.unionAll(rows.mapInArrow(_found(block), FOUND))
    best = found.groupBy("doc_id", "h", "item_id").agg(F.min(F.struct(-F.col("score"), "begin", "finish")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col1")).alias("score"), F.col("b.begin").alias("begin_byte"), F.col("b.finish").alias("end_byte"), "h")


def _clean(block):
    def run(batches):
        b = block.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, data, offs in chunks(batch.column("text"), 1 << 20):
                w = Words(data, offs, ALNUM)
                keep[[i + w.row[first] for _, _, first, _ in b.scored(w)]] = False
            yield batch.filter(pa.array(keep))
    return run


def without_items(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_words: int = 1) -> DataFrame:
    """The rows of `docs` that hold no item of `items`, with all their columns (as `contaminated`, null and empty texts and empty tables included). Rows pass one scan for each
    block of items and are neither joined nor shuffled."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    for block in _blocks(items, docs, threshold, least_words):
        rows = rows.mapInArrow(_clean(block), rows.schema)
    return rows.select("_row.*")
