"""Phrase collocations by prefix-free parsing: words of documents are cut into content-triggered, overlapping chunks, distinct chunks form a dictionary with parse
frequencies, and n-grams are counted inside distinct chunks, weighted by them.

A chunk ends behind a word whose hash (with the word before it) hits a trigger, so equal stretches are cut alike wherever they stand; it also holds the LONGEST - 1 words after its
end, and owns the n-grams that start before it. So each n-gram of up to LONGEST words is counted once. Chunks never cross the pieces between punctuation.

Counting goes by length: an n-gram can reach `least` only if both (n-1)-grams in it do, so those that did are set in a bitmap of fixed size that lets others pass and loses
none. Tasks count what passes before rows are shuffled.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .textops import BYTE_CODE, U64, bitmap, chunks, passes, powers, scramble, stored

LONGEST, TRIGGER = 5, 16
#: Bytes as they are compared, and their kind: 0 in a word, 1 between words, 2 between pieces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
#: Distinct n-grams that a task gathers before it passes them on.
STRETCH = 1 << 20


class Parse:
    """Words of a chunk of texts: start and end byte, row, whether a piece begins, and a 64-bit hash of each. `kind` tells bytes in words, between words and between pieces apart."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray = KIND):
        self.data, kind = LOWER[data], kind[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        self.start, self.end = np.flatnonzero(inside[1:] & (~inside[:-1] | edge)), np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.row = np.searchsorted(offs, self.start, "right") - 1
        n = len(self.start)
        breaks = np.append(0, np.cumsum(kind == 2))[self.start] if n else self.start
        self.first = np.ones(n, bool)
        self.first[1:] = (self.row[1:] != self.row[:-1]) | (breaks[1:] != breaks[:-1])
        self.hash = np.zeros(0, U64)
        if n:
            size = self.end - self.start
            cut = np.cumsum(size) - size
            at = np.arange(size.sum()) - np.repeat(cut, size)
            term = BYTE_CODE[self.data[np.repeat(self.start, size) + at]] * powers(int(size.max()))[at]
            self.hash = scramble(np.add.reduceat(term, cut) + size.astype(U64))

    def text(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The words a[k] .. b[k] - 1 of each k, with one space between them."""
        count = b - a
        word = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size = self.end[word] - self.start[word] + 1
        cut = np.append(0, np.cumsum(size))
        at = np.arange(cut[-1]) - np.repeat(cut[:-1], size)
        source = np.repeat(self.start[word], size) + at
        flat = np.where(at == np.repeat(size - 1, size), 32, self.data[np.minimum(source, len(self.data) - 1)]).astype(np.uint8)
        last = cut[np.cumsum(count)]                                  # the space behind a text's last word goes
        keep = np.ones(len(flat), bool)
        keep[last - 1] = False
        offs = np.append(0, last - np.arange(1, len(a) + 1))
        return pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(flat[keep])]).cast(pa.string())


def _chunks(batches):
    """The chunks of each text: lang, chunk (all its words), own (n-grams that start at the first `own` words belong to it)."""
    for batch in batches:
        for i, _, data, offs in chunks(batch.column("text"), 1 << 19):
            p = Parse(data, offs)
            n = len(p.start)
            if not n:
                continue
            last = np.append(p.first[1:], True)                      # of a piece
            pair = p.hash.copy()
            pair[1:] += np.where(p.first[1:], U64(0), p.hash[:-1] * U64(0x9E3779B97F4A7C15))
            stop = np.flatnonzero(last | (scramble(pair) % U64(TRIGGER) == 0)) + 1
            begin = np.append(0, stop[:-1])
            piece_end = np.flatnonzero(last) + 1
            full = np.minimum(stop + LONGEST - 1, piece_end[np.searchsorted(piece_end, stop)])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(i + p.row[begin])), p.text(begin, full), pa.array((stop - begin).astype(np.int32))], names=["lang", "chunk", "own"])


def _lang_codes(column) -> np.ndarray:
    kinds = column.dictionary_encode()
    code = np.array([xxhash.xxh64_intdigest(k.encode(), 5) for k in kinds.dictionary.to_pylist()], np.uint64)
    return code[kinds.indices.to_numpy(zero_copy_only=False)]


def _counted(size: int, bits):
    """n-grams of `size` words in distinct chunks with the sums of their weights in a stretch: lang, phrase, g (hash of language and words), f."""
    def summed(parts):
        g, weight = (np.concatenate(x) for x in list(zip(*parts))[:2])
        texts = pa.chunked_array([p[2] for p in parts]).combine_chunks()
        langs = pa.chunked_array([p[3] for p in parts]).combine_chunks()
        u, first, inverse = np.unique(g, return_index=True, return_inverse=True)
        f = np.zeros(len(u), np.int64)
        np.add.at(f, inverse, weight)
        pick = pa.array(first)
        return u, f, texts.take(pick), langs.take(pick)

    def out(u, f, texts, langs):
        return pa.RecordBatch.from_arrays([langs, texts, pa.array(u.view(np.int64)), pa.array(f)], names=["lang", "phrase", "g", "f"])

    def run(batches):
        table, held, many = None if bits is None else bits.value, [], 0
        for batch in batches:
            code, own, times = _lang_codes(batch.column("lang")), batch.column("own").to_numpy(), batch.column("times").to_numpy()
            for i, j, data, offs in chunks(batch.column("chunk"), 1 << 19):
                p = Parse(data, offs)
                n = len(p.start) - size + 1
                if n <= 0:
                    continue
                lang = code[i:j]

                def grams(k):
                    m = len(p.start) - k + 1
                    h = lang[p.row[:m]].copy()
                    for d in range(k):
                        h = h * U64(0x9E3779B97F4A7C15) + p.hash[d:d + m]
                    return scramble(h)
                place = np.arange(len(p.start)) - np.searchsorted(p.row, p.row)
                ok = (place[:n] < own[i:j][p.row[:n]]) & (p.row[:n] == p.row[size - 1:])
                if table is not None:
                    part = passes(grams(size - 1), table)
                    ok &= part[:n] & part[1:n + 1]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                g = grams(size)[at]
                u, first, inverse = np.unique(g, return_index=True, return_inverse=True)
                f = np.zeros(len(u), np.int64)
                np.add.at(f, inverse, times[i + p.row[at]])
                a = at[first]
                held.append((u, f, p.text(a, a + size), batch.column("lang").take(pa.array(i + p.row[a]))))
                many += len(u)
                if many >= STRETCH:
                    held = [summed(held)]
                    if len(held[0][0]) >= STRETCH // 2:
                        yield out(*held.pop())
                    many = sum(len(h[0]) for h in held)
        if held:
            yield out(*summed(held))
    return run


def dictionary(docs: DataFrame) -> DataFrame:
    """Distinct chunks of the texts of `docs` (text, lang): lang, chunk, own, times (how often the parse has it). Null languages are `und`."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    found = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_chunks, "lang string, chunk string, own int")
    return found.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("times"))


def counts(parse: DataFrame, least: int) -> DataFrame:
    """n-grams of a stored dictionary that occur `least` times or more in their language: lang, phrase, len, f."""
    tables, bits = [], None
    for size in range(1, LONGEST + 1):
        rows = parse.mapInArrow(_counted(size, bits), "lang string, phrase string, g long, f long")
        rows = stored(rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("g").alias("g")).where(F.col("f") >= least))
        tables.append(rows.select("lang", "phrase", F.lit(size).alias("len"), "f"))
        if size < LONGEST:
            bits = parse.sparkSession.sparkContext.broadcast(bitmap(rows))          # BITS / 8 bytes
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _score(a, n, l, r):
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = (wide(F.col(a)) * wide(F.col(n))).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    bottom = wide(F.col(l)) * wide(F.col(r))
    return F.call_function("div", top.cast("decimal(38,0)"), bottom.cast("decimal(38,0)"))


def phrases(docs: DataFrame, least: int = 100, top: int = 2000, salts: int = 64) -> DataFrame:
    """The `top` phrases of each language of `docs` (text, lang): lang, rank, phrase (words with one space between), a (occurrences), l, r (occurrences of the parts at the
    lowest-scoring cut, the first of equals), n (words of the language), score (floor of 1000 a n / (l r)).

    Words are what stands between spaces and tabs inside pieces between `.,;:!?` and line breaks, with A-Z in lower case; phrases have 2 to 5 words and occur `least` times or more.
    One whose words lie in a longer such phrase that occurs as often is left out. Null and empty texts have no word, a null or missing language is `und`, rows that
    repeat count as often as they stand, texts are read whole, other columns are ignored, and an empty table gives no row. Hashes of 64 bits only join counts of one
    task and pick what to count; sums are by the words themselves.
    """
    parse = stored(dictionary(docs))
    total = parse.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    often = stored(counts(parse, least))
    long = often.where("len > 1").withColumn("w", F.split("phrase", " "))
    inside = long.where("len > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("len") - 1)))
    inside = inside.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("k") + 1)))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("s"), F.col("k")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = stored(long.join(inside, ["lang", "phrase"], "left").where("most is null or most < f").select("lang", "phrase", "w", "len", F.col("f").alias("a")))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = stored(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("len") - F.col("k")).alias("right")))
    side = lambda name, f: often.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = stored(cuts.join(side("left", "l"), ["lang", "left"])).join(side("right", "r"), ["lang", "right"])     # tables on either side: a common word's join can be split
    cuts = cuts.join(F.broadcast(total), "lang") if total.count() <= 4096 else cuts.join(total, "lang")
    best = cuts.withColumn("score", _score("a", "n", "l", "r")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    best = best.select("lang", "phrase", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", "salt").orderBy(*order)                    # the first of each language are among the first of its shares
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB text of the query's rows.
PHRASES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, row, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM e, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, count(*) AS f, len(string_split(phrase, ' ')) AS len FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
x AS (SELECT lang, f, len, string_split(phrase, ' ') AS w FROM f WHERE len > 2),
y AS (SELECT lang, f, len, w, unnest(range(2, len)) AS k FROM x),
z AS (SELECT lang, f, k, w, unnest(range(1, len - k + 2)) AS s FROM y),
i AS (SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(f) AS most FROM z GROUP BY 1, 2),
o AS (SELECT f.lang, f.phrase, f.f AS a, f.len, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN i ON f.lang = i.lang AND f.phrase = i.phrase WHERE f.len > 1 AND (i.most IS NULL OR 100 * i.most < 100 * f.f)),
c AS (SELECT *, unnest(range(1, len)) AS k FROM o),
s AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, c.k, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score FROM c JOIN n ON c.lang = n.lang
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE j = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""
