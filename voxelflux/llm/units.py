"""Line or paragraph deduplication: units are normalised and hashed, digests are grouped over all documents, the earliest
ranked occurrence stays and the others are removed at their original offsets.

`repeated_units` takes whole lines or paragraphs. `repeated_runs` takes lines cut at ends of sentences, and hashes runs of neighbours of `min_words` words, so that short lines and
passages inside long lines are found too."""
import hashlib

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, functions as F

from .collocations import Parse
from .textops import U64, bitmap, chunks, passes, powers, scramble, stored

BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r\x0b\f]*\n\\s*")}
UNIT = "doc_id long, d long, h long, unit_no int, start int, end int, h1 long, h2 long"


def split_units(text: str, unit: str):
    """(start, end) of each unit in characters, breaks left out."""
    at = 0
    for m in BREAKS[unit].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _units(unit: str, min_words: int):
    """Units of each document with 128-bit digests of their words (A-Z in lower case, one space between words)."""
    def run(batches):
        b = hashlib.blake2b
        for batch in batches:
            row, no, start, end, digest = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, (s, e) in enumerate(split_units(text or "", unit)):
                    words = text[s:e].encode().lower().split() if text else ()
                    if len(words) >= min_words:
                        row.append(i)
                        no.append(k)
                        start.append(s)
                        end.append(e)
                        digest.append(b(b" ".join(words), digest_size=16).digest())
            pick, raw = pa.array(row, pa.int64()), np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in ("doc_id", "d", "h")], pa.array(no, pa.int32()), pa.array(start, pa.int32()),
                                              pa.array(end, pa.int32()), pa.array(raw[:, 0]), pa.array(raw[:, 1])], names=[c.split()[0] for c in UNIT.split(", ")])
    return run


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 15) -> DataFrame:
    """One row per unit of `docs` (doc_id, text) to remove: doc_id, unit_no, start, end (characters of the original text, end exclusive),
    keep_doc_id and keep_unit_no (the earliest occurrence by doc_id, then unit), copies (occurrences in all).

    Units of fewer than `min_words` (1 at least) words stay. Null text has no unit; a null doc_id ranks first; rows with one doc_id and one text are
    one document and don't repeat each other; other columns are ignored; an empty table gives no row. A digest with many copies is counted before it is
    shuffled, and its rows meet the kept one in a join that can be split.
    """
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    docs = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(-2 ** 63)).alias("d"), F.xxhash64(key, text).alias("h"), text.alias("text"))
    units = stored(docs.mapInArrow(_units(unit, max(1, min_words)), UNIT))
    seen = units.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "h", "unit_no", "doc_id")).alias("keep")).where("copies > 1")
    seen = stored(seen)                                          # a join of two tables, unlike one with an aggregate, can be split at a hot key
    out = units.join(seen, ["h1", "h2"]).where("d != keep.d or h != keep.h or unit_no != keep.unit_no")
    return out.select("doc_id", "unit_no", "start", "end", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.unit_no").alias("keep_unit_no"), "copies", "h")


def without_units(docs: DataFrame, removed: DataFrame, breaks: int = 1) -> DataFrame:
    """`docs` with the units of `removed` (from `repeated_units`, or with `breaks` 0 from `repeated_runs`) cut out of text, and `breaks` characters behind each. All rows and columns stay."""
    spans = removed.distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_h"))
    rows = rows.join(spans, rows._id.eqNullSafe(spans.doc_id) & (rows._h == spans.h), "left").select("_row", "_spans")
    text, edges = F.col("_row.text"), F.concat(F.array(F.lit(0)), F.flatten(F.transform("_spans", lambda s: F.array(s["start"], s["end"] + breaks))))
    kept = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda i: F.substr(text, edges[2 * i] + 1, F.greatest(F.coalesce(F.get(edges, 2 * i + 1), F.char_length(text)) - edges[2 * i], F.lit(0))))
    text = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(kept, ""))
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


#: Kinds of bytes: 0 in a word, 1 between words, 2 between units.
SENTENCE = np.zeros(256, np.uint8)
SENTENCE[list(b" \t\x0b\x0c\r")] = 1
SENTENCE[list(b".!?\n")] = 2
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: The inverse of powers' base modulo 2**64.
INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: Stands for a null doc_id while rows are ordered.
NO_ID = -2 ** 63
RUN = "d long, h long, first array<int>, size array<int>, digest array<string>, unit array<int>, begin array<int>, finish array<int>"


class Runs:
    """Runs of neighbouring units of a chunk: from each unit on, and up to each unit, the shortest one of `least` words or more. Units are pieces between line breaks and ends of
    sentences that hold a word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, least: int):
        p = self.parse = Parse(data, offs, SENTENCE)
        a = self.a = np.flatnonzero(p.first)                      # first word of each unit, and the word after its last
        b = self.b = np.append(a[1:], len(p.start))
        row = self.row = p.row[a]
        n, unit = len(a), np.arange(len(a))
        self.head = np.searchsorted(row, row)                     # first unit of the row
        on = np.searchsorted(b, a + least)
        ok = on < n
        ok[ok] = row[on[ok]] == row[ok]
        back = np.searchsorted(a, b - least, "right") - 1
        good = back >= self.head
        pair = np.unique(np.concatenate([unit[ok] * n + on[ok], back[good] * n + unit[good]])) if n else unit
        self.first, self.last = pair // max(n, 1), pair % max(n, 1)

    def hashes(self) -> np.ndarray:
        """A hash of each run's words."""
        p = self.parse
        m = len(p.hash)
        sums = np.append(U64(0), np.add.accumulate(p.hash * powers(m)[:m])) if m else np.zeros(1, U64)
        inverse = np.full(max(m, 1), INVERSE)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        a, b = self.a[self.first], self.b[self.last]
        return scramble((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64)) if len(a) else np.zeros(0, U64)


def _hashes(least: int):
    """Hashes of the runs of a batch and how often they occur there."""
    def run(batches):
        for batch in batches:
            found = [Runs(data, offs, least).hashes() for _, _, data, offs in chunks(batch.column("text"), 1 << 20)]
            g, n = np.unique(np.concatenate(found or [np.zeros(0, U64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])
    return run


def _runs(bits, least: int):
    """For each document its runs whose hash passes the bitmap (first unit, number of units, words), and its units in such runs with their characters."""
    def run(batches):
        for batch in batches:
            for i, _, data, offs in chunks(batch.column("text"), 1 << 20):
                r = Runs(data, offs, least)
                pick = np.flatnonzero(passes(r.hashes(), bits.value))
                if not len(pick):
                    continue
                p, first, last = r.parse, r.first[pick], r.last[pick]
                char = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                stop = np.append(STOP[data], False)
                stops = np.append(np.flatnonzero(~stop), len(data))
                end = stops[np.searchsorted(stops, p.end[r.b - 1])]                        # the marks that end a sentence go with it
                end = np.minimum(end, offs[r.row + 1])
                begin, finish = (char[x] - char[offs[r.row]] for x in (p.start[r.a], end))
                size, n = last - first + 1, len(r.a)
                depth = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))
                unit = np.flatnonzero(depth[:n] > 0)
                rows = np.unique(r.row[first])
                lists = lambda own, x: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(own, rows), len(own)), pa.int32()), x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)))
                own, has = r.row[first], r.row[unit]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(i + rows)) for c in ("d", "h")], lists(own, first - r.head[first]), lists(own, size), lists(own, p.text(r.a[first], r.b[last])),
                                                  lists(has, unit - r.head[unit]), lists(has, begin[unit]), lists(has, finish[unit])], names=[c.split()[0] for c in RUN.split(", ")])
    return run


def repeated_runs(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """One row per unit of `docs` (doc_id, text) to remove: doc_id, unit_no, start, end (characters of the original text, end exclusive, marks that end a sentence included),
    keep_doc_id (of the earliest run that it repeats), copies (occurrences of the most frequent such run), and h, a hash of id and text.

    Units are pieces between line breaks and `.`, `!` or `?` that hold a word; words are compared with A-Z in lower case, whatever stands between them. A run is the shortest one of neighbours from a unit on, or up
    to one, of `min_words` words or more. Runs of equal words repeat each other; a unit goes if it is in such a run that isn't the earliest (by doc_id, then unit) and in none that is. Passages of
    fewer words stay, as do parts of units. Null text has no unit; a null doc_id ranks first; rows with one doc_id and one text are one document and don't repeat each other; other
    columns are ignored; an empty table gives no row. Only runs whose hash is found twice are shuffled.
    """
    text, key, least = F.col("text").cast("string"), F.col("doc_id").cast("long"), max(1, min_words)
    docs = docs.select(F.coalesce(key, F.lit(NO_ID)).alias("d"), F.xxhash64(key, text).alias("h"), text.alias("text"))
    twice = docs.select("text").mapInArrow(_hashes(least), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(stored(twice)))
    found = stored(docs.mapInArrow(_runs(bits, least), RUN).withColumn("digest", F.transform("digest", lambda x: F.unhex(F.md5(x)))))
    runs = found.select("d", "h", F.explode(F.arrays_zip("first", "size", "digest")).alias("x")).select("d", "h", "x.first", "x.size", "x.digest")
    place = F.struct("d", "h", "first")
    seen = stored(runs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("keep"), F.max(place).alias("late")).where("keep != late").drop("late"))
    met = runs.join(seen, "digest").select("d", "h", "first", "size", (place == F.col("keep")).alias("kept"), F.col("keep.d").alias("keep"), "copies")
    none = lambda kind: F.lit(None).cast(kind)
    units = found.select("d", "h", F.explode(F.arrays_zip("unit", "begin", "finish")).alias("x"))
    units = units.select("d", "h", F.col("x.unit").alias("first"), F.lit(1).alias("size"), none("boolean").alias("kept"), none("long").alias("keep"), none("long").alias("copies"), "x.begin", "x.finish")
    both = units.unionAll(met.withColumns({"begin": none("int"), "finish": none("int")})).repartition("d", "h")       # all that is known of a document meets in one task
    both = both.withColumn("unit_no", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)))
    again = lambda c: F.when(~F.col("kept"), F.col(c))
    units = both.groupBy("d", "h", "unit_no").agg(F.max("kept").alias("kept"), F.min(again("keep")).alias("keep"), F.max(again("copies")).alias("copies"),
                                                  F.max("begin").alias("start"), F.max("finish").alias("end")).where("not kept")
    id_of = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return units.select(id_of("d").alias("doc_id"), "unit_no", "start", "end", id_of("keep").alias("keep_doc_id"), "copies", "h")


#: DuckDB text of the query's rows.
RUNS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^.!?\n]+|[.!?\n]+') AS t FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM d),
o AS (SELECT *, sum(length(tok)) OVER w - length(tok) AS off, lead(tok) OVER w AS next FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
n AS (SELECT *, trim(regexp_replace(translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM o WHERE regexp_matches(tok, '^[^.!?\n]')),
u AS (SELECT r, doc_id, norm, len(string_split(norm, ' ')) AS c, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS k, off + length(regexp_extract(tok, '^[\x20\x09-\x0D]*')) AS "start",
             off + length(tok) - length(regexp_extract(tok, '[\x20\x09-\x0D]*$')) + CASE WHEN regexp_matches(tok, '[\x20\x09-\x0D]$') THEN 0 ELSE length(regexp_extract(coalesce(next, ''), '^[.!?]*')) END AS "end"
      FROM n WHERE norm != ''),
s AS (SELECT *, sum(c) OVER (PARTITION BY r ORDER BY k) AS b, sum(c) OVER (PARTITION BY r ORDER BY k) - c AS a FROM u),
p AS (SELECT x.r, x.k AS i, min(y.k) AS j FROM s x JOIN s y ON x.r = y.r AND y.k BETWEEN x.k AND x.k + 24 AND y.b - x.a >= 25 GROUP BY 1, 2
      UNION SELECT y.r, max(x.k), y.k FROM s x JOIN s y ON x.r = y.r AND y.k BETWEEN x.k AND x.k + 24 AND y.b - x.a >= 25 GROUP BY y.r, y.k),
w AS (SELECT p.r, any_value(doc_id) AS doc_id, i, j, string_agg(norm, ' ' ORDER BY k) AS words FROM p JOIN s ON s.r = p.r AND s.k BETWEEN i AND j GROUP BY p.r, i, j),
g AS (SELECT *, count(*) OVER (PARTITION BY words) AS copies, first_value(doc_id) OVER q AS keep_doc_id, first_value(i) OVER q AS keep_i, row_number() OVER q AS no FROM w WINDOW q AS (PARTITION BY words ORDER BY doc_id, i)),
e AS (SELECT s.r, s.k, max(CASE WHEN no = 1 THEN 1 ELSE 0 END) AS kept, min(CASE WHEN no > 1 THEN keep_doc_id END) AS keep_doc_id, max(CASE WHEN no > 1 THEN copies END) AS copies
      FROM g JOIN s ON s.r = g.r AND s.k BETWEEN i AND j WHERE copies > 1 GROUP BY s.r, s.k)
SELECT s.doc_id, CAST(s.k AS INTEGER) AS unit_no, CAST(s."start" AS INTEGER) AS "start", CAST(s."end" AS INTEGER) AS "end", e.keep_doc_id, e.copies
FROM e JOIN s ON s.r = e.r AND s.k = e.k WHERE e.kept = 0
"""
