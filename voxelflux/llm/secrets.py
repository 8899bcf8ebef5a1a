"""Secret scan in DataFrame functions only: three fixed patterns, and a Markov test for random strings.

Offsets of matches come from the text split at the pattern: gaps and matches alternate, so a match starts where the gaps and matches before it end.

The Markov test compares two bigram models of characters, one of random strings and one of ordinary identifiers, by their
log-likelihood ratio. Both are trained from labelled samples by counting bigrams in one aggregation; the model is a fixed-size table
(alphabet squared). Candidates are runs of 20 or more characters with a letter and a digit; one that touches no fixed match is added if its
ratio exceeds a threshold, which is fitted on the candidates among a held-out quarter of the samples.
"""
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .textops import forget, stored

#: Patterns of the three base kinds (a match of 'assign' also needs a value of 6 or more characters).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"          # LEAST characters
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STEP = 64
LEAST, SPAN, FALLBACK = 20, 512, 12.0


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Sums of all elements before each position, by blocks of STEP (a long list costs no square of its length)."""
    def with_sizes(s):
        count = F.size(s)
        blocks = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((count - 1) / STEP).cast("int")))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(s, b * STEP + 1, STEP), F.lit(0), lambda a, x: a + x))

        def with_sums(t):
            before = F.transform(blocks, lambda b: F.when(b == 0, F.lit(0)).otherwise(F.aggregate(F.slice(t, F.lit(1), F.greatest(b, F.lit(1))), F.lit(0), lambda a, x: a + x)))
            return _let(before, lambda p: F.transform(s, lambda x, i: F.element_at(p, F.floor(i / STEP).cast("int") + 1) + F.aggregate(
                F.slice(s, F.floor(i / STEP).cast("int") * STEP + 1, F.greatest(i % STEP, F.lit(1))), F.lit(0), lambda a, y: a + y) * F.when(i % STEP == 0, F.lit(0)).otherwise(F.lit(1))))
        return _let(sums, with_sums)
    return _let(sizes, with_sizes)


def _matches(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern as an ordered list of (start, kind number, end, value); empty where the text has none."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def located(whole):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
        sizes = F.zip_with(gaps, whole, lambda g, m: F.char_length(g) + F.char_length(m))

        def placed(before):
            starts = F.zip_with(before, gaps, lambda b, g: b + F.char_length(g))
            spans = F.zip_with(starts, whole, lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end")))
            rows = F.zip_with(spans, value, lambda s, v: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), v.alias("value")))
            return F.filter(rows, lambda r: F.char_length(r["value"]) >= least)
        return _let(_running(sizes), placed)
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_matches(text: Column) -> Column:
    """All matches of the three fixed kinds, by start and then by kind."""
    return F.array_sort(F.concat(_matches(text, ASSIGN, "assign", 2, 6), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")))


def _bigrams(word: Column) -> Column:
    """Numbers of a word's character pairs; characters outside the alphabet share one number."""
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: code(F.substr(word, i, F.lit(1))) * F.lit(len(ALPHABET) + 1) + code(F.substr(word, i + 1, F.lit(1))))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair, from samples (word string, random boolean).
    Nulls and words under two characters are ignored; without samples of a kind its model is uniform."""
    side = len(ALPHABET) + 1
    pairs = samples.where("random is not null and char_length(word) > 1").select("random", F.explode(_bigrams(F.col("word"))).alias("pair"))
    count = {True: [0.0] * side * side, False: [0.0] * side * side}
    for r in pairs.groupBy("random", "pair").count().collect():          # at most 2 * side ** 2 rows
        count[r["random"]][r["pair"]] += r["count"]
    return [math.log(a / b) for a, b in zip(_conditional(count[True], side), _conditional(count[False], side))]


def _conditional(pairs: list[float], side: int, weight: float = 5.0) -> list[float]:
    """Probability of the second character of each pair after the first; a first character seldom seen leans on how often the second follows any."""
    after = [0.5 + sum(pairs[a * side + b] for a in range(side)) for b in range(side)]
    share = [x / sum(after) for x in after]
    seen = [sum(pairs[a * side:(a + 1) * side]) for a in range(side)]
    return [(pairs[p] + weight * share[p % side]) / (seen[p // side] + weight) for p in range(side * side)]


def _ratio(word: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a word under a model's table."""
    table = F.array(*[F.lit(float(x)) for x in model])
    return F.aggregate(_bigrams(word), F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))


def _mixed(word: Column) -> Column:
    return word.rlike("[0-9]") & word.rlike("[A-Za-z]")


class Fitted(NamedTuple):
    """A model with the threshold of its candidates, and what that reaches on the held-out samples (None where a kind has none)."""
    model: list[float]
    threshold: float
    precision: float | None
    recall: float | None


def fit(samples: DataFrame) -> Fitted:
    """Model from three quarters of the distinct samples (by a hash of the word) and threshold from the candidates in the last quarter.

    The threshold has the least sum of the two error rates over whole numbers from -SPAN to SPAN, the middle one of equals. Nulls are ignored; where either
    kind has no held-out candidate it is FALLBACK."""
    held = F.pmod(F.xxhash64("word"), F.lit(4)) == 0
    model = train(samples.where(~held))
    tried = samples.where(held & F.col("random").isNotNull() & (F.char_length("word") >= LEAST) & _mixed(F.col("word"))).select("word", "random").distinct()
    level = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.floor(_ratio(F.col("word"), model)).cast("int")))
    count = {True: [0] * (2 * SPAN + 1), False: [0] * (2 * SPAN + 1)}
    for r in tried.groupBy("random", level.alias("level")).count().collect():          # at most 2 * (2 * SPAN + 1) rows
        count[r["random"]][r["level"] + SPAN] += r["count"]
    found, wrong = sum(count[True]), sum(count[False])
    if not found or not wrong:
        return Fitted(model, FALLBACK, None, None)
    best, least, missed, taken = [], math.inf, 0, wrong
    for t in range(2 * SPAN + 1):                                   # words of level t or more are taken
        cost = missed / found + taken / wrong
        if cost < least:
            best, least = [], cost
        if cost == least:
            best.append((t, missed, taken))
        missed += count[True][t]
        taken -= count[False][t]
    t, missed, taken = best[len(best) // 2]
    hits = found - missed
    return Fitted(model, float(t - SPAN), hits / (hits + taken) if hits + taken else None, hits / found)


def labelled_words(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """Labelled samples (word, random) from about `sample` documents (by a hash; a documented bound of the training set). Random are the values of fixed
    matches and, so that no alphabet is missing, hex and base64 digests of the ids. Ordinary are words of 8 or more characters outside fixed matches, and
    identifiers made of three words of a text and a number: joined by _ or -, or with capitals."""
    n = docs.count()
    docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1))))
    text = F.col("text")
    found = docs.select(F.explode(base_matches(text)).alias("m")).select(F.col("m.value").alias("word"))
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    drawn = docs.select(F.explode(F.array(F.substr(sha, F.lit(1), F.lit(40)), F.regexp_replace(F.base64(F.unhex(sha)), "=+$", ""))).alias("word"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = docs.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{8,}+"), F.lit(0))).alias("word"))
    words, number = F.col("words"), F.pmod("doc_id", F.lit(1000)).cast("string")
    three = lambda k: F.slice(words, 3 * k + 1, 3)
    made = F.array(F.concat_ws("_", three(0), number), F.concat_ws("-", three(1), number),
                   F.concat(F.array_join(F.transform(three(2), lambda w: F.initcap(w)), ""), number))
    named = docs.select("doc_id", F.regexp_extract_all(rest, F.lit("[A-Za-z]{4,}+"), F.lit(0)).alias("words")).where("doc_id is not null and size(words) >= 9")
    named = named.select(F.explode(made).alias("word"))
    return found.union(drawn).withColumn("random", F.lit(True)).union(plain.union(named).withColumn("random", F.lit(False)))


def fitted(docs: DataFrame, sample: int = 20_000) -> Fitted:
    """`fit` of the labelled words of `docs` (doc_id, text), which are written once."""
    words = stored(labelled_words(docs, sample))
    out = fit(words)
    forget(words)
    return out


def scan(docs: DataFrame, model: list[float], threshold: float = FALLBACK) -> DataFrame:
    """`docs` with two more columns: base (matches of the fixed kinds) and spans (those and the added ones), both lists of
    (start, kind, end, value) by start and then by kind, in code points with the end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("base", base_matches(text))
    docs = docs.withColumn("more", F.filter(_matches(text, RUN, "random"), lambda m: _mixed(m["value"]) & (_ratio(m["value"], model) > threshold)))
    free = F.filter("more", lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return docs.withColumn("spans", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", free)))).drop("more")


def _joined(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(work: DataFrame, docs: DataFrame, threshold: float | None, sample: int) -> DataFrame:
    known = fitted(docs, sample)
    return scan(work, known.model, known.threshold if threshold is None else threshold)


def secrets(docs: DataFrame, threshold: float | None = None, sample: int = 20_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty; rows that repeat are scanned alone; a null doc_id stays null; other columns are ignored; an empty
    table gives no row; matches are never capped. The threshold is the fitted one unless given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _scanned(docs, docs, threshold, sample)
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                      F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, threshold: float | None = None, sample: int = 20_000, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of found spans in text replaced by `mark`, and n_chars (where there is such a column) counted anew for
    changed texts; all rows and columns stay. Null text stays null."""
    names = docs.columns
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    work = _scanned(work, work.select("doc_id", "text"), threshold, sample)
    reach = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice("spans", F.lit(1), F.greatest(i, F.lit(1))), lambda s: s["end"])))
    piece = lambda s, i: _let(reach(i), lambda at: F.when(s["start"] >= at, F.concat(
        F.substr(F.col("text"), at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))
    rest = F.substr(F.col("text"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.char_length("text"))
    new = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    work = work.withColumn("text", F.when(F.size("spans") > 0, new).otherwise(F.col("text")))
    length = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in names else None
    return work.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names])
