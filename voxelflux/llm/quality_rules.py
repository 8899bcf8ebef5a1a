"""Quality rules as a short-circuit cascade.

A rule rejects a document or lets it pass; a document is kept if no rule rejects it, so the order changes only the cost. Cost and selectivity of
each rule are measured on a sample, and rules run by rejections per second: next is always the rule that rejects most of
what the ones before it leave, per second of its cost. A rejected document meets no further rule.
"""
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import SPACES

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """A text with the parts that rules share, made when first asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.memo = raw, {}

    def part(self, name):
        if name not in self.memo:
            self.memo[name] = getattr(self, "_" + name)()
        return self.memo[name]

    def _words(self):
        return self.raw.split()                              # splits at the six ASCII white-space characters

    def _lines(self):
        return [x for x in self.raw.split(b"\n") if not x.isspace() and x]

    def _vocabulary(self):
        """Distinct words with their numbers, and the number of each word."""
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.part("words")), np.int64, len(self.part("words")))
        return number, ids

    def _n_words(self):
        return len(self.part("words"))

    def _word_chars(self):
        data = np.frombuffer(self.raw, np.uint8)
        return int(np.count_nonzero((data & 0xC0) != 0x80)) - sum(self.raw.count(c) for c in SPACES)

    def _n_symbols(self):
        return sum(self.raw.count(c) for c in SYMBOLS)

    def _n_dup_lines(self):
        return len(self.part("lines")) - len(set(self.part("lines")))

    def _n_repeat_words(self):
        return repeat_words(*self.part("vocabulary"))


def repeat_words(number, ids: np.ndarray, n: int = 5) -> int:
    """Words in windows of n words that the text has twice or more, the first included."""
    if len(ids) <= n:
        return 0
    base, m = len(number), len(ids) - n + 1
    key = ids[:m]
    for k in range(1, n):                                     # exact numbers of longer and longer windows
        if base ** (k + 1) >= 2 ** 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k:k + m]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    cover[at] += 1
    cover[at + n] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def too_symbolic(t: Text) -> bool:
    """Over one symbol to ten words."""
    return 10 * t.part("n_symbols") > t.part("n_words")


def odd_words(t: Text) -> bool:
    """Mean word under 2 or over 15 characters."""
    return not 2 * t.part("n_words") <= t.part("word_chars") <= 15 * t.part("n_words")


def repeated_lines(t: Text) -> bool:
    """Over 3 in 10 lines repeat an earlier one."""
    return 10 * t.part("n_dup_lines") > 3 * len(t.part("lines"))


def few_letters(t: Text) -> bool:
    """Under 8 in 10 words have a letter."""
    number, ids = t.part("vocabulary")
    lettered = np.fromiter((w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in number), bool, len(number))
    return 10 * int(np.bincount(ids, minlength=len(number))[lettered].sum()) < 8 * t.part("n_words")


def shouted(t: Text) -> bool:
    """Over half of the letters A to Z are capitals."""
    count = np.bincount(np.frombuffer(t.raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    return upper > lower


RULES = {f.__name__: f for f in (too_symbolic, odd_words, repeated_lines, few_letters, shouted)}


def base_failed(stats) -> bool:
    """Under 10 words, or over a fifth of the words in repeated windows; `stats` are the figures of STATS."""
    return stats[0] < 10 or 100 * stats[4] > 20 * stats[0]


def measured(docs: DataFrame, rules: dict = RULES, sample: int = 512):
    """Seconds per document of each rule and its verdicts on a sample of about `sample` rows (at most twice that): (cost, matrix of rejections).

    Only texts that pass the base rules count, as no other meets the rules, and the figures that are reported are made beforehand: a rule's cost is what it
    adds to them."""
    n = docs.count()
    if n:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))

    def run(batches):
        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                whole = Text(raw or b"")
                if base_failed([whole.part(s) for s in STATS]):
                    continue
                took, verdict = [], []
                for f in rules.values():                        # each rule pays for the parts that it needs beyond the figures
                    t = Text(whole.raw)
                    t.memo = dict(whole.memo)
                    at = time.perf_counter()
                    verdict.append(bool(f(t)))
                    took.append(time.perf_counter() - at)
                yield pa.RecordBatch.from_arrays([pa.array([took]), pa.array([verdict])], names=["took", "verdict"])
    rows = docs.limit(2 * sample).mapInArrow(run, "took array<double>, verdict array<boolean>").collect()
    cost = np.array([r.took for r in rows]).reshape(-1, len(rules)).mean(axis=0) if rows else np.ones(len(rules))
    return cost, np.array([r.verdict for r in rows], bool).reshape(-1, len(rules))


def ordered(cost: np.ndarray, rejects: np.ndarray) -> list[int]:
    """Rule numbers by rejections per cost among the rows that the earlier rules leave; at the end, cheap ones first."""
    left, alive, out = list(range(len(cost))), np.ones(len(rejects), bool), []
    while left:
        best = max(left, key=lambda k: (rejects[alive, k].sum() / max(cost[k], 1e-12), -cost[k], -k))
        out.append(best)
        alive &= ~rejects[:, best]
        left.remove(best)
    return out


def cascade(docs: DataFrame, rules: dict = RULES, sample: int = 512) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rules_run (rules evaluated after the base ones).

    The base rules (under 10 words, or over a fifth of the words in repeated 5-word windows) need only the reported figures and come
    first. Null text is empty (and fails); rows that repeat are judged alone; a null doc_id stays null; other columns are ignored; an
    empty table gives no row. Lines count if they hold a word; `rules` are functions of `Text`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [list(rules.values())[k] for k in ordered(*measured(docs, rules, sample))]
    names = ["doc_id", *STATS, "base_failed", "kept", "rules_run"]

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                t = Text(raw or b"")
                stats = [t.part(s) for s in STATS]
                failed = base_failed(stats)
                n, rejected = 0, failed
                while not rejected and n < len(order):
                    rejected = bool(order[n](t))
                    n += 1
                out.append((*stats, failed, not rejected, n))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)
    return docs.mapInArrow(run, "doc_id long, " + "".join(f"{s} long, " for s in STATS) + "base_failed boolean, kept boolean, rules_run int")


#: DuckDB text of the query's rows (the verdict doesn't depend on the order of the rules).
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, d, e) AS n FROM g WHERE e IS NOT NULL),
rep AS (SELECT w.r, count(DISTINCT w.i) AS n FROM w JOIN t ON t.r = w.r AND t.n > 1 AND w.i BETWEEN t.i AND t.i + 4 GROUP BY w.r),
ws AS (SELECT r, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (regexp_matches(word, '\p{L}')) AS lettered FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT doc_id, coalesce(ws.n, 0) AS n_words, coalesce(ws.chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ls.dup, 0) AS n_dup_lines, coalesce(ls.n, 0) AS n_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(ws.lettered, 0) AS lettered,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower
      FROM d LEFT JOIN ws USING (r) LEFT JOIN ls USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
       AND 10 * n_dup_lines <= 3 * n_lines AND 10 * lettered >= 8 * n_words AND upper <= lower AS kept
FROM f
"""
