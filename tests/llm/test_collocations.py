"""Phrases by prefix-free parsing against brute force."""
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflux.llm import collocations


def by_hand(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i:i + k]] += 1
    found = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    covered = {(k[0], *k[i:j]) for k, v in found.items() for i in range(1, len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) - 1 and v >= found[(k[0], *k[i:j])]}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        if (lang, *w) not in covered:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("trigger", [1, 3, 16])
def test_phrases_match_brute_force(spark, monkeypatch, trigger):
    monkeypatch.setattr(collocations, "TRIGGER", trigger)
    monkeypatch.setattr(collocations, "STRETCH", 64)
    rnd = random.Random(trigger)
    words, glue = ["a", "B", "the", "of", "Ünder", "new", "york", "x\x00y", "city", "1", "é"], [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r", "!?"]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "one fixed phrase of five words " * 30)] * 4 + [("fr", None), (None, ""), ("fr", " \t "), ("es", "go " * 3000), ("de", "new york city"), ("de", "new york city")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("chunk", "own", "times", "g", "f", "n", "len", "w")}).repartition(5)
    for least, top in ((5, 1000), (12, 7)):
        got = {tuple(r) for r in collocations.phrases(df, least, top).collect()}
        assert got == by_hand(rows, least, top)
    assert sum(r.own * r.times for r in collocations.dictionary(df).collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t or "")) for _, t in rows)


def test_phrases_edges(edge, empty, texts):
    got = {tuple(r) for r in collocations.phrases(edge.drop("lang"), 3, 50).collect()}
    assert got == by_hand([(None, t) for _, t in texts], 3, 50) and got
    assert collocations.phrases(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    big = [(10 ** 12, 10 ** 14, 10 ** 12, 10 ** 12), (3 * 10 ** 12 + 1, 7 * 10 ** 14 + 3, 10 ** 13 + 7, 10 ** 13 + 9), (100, 101, 100, 100)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select("a", collocations._score("a", "n", "l", "r").alias("s")).collect()
    assert {r.a: r.s for r in got} == {a: 1000 * a * n // (l * r) for a, n, l, r in big}


def test_equal_stretches_share_chunks():
    rnd = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 5)) for _ in range(400)]
    import pyarrow as pa
    texts = [" ".join(words), "other words first " + " ".join(words) + " and last"]
    got = pa.Table.from_batches(collocations._chunks([pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(texts)], names=["lang", "text"])])).to_pylist()
    n = collections.Counter((r["chunk"], r["own"]) for r in got)
    assert sum(v == 2 for v in n.values()) > 15 and len(n) < len(got) / 2 + 6
