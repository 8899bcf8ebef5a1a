"""Language, quality, secrets, counts and mixing: brute force, identities and held-out accuracy."""
import collections
import hashlib
import random
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflux.llm import factorisation, language, mixing, plans, quality_rules, secrets, token_counts
from voxelflux.llm.textops import ALNUM, NONSPACE, Words, chunks, held_out, shared_folder, table


def test_words_match_python():
    import pyarrow as pa
    texts = ["Ab c\n\nd", None, "", "  ", "x", "é É-1 b", "tail "]
    data, want = [], [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    for i, j, raw, offs in chunks(pa.array(texts), limit=6):
        w = Words(raw, offs, NONSPACE)
        for r in range(j - i):
            data.append([raw[s:e].tobytes().lower() for s, e in zip(w.start[w.first[r]:w.last[r]], w.end[w.first[r]:w.last[r]])])
    assert data == want
    a, b = (Words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), ALNUM) for t in (b"The quick, brown fox", b"xx the QUICK brown"))
    assert (a.grams(3)[1][0] == b.grams(3)[1][1]) and len(set(a.hash.tolist())) == 4


def test_language_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    got = plans.op4_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert not [r for r in got if r.rejected and r.lang == r.lang_pred and r.score > 0.9]


def test_language_edges(edge, empty, texts):
    model = language.fit(edge.withColumn("lang", F.when(F.col("doc_id") == 14, "fr").otherwise(F.col("lang"))))
    got = language.predict(edge, model).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(texts) and all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1, 2, 3, 13, 19))
    assert by[4].lang_pred in ("en", "fr") and by[15].lang_pred != "und"
    kept = language.accepted(edge, model)
    assert kept.columns == edge.columns and {1, 2, 3, 13} & {r.doc_id for r in kept.collect()} == set()
    assert language.predict(empty, model).collect() == [] and language.accepted(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(edge, language.fit(empty)).collect()} == {"und"}


def repeats_by_hand(words):
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)})


def stats_by_hand(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats_by_hand(words)


def test_quality_edges(spark, edge, empty, texts):
    got = quality_rules.cascade(edge).collect()
    want = [(d, *stats_by_hand(t or "")) for d, t in texts]
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(map(str, want))
    by = {r.doc_id: r for r in got}
    assert by[5].kept and by[7].kept and not by[10].kept and not by[19].kept and by[12].base_failed and by[1].base_failed
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality_rules.cascade(empty).collect() == []
    rnd = random.Random(7)
    for size in (2, 30, 7000):
        words = [f"w{rnd.randint(0, size)}" for _ in range(4000)] * (2 if size > 100 else 1)
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        assert quality_rules.repeat_words(number, np.array([number[w] for w in words])) == repeats_by_hand(words)


def test_quality_order_by_rejection_per_cost():
    rejects = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert quality_rules.ordered(np.array([3.0, 1.0, 1.0]), rejects)[0] in (1, 2)
    assert quality_rules.ordered(np.array([1.0, 1.0, 1.0]), rejects) == [0, 2, 1]
    assert sorted(quality_rules.ordered(np.ones(3), np.zeros((0, 3), bool))) == [0, 1, 2]


def base_by_hand(x):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    b = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
    b += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(b))


def test_secrets_match_brute_force(spark, edge, empty, texts):
    rnd = random.Random(8)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc12", "abcdef", "AKIA", "Q7" * 9, "0a1b" * 6, "é", "\n", "ghp_9aZk3QpL0vXy7NmB2cRt8WfE", "some-long-ordinary-name"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(300)] + [(400, "token = abcdef " * 500), (401, "")]
    rows += [(1000 + (d or 0), t) for d, t in texts]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows[:-len(texts)]:
        want = base_by_hand(t)
        assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
        assert not want or set(want.split(",")) <= set(got[d].spans.split(","))
    got = secrets.secrets(edge).collect()
    assert len(got) == len(texts) and secrets.secrets(empty).collect() == []
    assert [(r.n_assign, r.n_access, r.n_hex) for r in got if r.doc_id == 16] == [(1, 1, 1)]
    out = secrets.redacted(edge)
    by = {r.doc_id: r for r in out.collect()}
    assert out.columns == edge.columns and out.count() == len(texts) and by[16].text.count("[SECRET]") == 3 and by[16].n_chars == len(by[16].text)
    assert "0a0a" not in by[16].text and by[5].text == dict(texts)[5] and by[1].text is None
    assert secrets.redacted(empty).count() == 0


def test_markov_ratio(spark):
    rnd = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    samples = [("".join(rnd.choice(chars) for _ in range(32)), True) for _ in range(300)] + [(w, False) for w in ("identifier", "number_of_rows", "get-value", "internationalization", "version2") * 60]
    model = secrets.train(spark.createDataFrame(samples + [(None, True), ("x", False), ("some", None)], "word string, random boolean"))
    held = [(i, "".join(rnd.choice(chars) for _ in range(28)) + "7z") for i in range(40)] + [(100 + i, w) for i, w in enumerate(("identifier_of_number_2_rows", "get-value-of-internationalization-version2"))]
    got = {r.doc_id: len(r.spans) for r in secrets.scan(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and got[100] == got[101] == 0
    flat = secrets.train(spark.createDataFrame([], "word string, random boolean"))
    assert max(map(abs, flat)) == 0


def test_fitted_threshold(spark, sf, empty):
    """Random strings of three alphabets planted in whole documents are found, identifiers in them are not; documents that were no samples."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = secrets.fitted(docs)
    assert known.precision >= 0.98 and known.recall >= 0.98 and -secrets.SPAN < known.threshold < secrets.SPAN
    rnd = random.Random(12)
    alphabets = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/")
    words = [w for r in docs.where("doc_id % 7 = 0").collect() for w in re.findall("[A-Za-z]{4,}", r.text or "")][:4000]
    some = lambda n: [rnd.choice(words).lower() for _ in range(n)]
    planted = [(i, " ".join(some(40)) + " " + "".join(rnd.choice(alphabets[i % 3]) for _ in range(24 + i % 17)) + "x7 " + " ".join(some(40))) for i in range(300)]
    clean = [(1000 + i, " ".join(some(40)) + " " + ("_", "-", "")[i % 3].join([*(w.title() if i % 3 == 2 else w for w in some(4)), str(i)]) + " " + " ".join(some(40)))
             for i in range(300)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(planted + clean, "doc_id long, text string"), known.model, known.threshold)
           .selectExpr("doc_id", "size(spans) as spans").collect()}
    assert sum(got[d] == 1 for d, _ in planted) >= 294 and sum(got[d] > 0 for d, _ in clean) <= 6
    assert secrets.fitted(empty)[1:] == (secrets.FALLBACK, None, None)


def test_quality_costs_are_marginal(spark):
    """A rule that reads reported figures only costs next to nothing beside one that sorts the text; texts that fail the base rules don't count."""
    slow = lambda t: len(sorted(t.raw * 20)) < 0
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(40)] + [(100 + i, "too short") for i in range(40)]
    cost, rejects = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string"), {"figures": quality_rules.too_symbolic, "slow": slow})
    assert rejects.shape == (40, 2) and cost[0] * 20 < cost[1]


def test_factorisation_identity_and_accuracy(spark, sf, edge, empty, labels, no_labels, texts):
    m = factorisation.Machine()
    rnd = np.random.default_rng(1)
    m.w, m.v, idx, x = rnd.normal(size=m.w.shape), rnd.normal(size=m.v.shape), np.array([3, 9, 50, 16390]), rnd.normal(size=4)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.raw(idx, x) - (m.bias + m.w[idx] @ x + pairs)) < 1e-9
    dense = np.zeros((2, len(factorisation.STATS)))
    dense[1, 6] = x[3]
    rows = m.raw_rows(np.array([1, 1, 1]), idx[:3], x[:3], dense)
    assert abs(rows[1] - m.raw(idx, x)) < 1e-9 and abs(rows[0] - m.bias) < 1e-9
    got = plans.op8_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97 and {r.predicted for r in got} == {0, 1}
    for known in (labels, no_labels):
        rows = factorisation.score(edge, factorisation.fit(edge, known)).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert factorisation.score(empty, factorisation.fit(empty, labels)).collect() == []


def test_token_ledger(spark, edge, empty, texts):
    counts = token_counts.counted(edge)
    import base64
    import tiktoken
    with open(token_counts.VOCABULARIES["byte_bpe_50k"], "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    by = collections.Counter()
    for r in counts.where("tokenizer = 'byte_bpe_50k'").collect():
        by[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for d, t in texts:
        want[d] += len(coder.encode_ordinary(t or ""))
    assert by == want and counts.count() == 3 * len(texts) and token_counts.counted(empty).count() == 0
    ledger = token_counts.Ledger(spark, shared_folder(spark))
    assert ledger.totals().collect() == []
    early = token_counts.provisional(counts)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert ledger.commit("one", token_counts.deltas(inserted=early)) and as_set(ledger.totals()) == as_set(token_counts.summed(early))
    assert ledger.commit("two", token_counts.deltas(revised=(early, counts))) and not ledger.commit("two", token_counts.deltas(revised=(early, counts)))
    assert as_set(ledger.totals()) == as_set(token_counts.summed(counts))
    ledger.fold()
    gone = counts.where("doc_id < 8")
    ledger.commit("three", token_counts.deltas(deleted=gone))
    assert as_set(ledger.totals()) == as_set(token_counts.summed(counts.subtract(gone).unionAll(counts.where("doc_id = 11 or doc_id is null").exceptAll(counts.where("doc_id = 11 or doc_id is null").distinct()))))
    ledger.commit("four", token_counts.deltas(deleted=counts.exceptAll(gone)))
    assert ledger.totals().collect() == []
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            ledger.commit(bad, token_counts.deltas(inserted=early))
    with pytest.raises(ValueError):
        token_counts.deltas()


def test_mixing_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    post, tokens = rng.dirichlet([0.5, 0.3, 0.2], 400), rng.integers(0, 500, 400)
    rows = [(i, int(t), p.tolist()) for i, (t, p) in enumerate(zip(tokens, post))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    for targets in ({"good": 0.9, "poor": 0.05, "toxic": 0.01}, {"good": 0.1, "poor": 0.0, "toxic": 0.9}):
        pulls, step, share = mixing.fitted(members, targets, ridge=0.01, steps=300, tolerance=1e-9)
        r = mixing.rates(post, pulls, step, 0.01)[0]
        totals = (tokens * r) @ post / tokens.sum()
        assert np.allclose(totals, share, atol=1e-6) and (r >= 0).all()
        grad = post @ (totals - np.array(list(targets.values()))) + 0.01 * (r - 1)      # optimality: no pull inside, only outward pulls at 0
        assert np.abs(grad[r > 0]).max() < 1e-4 and (grad[r == 0] > -1e-4).all()


def test_mixing_edges(spark, sf, edge, empty, labels, no_labels, texts):
    for known in (labels, no_labels):
        got = mixing.mixed(edge, known).collect()
        assert len(got) == len(texts) and all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got)
    assert mixing.mixed(empty, labels).collect() == []
    got = plans.op5_mixing(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    rows = got.groupBy("quality", "toxic").agg(F.avg("p_good").alias("g"), F.avg("p_toxic").alias("t"), F.avg("rate").alias("r")).collect()
    by = {(r.quality, r.toxic): r for r in rows}
    assert by[1, 0].g > 0.9 and by[1, 1].t > 0.8 and by[1, 0].r > by[1, 1].r


def test_oracles(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in plans.ORACLES.items():
        df = plans.QUERIES[name](spark, sf)
        want = con.execute(sql)
        order = [c[0] for c in want.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(map(str, map(tuple, df.select(*[f"`{c}`" for c in order]).collect()))) == sorted(map(str, want.fetchall()))


def test_held_out_rule(spark):
    import zlib
    df = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id").alias("x"))
    assert all(r.x == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
    assert spark.sql("select cast(null as long) as doc_id").select(held_out("doc_id").alias("x")).first().x is False


def test_token_query_counts_the_whole_table(spark, sf):
    """The totals after deletes and returns are those of all documents, as SQL counts words and bytes."""
    want = duckdb.sql(f"""SELECT source, lang, count(*), CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT), CAST(sum(strlen(coalesce(text, ''))) AS BIGINT)
                          FROM '{sf}/documents.parquet' GROUP BY 1, 2""").fetchall()
    got = plans.op1_token_counts(spark, sf).collect()
    assert sorted(map(str, ((r.source, r.lang, r.n_docs, r.n_tokens, r.n_bytes) for r in got if r.tokenizer == "words"))) == sorted(map(str, want))
    assert {(r.source, r.lang, r.n_docs, r.n_bytes) for r in got} == {(*w[:3], w[4]) for w in want} and len(got) == 3 * len(want)
