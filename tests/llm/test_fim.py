"""Fill-in-middle against brute force, and the way back."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from voxelflux.llm import fim


def by_hand(doc_id, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = ("".join(p) for p in (w[:a], w[a:b], w[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(w), "spm" if h[3] % 100 < 20 else "psm", len(pre), len(mid), out


def test_fim_matches_brute_force(spark, edge, empty, texts):
    rnd = random.Random(11)
    bits = ["word", "Another", " ", "\n", "é", "ñandú", "\U0001f600", "7", "<", ">", "<S", "P>", "S>", "\\0", "\x00", "\x7f", "ß", "--", " ", "<M"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(400)] + [(900, "has <P> in it"), (901, "<M>"), (902, "<S>x")]
    got = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("back", fim.restored("output", "form")).collect()
    text = dict(rows)
    assert sorted(tuple(r)[:6] for r in got) == sorted(by_hand(*r) for r in rows)
    assert all(r.back == text[r.doc_id] for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    got = fim.transformed(edge).withColumn("back", fim.restored("output", "form")).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (by_hand(*r) for r in texts)))
    assert sorted(str((r.doc_id, r.back)) for r in got) == sorted(str((d, t or "")) for d, t in texts)
    assert fim.transformed(empty).collect() == []


def test_fim_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words in a row, and more").alias("text"))
    share = {r.form: r["count"] / 4000 for r in fim.transformed(docs).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.02
    assert {r.form for r in fim.transformed(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    assert {r.form for r in fim.transformed(docs, rate=100, spm=100).select("form").distinct().collect()} == {"spm"}
