"""Runs of short units against brute force."""
import collections
import random
import re

from voxelflux.llm import units


def by_hand(rows, least):
    """(doc_id, unit_no, start, end) of the units to remove; rows are distinct."""
    runs, where, span = collections.defaultdict(list), {}, {}
    for n, (d, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        pieces = [(m.start(), re.findall(r"[^\x20\x09-\x0D]+", m[0].lower()), m) for m in re.finditer(r"[^.!?\n]+", t or "")]
        pieces = [p for p in pieces if p[1]]
        for k, (_, w, m) in enumerate(pieces):
            body = m[0].rstrip(" \t\n\x0b\x0c\r")
            end = m.start() + len(body)
            if len(body) == len(m[0]):
                end += len(re.match(r"[.!?]*", t[end:])[0])
            span[n, k] = (d, k, m.start() + len(m[0]) - len(m[0].lstrip(" \t\n\x0b\x0c\r")), end)
        size = [len(p[1]) for p in pieces]
        pairs = {(i, next(j for j in range(i, len(size)) if sum(size[i:j + 1]) >= least)) for i in range(len(size)) if sum(size[i:]) >= least}
        pairs |= {(next(i for i in range(j, -1, -1) if sum(size[i:j + 1]) >= least), j) for j in range(len(size)) if sum(size[:j + 1]) >= least}
        for i, j in sorted(pairs):
            runs[" ".join(w for p in pieces[i:j + 1] for w in p[1])].append((n, i, j))
    kept, gone = set(), set()
    for places in runs.values():
        if len(places) > 1:
            for q, (n, i, j) in enumerate(places):
                (gone if q else kept).update((n, k) for k in range(i, j + 1))
    return {span[x] for x in gone - kept}


def test_runs_match_brute_force(spark):
    rnd = random.Random(12)
    bits = ["one", "Two", "three", "é", "x\x00y", "long-word"]
    sentence = lambda: " ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6))) + rnd.choice([".", "!", "?!", "\n", ". ", " . ", "\n\n", ""])
    passages = ["".join(sentence() for _ in range(rnd.randint(2, 6))) for _ in range(12)]
    rows = [(i, rnd.choice(["", "  ", "Ünder "]) + "".join(rnd.choice([rnd.choice(passages), sentence()]) for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    rows += [(100, None), (None, passages[0] + passages[1]), (101, " . ! \n"), (102, "same words here. " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (1, 5, 9):
        got = units.repeated_runs(df, least)
        assert {tuple(r)[:4] for r in got.collect()} == by_hand(rows, least)
    got = units.repeated_runs(df, 5)
    gone, text = collections.defaultdict(list), dict(rows)
    for r in got.collect():
        gone[r.doc_id].append((r.start, r.end))
    for r in units.without_units(df, got, breaks=0).collect():
        want = text[r.doc_id]
        for s, e in sorted(gone[r.doc_id], reverse=True):
            want = want[:s] + want[e:]
        assert r.text == want


def test_runs_edges(edge, empty):
    got = units.repeated_runs(edge, 10).collect()
    assert {(8, 7), (10, 7), (11, 7), (12, 12)} <= {(r.doc_id, r.keep_doc_id) for r in got} and all(r.doc_id not in (1, 2, 3, 4, 5, None) for r in got)
    assert units.repeated_runs(empty).collect() == []
