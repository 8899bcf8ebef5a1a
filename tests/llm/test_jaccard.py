"""The near-dedup stage against Jaccard similarities of all pairs."""
import random
import re

import corpus_pipeline as P
from voxelflux.llm.textops import table


def kept_by_hand(rows):
    """Least ids of the groups linked by 5-word Jaccard similarity 0.8 or more, over all pairs."""
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x00\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def test_stage_links_what_jaccard_links(spark, sf):
    rnd = random.Random(8)
    prose = lambda n: ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    frame, rows = prose(60), []
    for k in range(30):                                        # chains of edits: similarities around 0.8
        w = prose(rnd.randint(30, 200)) + (frame if k % 3 == 0 else [])
        for _ in range(6):
            rows.append(" ".join(w))
            for _ in range(rnd.randint(0, 5)):
                w = list(w)
                w[rnd.randrange(len(w))] = "changed"
    rows += [" ".join(frame + prose(rnd.randint(5, 40))) for _ in range(60)]      # one frame around little text of their own
    rows += ["", None, " \n", "one", "ONE", "one two", "two one", "a b c d", "a b c d e", "a b c d e f"]
    rows = list(enumerate(rows))
    want = kept_by_hand(rows)
    got = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_stage_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, sf).collect())
    assert got == kept_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_buckets_of_several_blocks(spark, sf, monkeypatch):
    """Texts around one frame share its shingles as prefixes: their buckets are cut in blocks, across which links are found."""
    monkeypatch.setattr(P.jaccard, "BLOCK", 16)
    monkeypatch.setattr(P.jaccard, "HOT", 0)
    rnd = random.Random(5)
    prose = lambda n: ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    frame, rows = prose(12), []
    for _ in range(120):
        own = prose(rnd.randint(8, 16))
        rows += [" ".join(frame + own), " ".join(frame + own[:-1] + ["changed"])]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(rows)
