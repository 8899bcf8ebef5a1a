"""Substrings, near-duplicates, lines and benchmark passages against brute force."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from voxelflux.llm import components, decontaminate, simhash, substrings, units


def removed_by_hand(texts, length):
    count = collections.Counter()
    raws = [(d, (t or "").encode()) for d, t in texts]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for d, b in raws:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((d, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [80, 130])
def test_repeated_bytes_match_brute_force(spark, length):
    rnd = random.Random(length)
    parts = ["".join(rnd.choice("ab") if k % 2 else rnd.choice("abcdefgh é") for _ in range(rnd.randint(40, 400))) for k in range(12)]
    texts = [(i, "".join(rnd.choice(parts) + str(rnd.randint(0, 3)) * rnd.randint(0, 3) for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    texts += [(70, "ab" * 300), (71, "aab" * 200), (72, "b" * 500), (73, None), (None, texts[5][1]), (74, texts[5][1]), (74, texts[5][1])]
    got = substrings.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string"), length)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == removed_by_hand(texts, length)


def test_repeated_bytes_in_pieces(spark, monkeypatch):
    """A text beyond the piece size is cut in pieces without losing a window."""
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    texts = [(0, body + "x" + body[500:1500]), (1, "y" + body[:2200])]
    monkeypatch.setattr(substrings, "PIECE", 700)
    got = substrings.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string"), 100)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == removed_by_hand(texts, 100)


def test_repeated_bytes_edges(edge, empty, texts):
    got = substrings.repeated_bytes(edge).collect()
    assert len(got) == len(texts) and substrings.repeated_bytes(empty).collect() == []
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].n_bytes == by[2][0].n_removed == 0
    assert all(r.n_removed == r.n_bytes > 400 for k in (7, 8, 11, 17, 18) for r in by[k])
    assert by[6][0].n_removed == by[5][0].n_bytes and by[4][0].n_removed == by[3][0].n_removed == 0
    with pytest.raises(ValueError):
        substrings.repeated_bytes(edge, 10)


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(keys, linked):
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(keys))]


def test_near_duplicates_edges(edge, empty, texts):
    got = simhash.near_duplicates(edge).collect()
    prints = [fingerprint_by_hand(t) for _, t in texts]
    root = groups_by_hand(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min((d for (d, _), q in zip(texts, root) if q == r and d is not None), default=None) for r in root}
    want = [(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(texts, prints, root)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(empty).collect() == []
    stay = simhash.first_of_each(edge)
    assert stay.columns == edge.columns and stay.count() == len(set(root))
    assert simhash.first_of_each(empty).count() == 0


def test_golay_keys_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:40] + [0]:
        for _ in range(12):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    hot = rnd.getrandbits(64)
    fps |= {hot ^ sum(1 << b for b in rnd.sample(range(10, 22), rnd.randint(0, 6))) for _ in range(300)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    for bits in (3,):
        root = groups_by_hand(fps, lambda a, b: (a ^ b).bit_count() <= bits)
        index = {s: i for i, s in enumerate(signed)}
        got = groups_by_hand(list(range(len(fps))), lambda a, b, e={frozenset((index[r.a], index[r.b])) for r in edges}: frozenset((a, b)) in e)
        same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == k) for k in set(g)}
        assert same(got) == same(root)
    assert len(edges) < 40 * len(fps)


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index = simhash.codeword_index(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (50, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 0, 100: 100, 200: 100}
    assert components.components(edges.limit(0)).collect() == []


def test_one_large_component(spark):
    """A star of 100,000 nodes with tails: every node gets the least one."""
    n = 100_000
    star = spark.range(1, n).selectExpr("id a", "77777L b").unionAll(spark.range(1000).selectExpr(f"{n} + id a", f"if(id = 0, 5L, {n} + id - 1) b"))
    got = components.components(star)
    assert got.count() == n - 1 + 1000 and got.where("root != 1").count() == 0


def test_units_match_brute_force(spark, edge, empty):
    rnd = random.Random(4)
    lines = ["  ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(15)]
    texts = [(i, "\n".join(rnd.choice(lines).swapcase() if rnd.random() < 0.3 else rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for i in range(40)] + [(50, None), (None, lines[0])]
    for unit, cut in (("line", "\n"), ("paragraph", "\n\n")):
        rows = [(d, t if t is None or unit == "line" else t.replace("\n", "\n\n")) for d, t in texts]
        first, want = {}, []
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            at = 0
            for k, u in enumerate((t or "").split(cut)):
                words = u.lower().split()
                if len(words) >= 2:
                    key = " ".join(words)
                    if key in first:
                        want.append((d, k, at, at + len(u), *first[key]))
                    first.setdefault(key, (d, k))
                at += len(u) + len(cut)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = units.repeated_units(df, unit, 2)
        assert sorted(map(str, (tuple(r)[:6] for r in got.collect()))) == sorted(map(str, want))
        if unit == "line":
            assert units.repeated_units(units.without_units(df, got), unit, 2).count() == 0
    assert units.repeated_units(empty).count() == 0
    got = {(r.doc_id, r.keep_doc_id) for r in units.repeated_units(edge, min_words=4).collect()}
    assert {(8, 7), (10, 7), (11, 7), (12, 12)} <= got and all(d not in (1, 2, 3, 4, 5, None) for d, _ in got)
    out = units.without_units(edge, units.repeated_units(edge, min_words=4))
    assert out.columns == edge.columns and out.count() == edge.count()


def align_by_hand(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        assert decontaminate.align([np.array(a)], [np.array(b)])[0][0] == align_by_hand(a, b)
    pairs = [[[rnd.randint(0, 4) for _ in range(rnd.randint(1, 25))] for _ in range(2)] for _ in range(40)]
    top, end = decontaminate.align(*[[np.array(p[k]) for p in pairs] for k in (0, 1)])
    assert top.tolist() == [align_by_hand(*p) for p in pairs]
    assert all(align_by_hand(p[0], p[1][:e]) == t for p, t, e in zip(pairs, top.tolist(), end.tolist()))


def test_decontamination(spark, edge, empty):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(20, 60)))) for i in range(12)] + [(90, None), (91, ""), (92, "two words"), (None, " ".join(word() for _ in range(30)))]
    rows = [(100 + i, " ".join(word() for _ in range(150))) for i in range(20)]
    want = set()
    for i, t in items[:12]:
        w = t.split()
        for k, edit in enumerate((lambda w: w, lambda w: [x for j, x in enumerate(w) if j % 9], lambda w: [x if j % 8 else "other" for j, x in enumerate(w)])):
            rows.append((1000 + 10 * i + k, " ".join([word() for _ in range(80)] + edit(w) + [word() for _ in range(80)]).upper()))
            want.add((1000 + 10 * i + k, i))
    rows += [(5000 + k, "common start of all " + items[3][1] + " " + word()) for k in range(200)]                 # a hot item
    want |= {(5000 + k, 3) for k in range(200)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    text, item = dict(rows), dict(items)
    for r in got[:20]:
        span = text[r.doc_id].encode()[r.begin_byte:r.end_byte].decode()
        assert abs(align_by_hand(item[r.item_id].split(), span.lower().split()) / (2 * len(item[r.item_id].split())) - r.score) < 1e-9
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    clean = decontaminate.without_items(edge, bench)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    assert decontaminate.without_items(edge, spark.createDataFrame([(1, "12345 67890 in line one is here line one is here")], "item_id long, text string"), 0.5).count() == edge.count() - 1
