"""Steps of the near-dedup stage: SimHash candidates, and pairs of a block that whole parities rule out."""
import numpy as np
import pyarrow as pa

from test_jaccard import kept_by_hand
from voxelflux.llm import jaccard as J

MEMBER = pa.struct([("k", pa.int64()), ("n", pa.int32()), ("root", pa.int64()), ("bits", pa.binary())])


def member(k, g):
    g = np.sort(np.array(g, np.uint64))
    return {"k": k, "n": len(g), "root": k, "bits": J._parity(np.zeros(len(g), np.int64), g, np.array([len(g)]))[0].as_py()}


def test_large_unlike_sets_are_no_candidates():
    rnd = np.random.default_rng(3)
    draw = lambda n: rnd.integers(0, 1 << 63, n, np.int64)                                   # noqa: E731
    one = draw(3000)
    like = np.concatenate([one[:2700], draw(250)])
    sets = [one, like, draw(3000), draw(2900), draw(40)]
    block = [member(k, g) for k, g in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array([block], pa.list_(MEMBER)), pa.array([block], pa.list_(MEMBER))], names=["mine", "theirs"])
    pairs = {(a, b) for out in J._blocks([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert pairs == {(0, 1)}


def test_fingerprints_give_candidates(spark):
    far = 0x7123456789ABCDEF
    rows = [(1, 5), (2, 5), (3, 5 ^ 0b1100), (4, far), (5, far ^ (1 << 40)), (6, 0x0F0F0F0F0F0F0F0F)]
    got = {(r.a, r.b) for r in J._alike(spark.createDataFrame(rows, "k long, fp long")).collect()}
    assert {(1, 2), (1, 3), (4, 5)} <= got and not any(6 in p for p in got)


def near_copies(rnd, n, size=60):
    """Word lists of one text, each with a few words of its own: similarities around 0.8."""
    text = [f"w{i}" for i in range(size)]
    return [" ".join(f"c{c}x{i}" if i in at else w for i, w in enumerate(text)) for c in range(n) for at in [set(rnd.choice(size, rnd.integers(0, 3), False).tolist())]]


def test_blocks_of_near_copies_yield_no_square():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 300, np.int64)
    block = [member(k, np.append(base, rnd.integers(0, 1 << 63, 8, np.int64))) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([block], pa.list_(MEMBER)), pa.array([block], pa.list_(MEMBER))], names=["mine", "theirs"])
    pairs = [(a, b) for out in J._blocks([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    assert {x for p in pairs for x in p} == set(range(200)) and len(pairs) <= 200 * J.WIDTH           # all pairs would be 39,800 rows


def test_rounds_find_what_one_pass_finds(spark, monkeypatch):
    """One pair of a component and round, and no links by fingerprints: unlike pairs are left out in the next round, and others are asked."""
    monkeypatch.setattr(J, "WIDTH", 1)
    monkeypatch.setattr(J, "_alike", lambda kinds: spark.createDataFrame([], "a long, b long"))
    rows = list(enumerate(near_copies(np.random.default_rng(7), 40)))
    got = J.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(rows)
