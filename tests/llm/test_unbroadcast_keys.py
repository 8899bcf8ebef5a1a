"""Tables whose rows multiply before a join look as small as what they came from; none of them may be broadcast, whatever the threshold."""
import random

import pytest

from voxelflux.llm import jaccard as J, simhash as S


def plans(monkeypatch, module):
    """The plans of the tables that `module` writes from here on."""
    seen, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    return seen


def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(63) for _ in range(300)]
    near = [fp ^ (1 << 3) ^ (1 << 40) for fp in fps[:50]]
    seen = plans(monkeypatch, S)
    found = S.links(spark.createDataFrame([(fp,) for fp in fps + near], "fp long").distinct())
    assert {frozenset((r.a, r.b)) for r in found.collect()} == {frozenset(p) for p in zip(fps, near)}
    seen.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(seen) == 2 and not any("Broadcast" in p for p in seen)


def test_shingles_of_sets_are_not_broadcast(spark, monkeypatch):
    class Met(Exception):
        pass

    def until(df, real=J.stored):
        if {"place", "star"} <= set(df.columns):
            raise Met(sorted(r.place for r in df.collect()), df._jdf.queryExecution().executedPlan().toString())
        return real(df)
    monkeypatch.setattr(J, "stored", until)
    rnd = random.Random(8)
    text = [f"w{rnd.randrange(900)}" for _ in range(60)]
    rows = [(k, " ".join([*text, f"own{k}"])) for k in range(3)]
    with pytest.raises(Met) as met:
        J.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    places, plan = met.value.args
    assert places and "MapInArrow" in plan and "Broadcast" not in plan
