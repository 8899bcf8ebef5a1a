"""Mixing reaches its targets, also for rare domains."""
import numpy as np
import pytest

from voxelflux.llm import mixing


@pytest.mark.parametrize("shares, soft", [((0.75, 0.13, 0.12), 0), ((0.75, 0.13, 0.12), 0.05), ((0.9, 0.099, 0.001), 0), ((0.9, 0.09, 0.01), 0.002)])
def test_totals_meet_targets(spark, shares, soft):
    rng = np.random.default_rng(4)
    n = 4000
    domain = np.repeat(np.arange(3), (np.array(shares) * n).round().astype(int))
    post = np.eye(3)[domain] * (1 - soft) + soft * rng.dirichlet([1, 1, 1], len(domain))
    tokens = rng.integers(50, 150, len(domain))
    members = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, post)], "tokens long, posterior array<double>").repartition(2).cache()
    targets = {"good": 0.90, "poor": 0.07, "toxic": 0.03} if shares[2] > 0.01 else {"good": 0.95, "poor": 0.0485, "toxic": 0.0015} if shares[2] < 0.01 else {"good": 0.93, "poor": 0.065, "toxic": 0.005}
    pulls, step, share = mixing.matched(members, targets)
    r = mixing.rates(post, pulls, step, 0.01)[0]
    totals = (tokens * r) @ post / tokens.sum()
    goal = np.array(list(targets.values()))
    print("reached", totals, "targets", goal, "steps", len(pulls))
    assert (r >= 0).all() and np.allclose(totals, share, atol=1e-6) and (np.abs(totals / goal - 1) <= 0.01).all()
    pulls, step, _ = mixing.fitted(members, targets)
    old = (tokens * mixing.rates(post, pulls, step, 0.01)[0]) @ post / tokens.sum()
    print("ridge only", old)
