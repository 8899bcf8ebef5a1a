"""Bootstrap intervals against loops that draw every replicate: strata of many runs, ties, gates, empty shares and empty tables."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflux.operators import stats as St

N_BOOT = 70                                     # one whole part of replicates and a shorter one


def drawn(rec, b):
    u = int(hashlib.md5(f"{St.BOOT_SEED}:{rec}:{b}".encode()).hexdigest()[:8], 16)
    return sum(u >= t for t in St.POISSON)


@pytest.fixture(scope="module")
def strata():
    """One stratum of three runs with ties, a small one, one of a single recording that replicates miss, and one of NULL values."""
    rng = np.random.default_rng(5)
    rows = [("big", f"r{i}", float(v), int(n)) for i, (v, n) in enumerate(zip(rng.integers(0, 700, 2600) / 7.0, rng.integers(0, 30, 2600)))]
    rows += [("small", f"r{i}", float(i * i), i) for i in range(5)]
    return rows + [("one", "r3", 2.5, 4), ("none", "r1", None, 0), ("none", "r2", None, 0)]


def frame(spark, strata):
    return spark.createDataFrame(strata, "k string, rec string, v double, n long")


def test_multiplicity_is_poisson(spark):
    m = [r.m for r in spark.range(20000).select(St.multiplicity(1, "id", "id").alias("m")).collect()]
    share = np.bincount(m, minlength=4)[:4] / len(m)
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.012)
    assert abs(np.mean(m) - 1) < 0.03


def test_median(spark, strata):
    got = {r.k: r for r in St.boot_median(frame(spark, strata), ["k"], "v", F.col("k") != "gated", N_BOOT).collect()}
    assert set(got) == {"big", "small", "one"}                       # no value, no median
    for k, r in got.items():
        rows = [(rec, v) for key, rec, v, _ in strata if key == k]
        reps = [np.repeat([v for _, v in rows], [drawn(rec, b) for rec, _ in rows]) for b in range(N_BOOT)]
        means = [np.median(x) for x in reps if len(x)]
        assert r.n_recordings == len(rows) and r["median"] == pytest.approx(np.median([v for _, v in rows]))
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_ratio(spark, strata):
    got = {r.k: r for r in St.boot_ratio(frame(spark, strata), ["k"], "v", "n", N_BOOT).collect()}
    for k, r in got.items():
        rows = [(rec, v or 0.0, n) for key, rec, v, n in strata if key == k]
        assert r.n_recordings == len(rows) and r.n == sum(n for *_, n in rows)
        reps = [(sum(drawn(rec, b) * v for rec, v, _ in rows), sum(drawn(rec, b) * n for rec, _, n in rows)) for b in range(N_BOOT)]
        means = [a / n for a, n in reps if n]
        if means:
            assert r.value == pytest.approx(sum(v for _, v, _ in rows) / r.n)
            assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
        else:
            assert (r.value, r.lo, r.hi) == (None, None, None)


def test_empty(spark, strata):
    empty = frame(spark, strata).limit(0)
    assert St.boot_median(empty, ["k"], "v", n_boot=N_BOOT).count() == 0 and St.boot_ratio(empty, ["k"], "v", "n", N_BOOT).count() == 0
