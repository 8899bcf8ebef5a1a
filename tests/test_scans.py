"""Two-phase scans: the result must not depend on the chunk size, also when one key holds most rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelflux.operators import scans as S


@pytest.fixture(scope="module")
def skewed(spark):
    g = np.random.default_rng(0)
    n = 3000
    k = np.where(g.random(n) < .7, 0, g.integers(1, 20, n))
    pdf = pd.DataFrame({"k": k, "seq": np.arange(n), "v": g.integers(0, 1000, n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("rows", [1, 17, 500, 10_000])
def test_rank_lag_running(skewed, rows):
    pdf, df = skewed
    d = df.withColumn("c", F.floor(F.col("seq") / rows))
    r = S.ranked(d, ["k"], ["seq"], "c", "rk", "n")
    r = S.lagged(r, ["k"], ["seq"], "c", ["v"], "p_")
    r = S.lagged(r, ["k"], ["seq"], "c", ["v"], "a_", ahead=True)
    r = S.running_many(r, ["k"], ["seq"], "c", [("v", F.sum, "s"), ("v", F.max, "m")])
    got = r.toPandas().sort_values("seq").reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    assert (got.rk == pdf.groupby("k").cumcount()).all()
    assert (got.n == g.transform("size")).all()
    assert got.p_v.fillna(-1).equals(g.shift(1).fillna(-1))
    assert got.a_v.fillna(-1).equals(g.shift(-1).fillna(-1))
    assert (got.s == g.cumsum()).all() and (got.m == g.cummax()).all()


def test_exclusive_sum(skewed):
    pdf, df = skewed
    r = S.running(df.withColumn("c", F.floor(F.col("seq") / 50)), ["k"], ["seq"], "c", "v", F.sum, "s", inclusive=False)
    got = r.toPandas().sort_values("seq").reset_index(drop=True)
    assert (got.s == pdf.groupby("k")["v"].cumsum() - pdf.v).all()


def test_exact_quantiles_of_a_hot_group(spark):
    from voxelflux.operators import stats as St
    g = np.random.default_rng(2)
    k = np.where(g.random(4000) < .8, 0, g.integers(1, 30, 4000))
    v = np.round(np.where(g.random(4000) < .3, 0.0, g.normal(0, 5, 4000)), 2)
    v[::97] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": k, "v": v}))
    qs = [0.0, .025, .1, .5, .9, 1.0]
    got = St.exact_quantiles(df, ["k"], "v", qs).toPandas().set_index("k")
    for key, s in pd.DataFrame({"k": k, "v": v}).dropna().groupby("k").v:
        assert got.loc[key, "n"] == len(s)
        assert np.allclose([got.loc[key, f"q{i}"] for i in range(len(qs))], np.quantile(s, qs))
    m = St.medians(df, ["k"], ["v"]).toPandas().set_index("k").v
    assert np.allclose(m.sort_index(), pd.DataFrame({"k": k, "v": v}).groupby("k").v.median().sort_index())


def test_exact_quantiles_in_one_octave_and_with_infinities(spark):
    """Distinct values in a narrow range are cut into even chunks; infinities are values."""
    from voxelflux.operators import stats as St
    df = spark.range(200_000).select(F.lit(0).alias("k"), (F.lit(1.0) + F.col("id") / 2_500_000).alias("v"))
    r = St.exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 1.0]).first()
    v = 1.0 + np.arange(200_000) / 2_500_000
    assert r.n == 200_000 and np.allclose([r.q0, r.q1, r.q2, r.q3], np.quantile(v, [0, 0.25, 0.5, 1]), rtol=0, atol=1e-12)
    inf = float("inf")
    rows = spark.createDataFrame([(0, x) for x in (inf, -inf, 1.0, inf, None)] + [(1, inf), (2, 1.0), (2, inf), (2, inf)], "k int, v double")
    got = {r.k: (r.q0, r.q1) for r in St.exact_quantiles(rows, ["k"], "v", [0.0, 0.5]).collect()}
    assert got == {0: (-inf, inf), 1: (inf, inf), 2: (1.0, inf)}


def test_poisson_upper_of_any_level(spark):
    from math import exp, lgamma, log
    from voxelflux.operators.trains import poisson_upper
    phis = [0.01, 1.0, 7.5, 80.0, 700.0, 800.0, 2667.0, 1e5]
    got = {r.phi: r.k for r in spark.createDataFrame([(p,) for p in phis], "phi double").select("phi", poisson_upper("phi").alias("k")).collect()}
    for p in phis:
        lo, hi = max(0, int(p - 15 * p ** 0.5 - 40)), int(p + 15 * p ** 0.5 + 60)
        tail, k = 0.0, hi
        while tail <= 1e-3 and k >= lo:
            tail += exp(k * log(p) - p - lgamma(k + 1))
            k -= 1
        assert got[p] == k + 1, p
