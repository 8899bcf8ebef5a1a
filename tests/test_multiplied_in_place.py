"""Schemes share one truth, and grids, delays and candidates multiply where their rows lie, over as many partitions as they need."""
from pyspark.sql import functions as F

from voxelflux.operators import causal as Ca, fits as Ft, shift as S, voxels as V
from voxelflux.sensor import Sensor
from voxelflux.session import dealt

SENSOR = Sensor(12, 10, t0=1000, block=4)
NAMES = ("a", "b", "none")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sets(make):
    true = make([(17 * i, i % 12, i % 10, i % 2) for i in range(90)], t0=1000)
    a = make([(17 * i, (i + i % 3) % 12, i % 10, i % 2) for i in range(90)], t0=1000).withColumn("scheme", F.lit("a"))
    return a.unionByName(a.filter("x < 6").withColumn("scheme", F.lit("b"))), true


def each(true):
    return true.withColumn("scheme", F.explode(F.array(*[F.lit(n) for n in NAMES])))


def test_named_sets_count_like_each_alone(make):
    pred, true = sets(make)
    cells, keys = [(1, 1), (2, 3)], ["rec", "w"]
    got = V.matched_by_name(V.named_pair_counts(pred, NAMES, true, cells, SENSOR, keys), NAMES, keys)
    want = V.match(pred, each(true), cells, SENSOR, ("scheme", *keys))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    got = V.named_window_sums(pred, NAMES, true, SENSOR, keys, phi=2.0, theta=1.0)
    want = V.window_sums(pred, each(true), SENSOR, ("scheme", *keys), phi=2.0, theta=1.0)
    row = lambda df: sorted((r.scheme, r.rec, r.w, *[round(r[c], 9) for c in ("N", "N2", "M", "M20", "H", "Dsnr", "Lsnr")]) for r in df.collect())
    assert row(got) == row(want)


def test_named_sets_are_shuffled_once(make):
    pred, true = sets(make)
    text = plan(V.named_window_sums(pred, NAMES, true, SENSOR, ["rec", "w"]))
    assert text.count("Exchange hashpartitioning") == 1              # the raw rows, by window


def brute(prev, cur, dx, dy, delays, k):
    at = lambda t: min(k - 1, t * k // 1000)
    best = None
    for d in delays:
        n, left = 0, {}
        for r in cur:
            left[r.x, r.y, r.p, at(r.tr)] = left.get((r.x, r.y, r.p, at(r.tr)), 0) + 1
        for r in prev:
            key = (r.x + dx, r.y + dy, r.p, at(r.tr + d)) if 0 <= r.tr + d < 1000 else None
            if left.get(key):
                left[key] -= 1
                n += 1
        if n and (best is None or (n, -abs(d), -d) > best[0]):
            best = (n, -abs(d), -d), d
    return best and best[1]


def test_delays_multiply_at_their_pixel(make):
    ev = make([(23 * i % 1000, i % 4, i % 3, i % 2) for i in range(40)], t0=1000)
    cur = ev.withColumns({"tr": F.col("tr") + 130}).filter("tr < 1000")
    shifts = ev.select("rec", "w").distinct().withColumns({"block": F.lit(0).cast("bigint"), "dx": F.lit(0).cast("bigint"), "dy": F.lit(0).cast("bigint")})
    delays = range(-300, 301, 50)
    df = S.best_delay(ev, cur, shifts, ["rec", "w"], delays, 20, SENSOR)
    assert [r.delta for r in df.collect()] == [brute(ev.collect(), cur.collect(), 0, 0, delays, 20)]
    assert "TakeOrdered" not in plan(df) and plan(df).index("Generate") > plan(df).index("SortMergeJoin")      # delays lie below the join with the pixel's counts
    below = plan(df)[plan(df).index("SortMergeJoin"):]
    assert below[:below.index("Generate")].count("Exchange") == 0    # and are not shuffled in between


def test_steps_name_their_rows(make, monkeypatch):
    seen = []
    for m in (Ca, Ft):
        monkeypatch.setattr(m, "dealt", lambda df, *keys, rows=0: seen.append(rows) or dealt(df, *keys, rows=rows))
    src = make([(30 * i, i % 5, i % 4, i % 2) for i in range(30)], t0=1000).withColumns({"g": F.col("w"), "m": F.lit(1).cast("bigint"), "block": (F.col("x") / 3).cast("bigint")})
    start = src.select("rec", "g", "m", "block").distinct().withColumns(
        {**{c: F.lit(0).cast("bigint") for c in ("dx", "dy", "ia", "ib", "ic", "id")}, "cx": F.lit(2.0), "cy": F.lit(2.0), "hx": F.lit(2.0), "hy": F.lit(2.0),
         "x0": F.lit(0), "x1": F.lit(11), "y0": F.lit(0), "y1": F.lit(9)})
    q = Ft.coordinate_search(src, src, start, ["rec", "g", "m", "block"], ["rec", "g", "m"], Sensor(12, 10, t0=1000))
    assert q.filter("f1 <= 0").count() == 0
    assert seen[:2] == [30 * 29] * 2                                 # 30 pixels, 29 candidates of a map


def test_block_maps_name_their_rows(make, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "dealt", lambda df, *keys, rows=0, most=1 << 19: seen.append(rows) or dealt(df, *keys, rows=rows, most=most))
    ev = make([(30 * i, i % 5, i % 4, i % 2) for i in range(90)], t0=1000)
    key = ev.filter("w = 0").withColumnRenamed("w", "g").withColumn("block", F.lit(0).cast("bigint"))
    maps = Ft.block_maps(key, ev, ev.filter("w = 0").select("rec", "w").distinct(), SENSOR, 3, 2)
    assert maps.count() == 2 and seen == [key.count() * 2 * 25]      # two targets, displacements of a radius of 2 px
