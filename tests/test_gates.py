"""Brute force on small fixtures, closed-form scenes, and streaming against batch."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelflux.functions import cols as C
from voxelflux.operators import boxes as B, causal as Ca, codec as K, codelen as L, fits as Ft, flow as Fl, predictive as P
from voxelflux.operators import regions as Rg, shift as S, trains as Tr, voxels as V
from voxelflux.sensor import Sensor
from voxelflux.sources import ingest as I
from voxelflux.streaming import live as Lv, memory

T0 = 33_333


def bucket(a):
    return next((i for i, e in enumerate((1, 2, 4, 16, 64, 256)) if a < e), 6)


def brute_context(ev, W, H, slot, nbr):
    """Straight loop over the events with the whole state recomputed at each one."""
    S_, TL, LP, out = {}, {}, {}, []
    nev, expo, pc = np.zeros(49), np.zeros(49), {}
    around = lambda u: [(u[0] + i, u[1] + j) for j in (-1, 0, 1) for i in (-1, 0, 1)                # noqa: E731
                        if (i, j) != (0, 0) and 0 <= u[0] + i < W and 0 <= u[1] + j < H]
    for t, x, y, p in ev:
        s, u = t // slot, (x, y)
        bs = {(a, b): bucket(s - S_.get((a, b), -10 ** 9)) for a in range(W) for b in range(H)}
        cl = {q: bs[q] * 7 + (min([6] + [bs[v] for v in around(q)]) if nbr else 0) for q in bs}
        Nc = np.bincount(list(cl.values()), minlength=49)
        r = (nev + .5) / (expo + .5 * W * H)
        a = -math.log2(r[cl[u]] / (Nc * r).sum())
        best, npol = -1, 0
        for v in around(u):
            if TL.get(v, -1) > best:
                best, npol = TL[v], LP[v] + 1
        c = ((LP.get(u, -1) + 1) * 21 + bs[u] * 3 + npol)
        n = pc.setdefault(c, [.5, .5])
        out.append((a, -math.log2(n[p] / sum(n)), cl[u]))
        n[p] += 1
        expo += Nc
        nev[cl[u]] += 1
        S_[u], TL[u], LP[u] = s, t, p
    return out


@pytest.mark.parametrize("nbr", [False, True])
def test_context_code_against_loop(make, nbr):
    g = np.random.default_rng(3)
    t = np.sort(g.integers(0, 3000, 120))
    ev = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(t, g.integers(0, 6, 120), g.integers(0, 5, 120), g.integers(0, 2, 120))]
    df = make(ev).withColumn("t", F.col("t_us"))
    got = L.context_code(df, ["rec"], Sensor(6, 5), C.idiv("t", 10), nbr, chunk_slots=7).orderBy("seq").collect()
    want = brute_context(ev, 6, 5, 10, nbr)
    assert got[0].address_bits == pytest.approx(math.log2(30))
    for r, (a, p, c) in zip(got, want):
        assert (r.address_bits, r.polarity_bits) == pytest.approx((a, p)) and r.cls == c


def drift(n=60, W=64, H=48, v=6, windows=3, seed=1):
    """Points drifting v px per window along x; one event per pixel crossing."""
    g = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x0, y, ph = g.integers(0, W - v * windows - 1), g.integers(0, H), g.random()
        for i in range(v * windows):
            out.append((int((i + ph) * T0 / v), int(x0 + i), int(y), 1))
    return sorted(out)


def test_votes_find_the_drift(make):
    sn = Sensor(64, 48, T0, 16)
    ev = make(drift())
    ks = ev.select("rec").distinct().withColumn("w", F.lit(1).cast("bigint"))
    eg = Ca.clean_groups(ev, ks, 100, 100.0)
    cand = Ca.candidate_blocks(eg, sn, 10)
    m = Ca.fit_motion(eg, cand, sn, 8, "best", (0,), 32).collect()
    assert len(m) >= 5 and sum((r.dx, r.dy) == (6, 0) for r in m) / len(m) > .95


def test_block_maps_and_claims(make):
    sn = Sensor(64, 48, T0, 16)
    ev = make(drift())
    ks = ev.select("rec").distinct().withColumn("w", F.lit(0).cast("bigint"))
    key = ev.filter("w = 0").withColumnRenamed("w", "g").withColumn("block", C.block_id("x", "y", 16, 64))
    maps = Ft.block_maps(key, ev, ks, sn, 3, 14)
    true = Ft.group_targets(ev, ks, 3)
    zero = maps.withColumns({"dx": F.lit(0).cast("bigint"), "dy": F.lit(0).cast("bigint")})
    res = {}
    for name, mp in (("static", zero), ("fit", maps)):
        cl = Rg.block_claims(key, true, mp, sn, [(2, 3)]).groupBy("m").agg(F.sum("got").alias("got")).collect()
        mv = K.reconstruct(key, mp, sn)
        mt = V.match(mv, true, [(2, 3)], sn, ("rec", "m")).collect()
        assert {r.m: r.got for r in cl} == {r.m: r.pairs for r in mt}            # claims add up to the match
        res[name] = sum(r.pairs for r in mt)
    assert res["fit"] > 2 * res["static"]
    # the shape search never loses pairs against the translation it starts from
    cx, cy = C.block_centre("block", 16, 64)
    st = maps.withColumns({"cx": cx, "cy": cy, "hx": F.lit(8.0), "hy": F.lit(8.0), "x0": F.lit(0), "x1": F.lit(63), "y0": F.lit(0), "y1": F.lit(47)})
    src = key.withColumn("m", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    k = ["rec", "g", "m", "block"]
    q0 = {(r.m, r.block): r.f1 for r in Ft.coordinate_search(src, true, st, k, k[:3], sn, rounds=1, offsets=()).collect()}
    q1 = {(r.m, r.block): r.f1 for r in Ft.coordinate_search(src, true, st, k, k[:3], sn, rounds=1).collect()}
    assert all(q1[i] >= q0[i] - 1e-12 for i in q0)


def test_coordinate_search_against_loop(make):
    """One round of candidates of one object, scored by a loop."""
    sn = Sensor(40, 40, T0, 20)
    g = np.random.default_rng(5)
    src = [(int(t), int(x), int(y), int(p)) for t, x, y, p in zip(np.sort(g.integers(0, T0, 80)), g.integers(10, 25, 80), g.integers(8, 30, 80),
                                                                  g.integers(0, 2, 80))]
    tru = [(t, min(39, int(np.rint(x + 2 + (x - 17) / 7.0))), y, p) for t, x, y, p in src]
    k = {"k": 0}
    s, t = make(src, **k), make(tru, **k)
    z = {n: F.lit(0).cast("bigint") for n in K.PARAMS}
    start = s.select("k").distinct().withColumns({**z, "cx": F.lit(17.0), "cy": F.lit(19.0), "hx": F.lit(7.0), "hy": F.lit(11.0), "x0": F.lit(0),
                                                  "x1": F.lit(39), "y0": F.lit(0), "y1": F.lit(39)})
    got = Ft.coordinate_search(s, t, start, ["k"], ["k"], sn, rounds=1).first()

    def vox(pts):
        c = {}
        for tt, x, y, p in pts:
            i = (p, min(2, tt * 3 // T0), y // 2, x // 2)
            c[i] = c.get(i, 0) + 1
        return c

    ct, best = vox(tru), None
    for i, st in enumerate([(0,) * 6] + [tuple(v * o for v in mv) for mv in Ft.MOVES for o in Ft.OFFSETS]):
        mv = [(tt, int(np.rint(x + st[0] + st[2] / 7.0 * (x - 17) + st[3] / 11.0 * (y - 19))),
               int(np.rint(y + st[1] + st[4] / 7.0 * (x - 17) + st[5] / 11.0 * (y - 19))), p) for tt, x, y, p in src]
        mv = [q for q in mv if 0 <= q[1] < 40 and 0 <= q[2] < 40]
        m = sum(min(c, ct.get(v, 0)) for v, c in vox(mv).items())
        f = 2 * m / (len(mv) + len(tru))
        if best is None or f > best[0] + 1e-12:
            best = (f, st)
    assert got.f1 == pytest.approx(best[0]) and tuple(got[n] for n in K.PARAMS) == best[1]


def test_sharpness_velocity_recovers_motion(make):
    g = np.random.default_rng(2)
    pts = [(int(g.integers(0, 60)), int(g.integers(0, 60))) for _ in range(40)]
    ev = [(int(t), int(round(x + 200e-6 * (t - 100_000))), y, 1) for x, y in pts for t in np.arange(0, 100_000, 2500)]
    df = make(sorted(ev), k=0).withColumn("dt", F.col("t_us") - 100_000)
    v = Ft.sharpness_velocity(df, ["k"], df.select("k").distinct().withColumns({"vx": F.lit(150.0), "vy": F.lit(10.0)})).first()
    assert abs(v.vx - 200) < 12 and abs(v.vy) < 12


def test_predictive_cost_against_numpy(spark):
    g = np.random.default_rng(4)
    cell, bands, t2, delta = .5, (.5, 1.0), .03, 1e-6
    tx, ty, tp = g.normal(10, 2, 150), g.normal(8, 2, 150), g.integers(0, 2, 150)
    fx, fy, fp = g.integers(4, 17, 60), g.integers(2, 14, 60), g.integers(0, 2, 60)
    x0, x1, y0, y1, vx = 4, 16, 2, 13, 20.0
    ks = 3
    tk = [(i + .5) * t2 / ks for i in range(ks)]
    ft = g.random(60) * t2
    fu = fx - vx * ft
    mk = lambda u, v, p: spark.createDataFrame(pd.DataFrame({"k": 0, "model": "m", "p": p, "u": u, "v": v}))          # noqa: E731
    smp = spark.createDataFrame(pd.DataFrame({"k": range(ks), "key": 0, "model": "m", "ax": 1.0, "bx": [-vx * t for t in tk], "ay": 1.0, "by": 0.0,
                                              "weight": 1 / ks}))
    rect = spark.createDataFrame([(0, x0, x1, y0, y1)], "key int, x0 int, x1 int, y0 int, y1 int")
    ren = lambda d: d.withColumnRenamed("k", "key")                                                                # noqa: E731
    r = P.predictive_cost(ren(mk(tx, ty, tp)), ren(mk(fu, fy.astype(float), fp)), smp, rect, ["key"], t2, delta, cell, bands).first()
    N = 160
    hist = np.zeros((2, N, N))
    np.add.at(hist, (tp, np.rint(ty / cell).astype(int) + 40, np.rint(tx / cell).astype(int) + 40), 1 / 150)
    best = None
    uni = 1 / (2 * (x1 - x0 + 1) * (y1 - y0 + 1) * t2)
    for b in bands:
        s = b / cell
        rad = int(4 * s + .5)
        w = np.exp(-.5 * (np.arange(-rad, rad + 1) / s) ** 2)
        w /= w.sum()
        sm = np.stack([np.apply_along_axis(lambda a: np.convolve(a, w, "same"), 0, np.apply_along_axis(
            lambda a: np.convolve(a, w, "same"), 1, h)) for h in hist])
        z = 0.0
        for t in tk:
            for x in range(x0, x1 + 1):
                for y in range(y0, y1 + 1):
                    z += sm[:, int(np.rint(y / cell)) + 40, int(np.rint((x - vx * t) / cell)) + 40].sum() * t2 / ks
        a = sm[fp, np.rint(fy / cell).astype(int) + 40, np.rint(fu / cell).astype(int) + 40] / z
        eps = .3
        for _ in range(50):
            eps = float(np.clip((eps * uni / ((1 - eps) * a + eps * uni)).mean(), 1e-3, 1))
        bits = float(-np.log2(((1 - eps) * a + eps * uni) * delta).mean())
        if best is None or bits < best[0]:
            best = (bits, eps, b)
    want = best[0] + (1 + .5 * math.log2(60)) / 60
    assert (r.bits, r.eps, r.b_px) == pytest.approx((want, best[1], best[2]), rel=1e-6)
    assert r.gain_bits == pytest.approx(-math.log2(uni * delta) - want, rel=1e-6)


def test_background_of_poisson_noise(make):
    g = np.random.default_rng(7)
    W = H = 80
    span, rate = 500_000, 4.0
    n = g.poisson(rate * W * H * span * 1e-6)
    t = np.sort(g.integers(0, span, n))
    ev = make(list(zip(t, g.integers(0, W, n), g.integers(0, H, n), g.integers(0, 2, n))))
    b = ev.select("rec").distinct().withColumns({"lo": F.lit(0), "hi": F.lit(span)})
    r = Tr.background(ev, ["rec"], b, Sensor(W, H), 10_000).first()
    assert r.beta == pytest.approx(rate, rel=.08) and not r.saturated and r.n_hot == 0
    phi = max(1.0, r.beta * 400 * T0 * 1e-6)
    cdf, k = 0.0, -1
    while 1 - cdf > 1e-3:
        k += 1
        cdf += math.exp(-phi + k * math.log(phi) - math.lgamma(k + 1))
    assert r.theta == k


def test_lonely_against_pairs(make):
    g = np.random.default_rng(8)
    ev = [(int(t), int(x), int(y), int(p)) for t, x, y, p in zip(np.sort(g.integers(0, 200_000, 300)), g.integers(0, 12, 300), g.integers(0, 10, 300),
                                                                 g.integers(0, 2, 300))]
    want = {i for i, a in enumerate(ev) if not any(a[3] == b[3] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1 and a[1:3] != b[1:3]
                                                   and abs(a[0] - b[0]) <= 10_000 for b in ev)}
    assert {r.seq for r in Tr.lonely(make(ev), ("rec",), Sensor(12, 10), 10_000).collect()} == want


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_in_box_does_not_depend_on_tiles(spark, make, tile):
    g = np.random.default_rng(9)
    ev = make([(int(t), int(x), int(y), 1) for t, x, y in zip(np.sort(g.integers(0, 200_000, 400)), g.integers(0, 64, 400), g.integers(0, 48, 400))])
    lab = spark.createDataFrame([("r0", k, t, float(5 + 6 * k + t / 9000), float(3 + 4 * k), 12.0, 9.0) for k in range(4)
                                 for t in range(10_000 * k, 180_000, 30_000)],
                                "rec string, track_id bigint, t_us bigint, x double, y double, w double, h double")
    sn = Sensor(64, 48)
    got = {(r.seq, r.track_id) for r in B.in_box(ev, B.segments(lab, T0), sn, 1.0, tile).collect()}
    L_ = lab.toPandas()
    want = set()
    for k, b in L_.groupby("track_id"):
        for r in ev.collect():
            if b.t_us.min() <= r.t_us <= b.t_us.max():
                x, y, w, h = (np.interp(r.t_us, b.t_us, b[c]) for c in "xywh")
                if x - 1 <= r.x <= x + w + 1 and y - 1 <= r.y <= y + h + 1:
                    want.add((r.seq, k))
    assert got == want and len(want) > 50


def edges(W, H, shared, tau, v=6, n=3, spacing=40, windows=3, seed=0):
    g = np.random.default_rng(seed)
    out = []
    for y in range(H):
        a_row = g.random() * tau
        for e in range(-spacing * 2, W, spacing):
            for x in range(W):
                t0 = (x - e) * T0 / v
                A = a_row if shared else g.random() * tau
                out += [(int(t0 + A + j * tau), x, y, 1) for j in range(n) if 0 <= t0 + A + j * tau < windows * T0]
    return sorted(out)


@pytest.mark.parametrize("shared", [True, False])
def test_phases_lock_only_when_shared(make, shared):
    sn = Sensor(60, 24, T0, 12)
    ev = make(edges(60, 24, shared, 1000))
    ks = ev.select("rec").distinct().withColumn("w", F.lit(1).cast("bigint"))
    eg = Ca.clean_groups(ev, ks, 1000, 1000.0)
    m = Ca.fit_motion(eg, Ca.candidate_blocks(eg, sn, 20), sn, 8, "near_tie", n_min=20)
    ph = Ca.group_phases(eg, m, sn, 20).filter("kind = 'pred'").collect()
    u = np.array([r.u for r in ph])
    lock = abs(np.exp(2j * np.pi * u).mean())
    assert len(u) > 60 and (lock > .9 if shared else lock < .25)


def test_plane_flow_of_a_moving_edge(make):
    sn = Sensor(40, 20)
    ev = make([(int(x * 1e6 / 400), x, y, 1) for x in range(20) for y in range(20)], k=0)
    ev = make(sorted((r.t_us, r.x, r.y, r.p) for r in ev.collect()), k=0)
    ends = ev.select("k").distinct().withColumn("t_end", F.lit(50_000).cast("bigint"))
    f = Fl.plane_flow(ev, ends, ["k"], sn, 50_000).collect()
    assert len(f) > 200 and {(r.vx, r.vy) for r in f} == {(400, 0)}


def test_repair_and_words_do_not_depend_on_chunks(spark):
    g = np.random.default_rng(1)
    raw = spark.createDataFrame(pd.DataFrame({"rec": "r", "seq": range(500), "t_us": np.sort(g.integers(0, 5000, 500)) - g.integers(0, 40, 500),
                                              "x": g.integers(0, 9, 500), "y": 0, "p": g.integers(-1, 3, 500)}))
    a = {tuple(r) for r in I.repaired(raw, 7).collect()}
    assert a == {tuple(r) for r in I.repaired(raw, 10_000).collect()}
    t = raw.toPandas().t_us
    assert sum(r.clamped for r in I.repaired(raw, 7).collect()) == int((t.diff() < 0).sum())


def test_streams_equal_batch_over_many_micro_batches(spark, tmp_path):
    g = np.random.default_rng(6)
    n = 600
    pdf = pd.DataFrame({"rec": np.where(g.random(n) < .8, "hot", "cold"), "seq": np.arange(n), "t_us": np.sort(g.integers(0, 9000, n)) - g.integers(0, 60, n) + 100,
                        "x": g.integers(0, 4, n), "y": g.integers(0, 3, n), "p": g.integers(0, 2, n)})
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        pdf.iloc[i * 150:(i + 1) * 150].to_parquet(src / f"part{i}.parquet")
        import os
        os.utime(src / f"part{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "rec string, seq bigint, t_us bigint, x bigint, y bigint, p bigint"
    ev = spark.createDataFrame(pdf, schema)
    sn = Sensor(4, 3)

    def drain(step):
        out = str(tmp_path / step.__name__)
        return Lv.scan_stream(Lv.stream_events(spark, str(src), "part*.parquet", schema, 1), out, step(spark, out, **({"sensor": sn} if step is Lv.running_bits else {}),
                                                                                                   chunk_rows=40))
    key = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[k] for k in c)) for r in df.collect())
    assert key(drain(Lv.clamp_times), "seq", "t_us", "clamped") == key(I.repaired(ev, 64), "seq", "t_us", "clamped")
    d = ev.withColumn("chunk", C.idiv("seq", 64))
    want = L.polarity_bits(L.ratemap_bits(d, ["rec"], sn), ["rec"])
    assert key(drain(Lv.running_bits), "seq", "address_bits", "polarity_bits") == key(want, "seq", "address_bits", "polarity_bits")
    q = pdf.groupby(["rec", "x", "y"])
    want = pd.DataFrame({"seq": pdf.seq, "a": pdf.t_us - q.t_us.shift(1), "p": q.p.shift(1)}).fillna(-1)
    live = Lv.stream_events(spark, str(src), "part*.parquet", schema, 1).withColumn("ts", F.timestamp_micros("t_us"))
    with memory.keyed_state(spark):
        got = Lv.run_to_files(memory.pixel_ages(live), str(tmp_path / "ages")).toPandas().sort_values("seq").fillna(-1)
    assert (got.age_us.to_numpy() == want.a.to_numpy()).all() and (got.last_p.to_numpy() == want.p.to_numpy()).all()
