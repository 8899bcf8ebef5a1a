"""Hand-made cases with exact results."""
import math

import pytest
from pyspark.sql import functions as F

from voxelflux.functions import cols as C
from voxelflux.operators import boxes as B, causal as Ca, codelen as L, curves as Cv, shift as S, stats as St, subsets as Sb
from voxelflux.operators import tolerance as To, trains as Tr, voxels as V
from voxelflux.plans.q_motion import key_of  # noqa: F401  (import check)
from voxelflux.sensor import Sensor
from voxelflux.sources import ingest as I

SN = Sensor(100, 100)


def rows(df, *c):
    return sorted(tuple(r[k] for k in c) for r in df.collect())


def test_voxel_f1(make):
    ev = [(100, 10, 5, 1), (200, 10, 5, 1), (300, 11, 5, 0), (30000, 40, 9, 1)]
    a = make(ev)
    r = V.scores(V.match(a, a, [(1, 32)], SN)).first()
    assert (r.f1, r.precision, r.recall) == (1, 1, 1)
    flip = make([(t, x, y, 1 - p) for t, x, y, p in ev[:2]])
    assert V.scores(V.match(flip, make(ev[:2]), [(4, 1)], SN)).first().f1 == 0
    mv = make([(t, x + 1, y, p) for t, x, y, p in ev[:3]])
    r = V.scores(V.match(mv, a, [(2, 1)], SN)).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx((2 / 3, 2 / 4, 4 / 7))


def test_empty_side_scores_zero(make):
    a = make([(1, 1, 1, 1)])
    r = V.scores(V.match(a.limit(0), a, [(2, 3)], SN)).first()
    assert (r.n1, r.n2, r.f1, r.precision, r.recall) == (0, 1, 0, 0, 0)


def test_group_summary(spark):
    df = spark.createDataFrame([(100, 100, 200, 50), (100, 0, 400, 0)], "n_key int, n_rec int, n_true int, pairs int")
    a, b = V.group_summary(df).collect()
    assert (a.F, a.share, a.q_eq, a.gamma) == pytest.approx((.75, .5, .6, 1.2))
    assert (b.share, b.F, b.gamma) == pytest.approx((.25, .4, 1.0))


def test_regular_spacing(make):
    trains = {0: [0, 1000, 2000, 3000], 1: [0, 1000, 21000, 22000], 2: [0, 50000, 100000], 3: [0, 1000, 2100, 32100], 4: [0, 1000],
              5: [0, 15000, 30000, 45000], 7: [0, 1000, 2300]}
    ev = make(sorted((t, x, 0, 1) for x, ts in trains.items() for t in ts))
    got = dict(rows(Tr.regular_spacing(ev, ("rec",), 33_333), "x", "tau"))
    assert got == {0: 1000, 3: 1050, 5: 15000}


def test_pixel_phases(make):
    true = [(1000 * k, 5, 5, 1) for k in range(4)] + [(t, 6, 5, 1) for t in (0, 1000, 5000)] + [(1000 * k + 300, 7, 5, 0) for k in range(3)]
    pred = [(t, 5, 5, 1) for t in (250, 1250, 3250)] + [(500, 6, 5, 1), (900, 7, 5, 0), (400, 8, 5, 1)]
    got = Ca.pixel_phases(make(sorted(true)), make(sorted(pred)), ["rec"], 33_333).collect()
    assert sorted(round(r.u, 6) for r in got) == [.25, .6] and {r.tau for r in got} == {1000}


@pytest.mark.parametrize("second,want", [(81, (2, 0, 100, .79)), (79, (3, 0, 100, .79))])
def test_near_tie_shift(spark, second, want):
    sc = spark.createDataFrame([(0, 3, 0, 100), (0, 2, 0, second), (0, -1, -1, 79)], "block bigint, dx bigint, dy bigint, score bigint")
    r = S.near_tie_shift(sc, ["block"]).first()
    assert (r.dx, r.dy, r.pairs) == want[:3] and r.runner_up == pytest.approx(want[3])


def test_weak_best_means_no_motion(spark):
    sc = spark.createDataFrame([(0, 3, 0, 4)], "block bigint, dx bigint, dy bigint, score bigint")
    r = S.near_tie_shift(sc, ["block"]).first()
    assert (r.dx, r.dy, r.runner_up) == (0, 0, 1)


def test_onset_delay(make):
    true = make([(5000 + 700 * k, 3, 3, 1) for k in range(4)])
    moved = make([(4700 + 700 * k, 3, 3, 1) for k in range(4)])
    assert Tr.onset_delay(moved, true, ("rec", "w"), SN).first().delta == 300
    assert Tr.onset_delay(moved.limit(0), true, ("rec", "w"), SN).count() == 0


def test_tie_order(make):
    ev = make([(5, 1, 0, 0), (5, 2, 0, 0), (5, 3, 0, 0), (9, 1, 0, 0), (9, 1, 0, 0), (12, 0, 0, 0)]).withColumn("t", F.col("t_us"))
    r = L.order_free_saving(ev, ["rec"]).first()
    assert r.saving_bits == pytest.approx(math.log2(6)) and r.duplicate_groups == 1


def test_log2_factorial_of_large_counts(spark):
    df = spark.range(1).select(*[L.log2_factorial(F.lit(n)).alias(f"n{n}") for n in (1, 2, 64, 65, 1000)])
    for n, v in zip((1, 2, 64, 65, 1000), df.first()):
        assert v == pytest.approx(math.lgamma(n + 1) / math.log(2), abs=1e-8)


def test_poisson_bits(spark):
    a, b = spark.range(1).select(C.poisson_bits(F.lit(.1), F.lit(1e-6)), C.poisson_bits(F.lit(1.0), F.lit(1e-3))).first()
    assert a == pytest.approx(24.70, abs=.01) and b == pytest.approx(11.41, abs=.01)


def hull_at(spark, pts, q, envelope=True):
    df = spark.createDataFrame([(0, float(s), float(b)) for s, b in pts], "k int, share double, bits double")
    c = df.groupBy("k").agg(Cv.curve().alias("c")).select(Cv.with_origin(F.col("c")).alias("c"))
    if envelope:
        c = c.select(Cv.hull(F.col("c")).alias("c"))
    return [c.select(Cv.lookup(F.col("c"), F.lit(float(v)))).first()[0] for v in q]


def test_envelope(spark):
    pts = [(1, 10), (.5, 7), (.25, 4)]
    assert hull_at(spark, pts, (.25, .375), False) == pytest.approx([4, 5.5])
    assert hull_at(spark, pts, (.25, .5, 0, 1, 2)) == pytest.approx([2.5, 5, 0, 10, 10])
    assert hull_at(spark, pts + [(.5, 3)], (.5, .25, .75)) == pytest.approx([3, 1.5, 6.5])


def test_count_errors(spark):
    a, b = dict(zip((1, 2, 3, 5, 8, 9), (1, 3, 1, 2, 1, 4))), dict(zip((2, 3, 4, 8, 9), (1, 2, 2, 1, 6)))
    df = spark.createDataFrame([(0, a.get(k, 0), b.get(k, 0)) for k in sorted({*a, *b})], "g int, c1 bigint, c2 bigint")
    r = V.count_errors(df, ["g"]).first()
    assert (r.removed1, r.removed2, r.kept, r.lowered, r.raised, r.added, r.in_events, r.out_events) == (1, 2, 9, 2, 3, 2, 12, 12)
    assert r.balanced


def test_block_spacing_and_polarity(make):
    ev = [(500 * k, 0, 0, 1) for k in range(40)] + [(2000 * k, x, 0, 1) for x in range(1, 10) for k in range(4)]
    ev += [(10, 20 + x, 0, p) for x in range(5) for p in (0, 1)]
    df = make(sorted(ev))
    got = {r.block: r for r in Tr.block_spacing(df, ("rec",), SN).collect()}
    assert (got[0].tau, got[0].n_pix, got[0].covered) == (2000, 10, 1)
    assert (got[1].tau, got[1].n_pix, got[1].covered) == (None, 0, 0)
    assert dict(rows(Tr.both_polarities(df, ("rec",), SN), "block", "both_share")) == {0: 0, 1: 1}


def test_pixel_offsets(make):
    true = make(sorted([(1000 + 2000 * k, 5, 5, 1) for k in range(3)] + [(4000, 6, 5, 1)]), g=0)
    pred = make(sorted([(1500 + 2000 * k, 5, 5, 1) for k in range(3)] + [(9000, 7, 5, 1), (4300, 6, 5, 1)]), g=0)
    o = {r.x: (r.sym, r.deleted) for r in To.pixel_offsets(pred, true, SN).collect()}
    step = 33_333 // 64
    assert o == {5: (round(-500 / step), False), 6: (round(-300 / step), False), 7: (None, True)}


def test_rayleigh(spark):
    df = spark.createDataFrame([(0, 5, 5.0, 0.0), (0, 10, 0.0, 0.0), (0, 2, 2.0, 0.0)], "k int, n int, c double, s double")
    r = St.rayleigh(df, ["k"]).first()
    assert (r.blocks, r.pixels, r.mean_Z, r.share_above) == (2, 15, 2.5, .5)


@pytest.mark.parametrize("n", [1, 3, 8, 64])
def test_cap_ranks(make, n):
    N = 37
    ev = make([(10 * i, i % 5, i % 3, 1) for i in range(N)])
    kept = [r.seq for r in Tr.cap_per_block(ev, n, SN).orderBy("seq").collect()]
    assert kept == (list(range(N)) if N <= n else [((2 * j + 1) * N) // (2 * n) for j in range(n)])


@pytest.mark.parametrize("bad", [dict(x=640), dict(y=480), dict(p=2), dict(t_us=-1)])
def test_validation_fails_the_job(make, bad):
    from pyspark.errors import PySparkException
    ev = make([(1, 1, 1, 1)])
    for k, v in bad.items():
        ev = ev.withColumn(k, F.lit(v).cast("bigint"))
    s = Sensor(640, 480)
    assert not I.scan_report(ev, s).first().valid
    with pytest.raises(PySparkException):
        I.validated(ev, s).select("x").collect()


def test_missing_field_and_missing_file(make, spark, tmp_path):
    with pytest.raises(ValueError):
        I.validated(make([(1, 1, 1, 1)]).drop("p"), SN)
    with pytest.raises(Exception):
        I.read_labels(spark, str(tmp_path / "absent")).collect()


def test_fidelities_of_identity_and_thinning(make, spark):
    ev = make([(37 * i % 33_333, (i * 7) % 100, (i * 13) % 100, i % 2) for i in range(4000)])
    f = V.fidelities(V.window_sums(ev, ev, Sensor(100, 100)), ["rec"]).first()
    assert (f.F, f.F20, f.FH, f.Fsnr) == pytest.approx((1, 1, 1, 1))
    th = Sb.thin(ev, .3)
    q = th.count() / 4000
    f = V.fidelities(V.window_sums(th, ev, Sensor(100, 100)), ["rec"]).first()
    assert f.F == pytest.approx(2 * q / (1 + q)) and f.F20 == pytest.approx(f.F) and abs(q - .3) < .04
    assert V.fidelities(V.window_sums(ev.limit(0), ev, Sensor(100, 100)), ["rec"]).first().F == 0


def test_thinning_is_nested(make):
    ev = make([(i, i % 50, 0, 1) for i in range(2000)])
    a = {r.seq for r in Sb.thin(ev, .2).collect()}
    b = {r.seq for r in Sb.thin(ev, .5).collect()}
    assert a < b


def test_round_trip_keeps_every_count(make):
    from voxelflux.operators import encode as E
    ev = make([(31 * i % 33_333, (i * i) % 90, (i * 11) % 70, i % 2) for i in range(600)])
    for cell in ((2, 3), (1, 3), (3, 7)):
        dec = E.decode(E.encode(ev, cell, SN), cell, SN)
        m = V.match(dec, ev, [cell], SN).first()
        assert m.n1 == m.n2 == m.pairs == 600
        bits = E.set_bits(ev, cell, SN).first().bits
        assert bits == 8 * E.encode(ev, cell, SN).first().n_bytes


def test_representation_round_trip(make):
    ev = make([(31 * i % 33_333, (i * i) % 90, (i * 11) % 70, i % 2) for i in range(600)])
    v = V.voxel_counts(ev, [(2, 3)], SN)
    for place in ("start", "center"):
        m = V.match(V.from_voxels(v, SN, place).drop("s", "k"), ev, [(2, 3)], SN).first()
        assert m.n1 == m.n2 == m.pairs


def test_row_sink_is_resumable(spark, tmp_path):
    p = str(tmp_path / "rows")
    I.write_rows(spark.createDataFrame([("a", 1), ("b", 2)], "rec string, n int"), p)
    I.write_rows(spark.createDataFrame([("b", 5)], "rec string, n int"), p)
    assert rows(spark.read.parquet(p), "rec", "n") == [("a", 1), ("b", 5)]


def test_text_source(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text("0.000001 3 4 1\n1.5 7 8 0\n")
    assert rows(I.read_text_events(spark, str(f)), "t_us", "x", "y", "p") == [(1, 3, 4, 1), (1500000, 7, 8, 0)]


def test_tracks_interpolate_and_clamp(spark):
    raw = spark.createDataFrame([("r", 0, 1, 2, 0, 10., 0., 4., 2., 1.), ("r", 1, 1, 2, 0, 99., 0., 4., 2., 1.),
                                 ("r", 2, 1, 1, 100, 20., 10., 4., 4., 1.), ("r", 3, 1, 1, 200, 40., 10., 4., 4., 1.)],
                                "rec string, seq bigint, track_id bigint, class_id int, t_us bigint, x double, y double, w double, h double, conf double")
    lab = B.clean_labels(raw)
    life, seg = B.tracks(lab), B.segments(lab, 1000)
    assert rows(life, "class_id", "t_first", "t_last", "n_frames") == [(1, 0, 200, 3)]
    q = spark.createDataFrame([("r", 1, t) for t in (-50, 0, 50, 150, 200, 900)], "rec string, track_id bigint, t bigint")
    got = {r.t: (r.bx, r.by, r.bh) for r in B.box_at(q, seg, life, 1000).collect()}
    assert got == {-50: (10, 0, 2), 0: (10, 0, 2), 50: (15, 5, 3), 150: (30, 10, 4), 200: (40, 10, 4), 900: (40, 10, 4)}
