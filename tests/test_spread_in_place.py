"""Pixels that are spread or lie in boxes: shuffled before they multiply, with the results of loops."""
import math
import re
from statistics import median

from pyspark.sql import functions as F

from voxelflux.operators import flow as Fl
from voxelflux.plans import q_boxes
from voxelflux.sensor import Sensor


def test_flow_spreads_times_behind_the_shuffle(make):
    ev = make([(100 * i, i % 9, i % 7, i % 2) for i in range(50)])
    ends = F.broadcast(ev.select("rec", F.lit(5_000).alias("t_end")).distinct())                # else the join already deals by rec
    text = Fl.plane_flow(ev, ends, ["rec"], Sensor(12, 10), 50_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(rec" in text[text.index("Generate explode"):]             # from the result down to the sources
    assert not re.search("Exchange hashpartitioning", text[:text.index("Generate explode")])


def test_label_clock_by_hand(spark, make, monkeypatch):
    monkeypatch.delattr(q_boxes.B, "box_pixels")                                               # boxes must not become a row per pixel
    sn, rnd = Sensor(16, 8), [(7 * i * i + 3 * i) % 16 for i in range(200)]
    rows = [(i, rnd[i], (i * i) % 8, 0) for i in range(200)]
    boxes = [("c", "r0", 0, 1, 1.5, 0.5, 4.0, 3.0), ("c", "r0", 0, 2, 9.0, 2.0, 3.25, 2.0), ("d", "r0", 0, 1, 0.0, 0.0, 16.0, 8.0),
             ("d", "r0", 0, 2, 14.0, 6.0, 2.0, 2.0), ("d", "r0", 1, 1, 3.0, 3.0, 0.0, 0.0)]
    df = q_boxes.clock_ratio(make(rows), spark.createDataFrame(boxes, "conv string, rec string, w bigint, track_id bigint, bx double, by double, bw double, bh double"),
                             sn, (1.0, 3.0))
    want = {}
    for conv, _, w, _, bx, by, bw, bh in boxes:
        def inside(x, y, m):
            return math.ceil(bx - m) <= x < math.ceil(bx + bw + m) and math.ceil(by - m) <= y < math.ceil(by + bh + m)
        px = [(x, y) for x in range(16) for y in range(8)]
        a, r = [q for q in px if inside(*q, 0)], [q for q in px if inside(*q, 3) and not inside(*q, 1)]
        n = lambda s: sum((x, y) in s for _, x, y, _ in rows) if w == 0 else 0                # noqa: E731
        if a and r:
            want.setdefault(conv, []).append(n(a) / len(a) / (n(r) / len(r)) if n(r) else math.inf)
    got = {r.conv: (r.n_boxes, r.med) for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[c][0] == len(v) and math.isclose(got[c][1], median(v)) for c, v in want.items())
