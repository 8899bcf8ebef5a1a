"""Targets of a group fitted and graded in its row: grids against the joins of `voxels.match`, and a fit in few jobs."""
import random

import pytest
from pyspark.sql import functions as F

from voxelflux.functions import cols as C
from voxelflux.operators import fits as Ft, voxels as V
from voxelflux.sensor import Sensor

SN = Sensor(40, 30, 33_333, 20)
CELLS = [(s, k) for s in (1, 2, 4) for k in (1, 3, 8)]


@pytest.fixture(scope="module")
def sets(spark):
    rnd = random.Random(4)
    event = lambda: (rnd.randrange(SN.t0), rnd.randrange(5, 25), rnd.randrange(5, 25), rnd.randrange(2))      # noqa: E731
    src = spark.createDataFrame([(g, *event()) for g in ("a", "b") for _ in range(80)], "g string, tr long, x long, y long, p long")
    tru = spark.createDataFrame([(g, m, *event()) for g in ("a", "b") for m in (1, 2, 4) for _ in range(60)], "g string, m long, tr long, x long, y long, p long")
    start = spark.createDataFrame([(g, m, m, 0, 0, 0, 0, 0, 15.0, 15.0, 10.0, 10.0, 2, 30, 2, 28) for g in ("a", "b") for m in (1, 2, 4)],
                                  "g string, m long, dx long, dy long, ia long, ib long, ic long, id long, cx double, cy double, hx double, hy double, x0 long, x1 long, y0 long, y1 long")
    return src, tru, start


def test_grades_are_those_of_match(sets):
    src, tru, start = sets
    maps = start.select("*", *[F.lit(v).cast("long").alias(f"_{n}") for n, v in zip(Ft.PARAMS, (3, -1, 2, 0, 1, -2))])
    models = {"one": Ft.PARAMS, "two": [f"_{n}" for n in Ft.PARAMS]}
    got = Ft.target_grades(src, tru, maps, models, ["g"], CELLS, SN)
    assert {tuple(r) for r in got.select("model", "g", "m", "s", "k", "n1", "n2", "pairs").collect()} == {
        (name, *r) for name, q in models.items() for r in matched(src, tru, maps, q)}


def matched(src, tru, maps, q):
    x, y = C.move_affine("x", "y", "cx", "cy", "hx", "hy", q)
    pred = src.join(maps, "g").withColumns({"x": x, "y": y}).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    cols = ["g", "m", "tr", "x", "y", "p"]
    return [tuple(r) for r in V.match(pred.select(*cols), tru.select(*cols), CELLS, SN, keys=("g", "m")).select("g", "m", "s", "k", "n1", "n2", "pairs").collect()]


def test_targets_are_fitted_without_sweeps(spark, sets, monkeypatch):
    cuts, real = [], Ft.cut_lineage
    monkeypatch.setattr(Ft, "cut_lineage", lambda df: cuts.append(1) or real(df))
    got = Ft.staged_affine(*sets, ["g"], F.col("m"), SN).collect()
    assert len(got) == 6 and all(r.f1 >= r.start_f1 for r in got) and len(cuts) <= 3
