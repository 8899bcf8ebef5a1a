"""Multiset differences of tables, and the parts of a flow record, on hand-made rows."""
from voxelflux.operators import flow, stats
from voxelflux.sensor import DAY, DEMO


def test_differing(spark):
    schema = "k string, a long, b double"
    left = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 1.0), ("x", 2, None), ("y", 1, 1.0), ("y", 5, 0.5)], schema)
    right = spark.createDataFrame([("x", 1, 1.0), ("x", 2, None), ("x", 2, None), ("y", 5, 0.5), ("y", 1, 1.0), ("z", 0, 0.0)], schema)
    got = {r.k: (r.n_left, r.n_right, r.violations) for r in stats.differing(left, right, ["k"], ["a", "b"]).collect()}
    assert got == {"x": (3, 3, 2), "y": (2, 2, 0), "z": (0, 1, 1)}
    assert stats.differing(left.limit(0), right.limit(0), ["k"], ["a", "b"]).count() == 0


def test_record_parts(spark):
    """Two flow events on one pixel share one velocity; windows without plain events and a group without a flow still write their counts."""
    cols = "rec string, g long, m long, tr long, x long, y long, p long, vx long, vy long, part string"
    rows = [("a", 2, 0, 5, 3, 1, 1, -2, 70, "flow"), ("a", 2, 0, 9, 3, 1, 1, -2, 70, "flow"), ("a", 2, 0, DAY - 1, 4, 1, 0, None, None, "predicted"),
            ("a", 2, 1, 7, 15, 7, 1, None, None, "plain"), ("b", 6, 0, 1, 0, 0, 0, None, None, "plain")]
    got = {(r.rec, r.part, r.m): (r.n, r.bits) for r in flow.record_parts(spark.createDataFrame(rows, cols), DEMO, 2).collect()}
    # voxel numbers on the 1 px, 3 bin grid: (bin * 2 + p) * 128 + y * 16 + x; a count, the gap and 0 for a repeat take a byte per 7 bits
    assert got == {("a", "flow", 0): (2, 8 * (1 + 2 + 1)), ("a", "plain", 0): (0, 8), ("a", "plain", 1): (1, 8 * (1 + 2)),
                   ("a", "velocity", 0): (1, 8 * (1 + 1 + 2)), ("b", "flow", 0): (0, 8), ("b", "plain", 0): (1, 16), ("b", "plain", 1): (0, 8),
                   ("b", "velocity", 0): (0, 8)}
    assert flow.record_parts(spark.createDataFrame(rows, cols).limit(0), DEMO, 2).count() == 0
    assert {r.rec: r.bits for r in flow.split_bits(spark.createDataFrame(rows, cols), DEMO, 2).collect()} == {"a": 96, "b": 40}
