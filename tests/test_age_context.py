"""The age-context scan moves events and chunks only: no rows per neighbour, age step or class."""
import random

import pytest

from voxelflux.functions import cols as C
from voxelflux.operators import codelen as L
from voxelflux.sensor import Sensor


@pytest.fixture(scope="module")
def streams(spark):
    rnd = random.Random(5)
    rows = [(f"r{k}", i, t, rnd.randrange(6), rnd.randrange(5), rnd.randrange(2))
            for k in range(3) for i, t in enumerate(sorted(rnd.randrange(4000) for _ in range(150 + 40 * k)))]
    return spark.createDataFrame(rows, "rec string, seq long, t long, x long, y long, p long")


def coded(df, keys, nbr=True, chunk_slots=7):
    c = L.context_code(df, keys, Sensor(6, 5), C.idiv("t", 10), nbr, chunk_slots)
    return {(r.rec, r.seq): (r.cls, round(r.address_bits, 9), round(r.polarity_bits, 9)) for r in c.collect()}


@pytest.mark.parametrize("nbr", [False, True])
def test_chunks_change_nothing(streams, nbr):
    whole = coded(streams, ["rec"], nbr, 10_000)
    assert len(whole) == streams.count() and coded(streams, ["rec"], nbr, 7) == coded(streams, ["rec"], nbr, 1) == whole


def test_rows_do_not_multiply(streams):
    plan = L.context_code(streams, ["rec"], Sensor(6, 5), C.idiv("t", 10), True, 7)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and not any(w in plan for w in ("Generate", "explode", "Expand"))


def test_events_outside_the_sensor_are_an_error(spark):
    df = spark.createDataFrame([("r", 0, 1, 6, 0, 0)], "rec string, seq long, t long, x long, y long, p long")
    with pytest.raises(Exception, match="outside the sensor"):
        coded(df, ["rec"])
