import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from voxelflux.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "tests")


@pytest.fixture(scope="session")
def make(spark):
    """Events from (t, x, y, p) rows of one recording; `w` and `tr` are added for the given window length."""
    def build(rows, t0=33_333, rec="r0", **extra):
        data = [(rec, i, int(t), int(x), int(y), int(p), int(t) // t0, int(t) % t0) for i, (t, x, y, p) in enumerate(rows)]
        df = spark.createDataFrame(data, "rec string, seq bigint, t_us bigint, x bigint, y bigint, p bigint, w bigint, tr bigint")
        from pyspark.sql import functions as F
        for k, v in extra.items():
            df = df.withColumn(k, F.lit(v).cast("bigint"))
        return df
    return build
