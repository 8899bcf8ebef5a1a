"""Keyed state in the state store: only the keys that a micro-batch touches are read and written, and idle ones expire."""
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AGES = "rec string, seq long, age_us long, last_p long"


@contextmanager
def keyed_state(spark: SparkSession):
    """The session with the state store that keyed state needs, for queries begun inside."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


class PixelMemory(StatefulProcessor):
    """Time and polarity of the last event of one pixel. A key's rows of one micro-batch are ordered together; a batch is bounded by the trigger."""

    def __init__(self, horizon_us=None):
        self.horizon = horizon_us

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "t_us long, p long")

    def handleInputRows(self, key, rows, timerValues):
        d = pd.concat(list(rows)).sort_values("seq", kind="stable")
        t, p, old = d["t_us"].to_numpy(np.int64), d["p"].to_numpy(np.int64), self.last.get()
        was = (0, 0) if old is None else (old[0], old[1])
        age = t - np.concatenate([[was[0]], t[:-1]])
        new = np.arange(len(t)) < (1 if old is None else 0)
        if self.horizon is not None:
            new |= age > self.horizon
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(d["at_ms"].max()) + self.horizon // 1000 + 1)
        self.last.update((int(t[-1]), int(p[-1])))
        out = pd.DataFrame({"seq": d["seq"].to_numpy(np.int64), "age_us": pd.array(age, "Int64"),
                            "last_p": pd.array(np.concatenate([[was[1]], p[:-1]]), "Int64")})
        out.loc[new, ["age_us", "last_p"]] = pd.NA
        out.insert(0, "rec", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self):
        pass


def pixel_ages(ev: DataFrame, horizon_us=None, delay=None) -> DataFrame:
    """(rec, seq, age_us, last_p) of each event: the time since the event before at its pixel and that one's polarity, NULL where there is none.

    Rows arrive in the order of `seq` from batch to batch. With `horizon_us` older events are forgotten: a longer age is NULL however the batches fall, and
    a pixel's state goes once the watermark (`delay` behind the latest `ts`) has passed its last event by the horizon, so the state holds the pixels of the
    last horizon and not all that were ever seen; rows behind the watermark are then left out by Spark, which counts them."""
    if horizon_us is not None:
        ev = ev.withWatermark("ts", delay or "0 seconds")
    cols = [*(["ts"] if horizon_us is not None else []), "rec", "x", "y", "seq", "t_us", "p", F.unix_millis("ts").alias("at_ms")]
    return ev.select(*cols).groupBy("rec", "x", "y").transformWithStateInPandas(
        statefulProcessor=PixelMemory(horizon_us), outputStructType=AGES, outputMode="Append", timeMode="None" if horizon_us is None else "EventTime")
