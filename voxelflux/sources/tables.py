"""Adapter views: a moving-pixel event stream and labelled boxes derived from the `events` table.

Every 30 users form one recording, so the number of recordings grows with the table while the density of a recording
stays that of one sensor. A user is a point that drifts 2 px per window (one day) along its row.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cols import idiv
from ..sensor import DAY

EPOCH_US = 1_704_067_200_000_000      # 2024-01-01T00:00:00Z
BIN6H = 21_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec_name(r):
    return F.concat(F.when(r % 5 < 3, "day_").otherwise("night_"),
                    F.lpad(r.cast("string"), 10, "0"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev(rec, seq, t_us, x, y, p, w, tr, user): `w` is the window and `tr` the time inside it."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("user"), "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("t_us"))
    i = F.col("user") % 30
    w = idiv("t_us", DAY)
    return e.select(
        rec_name(idiv("user", 30)).alias("rec"), "seq", "t_us",
        ((i * 7 + idiv(i, 8) * 3 + w * 2) % 16).cast("bigint").alias("x"),
        (i % 8).cast("bigint").alias("y"),
        F.when(F.col("event_type").isin("click", "error"), 1).otherwise(0).cast("bigint").alias("p"),
        w.alias("w"), (F.col("t_us") % DAY).alias("tr"), "user")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclean labels: one row per event on a 6 h frame clock, with duplicate frames and varying class."""
    ev = events(spark, sf_dir)
    f = idiv("t_us", BIN6H)
    return ev.select(
        "rec", "seq", F.col("user").alias("track_id"), ((F.col("user") + F.col("p")) % 7).alias("class_id"),
        (f * BIN6H).alias("t_us"),
        (F.col("x") - 1.0 + (f % 4) * 0.5).cast("double").alias("x"), (F.col("y") - 1.0).cast("double").alias("y"),
        (F.lit(3.0) + F.col("seq") % 3).cast("double").alias("w"),
        (F.lit(3.0) + (f % 5) * 0.25).cast("double").alias("h"), F.lit(1.0).alias("conf"))
