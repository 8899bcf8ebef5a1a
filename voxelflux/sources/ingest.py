"""Scans: schemas, validation, repair, word and text decoding, manifests, row sinks."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.cols import idiv
from ..operators.scans import FIRST, PREV, chunk_totals, running
from ..sensor import Sensor

EVENT_SCHEMA = T.StructType([T.StructField("rec", T.StringType()), T.StructField("seq", T.LongType()),
                             T.StructField("t_us", T.LongType()), T.StructField("x", T.IntegerType()),
                             T.StructField("y", T.IntegerType()), T.StructField("p", T.IntegerType())])
LABEL_SCHEMA = T.StructType([T.StructField("rec", T.StringType()), T.StructField("t", T.LongType()),
                             *[T.StructField(c, T.FloatType()) for c in ("x", "y", "w", "h")],
                             T.StructField("class_id", T.IntegerType()), T.StructField("track_id", T.LongType()),
                             T.StructField("class_confidence", T.FloatType())])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A missing path is an error of the reader; nothing is searched."""
    raw = spark.read.schema(LABEL_SCHEMA).parquet(path)
    return raw.select("rec", "track_id", "class_id", F.col("t").alias("t_us"),
                      *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")],
                      F.col("class_confidence").cast("double").alias("conf"))


def require_fields(df: DataFrame, fields=("rec", "seq", "t_us", "x", "y", "p")) -> DataFrame:
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"events: fields missing: {missing}")
    return df


def bad_row(sensor: Sensor):
    return (F.col("x").isNull() | F.col("y").isNull() | F.col("t_us").isNull() | F.col("p").isNull()
            | (F.col("x") < 0) | (F.col("x") >= sensor.width) | (F.col("y") < 0) | (F.col("y") >= sensor.height)
            | ~F.col("p").isin(0, 1) | (F.col("t_us") < 0))


def validated(df: DataFrame, sensor: Sensor) -> DataFrame:
    """Events checked while they stream through the scan: a bad row fails the job, no extra pass is made."""
    require_fields(df)
    msg = F.concat(F.lit("bad event in "), F.col("rec"), F.lit(" at "), F.col("seq").cast("string"))
    return df.withColumn("x", F.when(bad_row(sensor), F.raise_error(msg)).otherwise(F.col("x")))


def scan_report(df: DataFrame, sensor: Sensor) -> DataFrame:
    """Facts of each recording; `valid` is false where `validated` would fail."""
    return df.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t_first"), F.max("t_us").alias("t_last"),
        F.max("x").alias("x_max"), F.max("y").alias("y_max"), F.avg(F.col("p").cast("double")).alias("share_p1"),
        (~F.bool_or(bad_row(sensor))).alias("valid"))


def repaired(raw: DataFrame, chunk_rows=1 << 20) -> DataFrame:
    """Decreasing times clamped to the running maximum, polarity folded to {0, 1}, bit 15 of x cleared.

    `clamped` marks the rows whose time was below that of the row before."""
    df = raw.withColumn("_chunk", idiv("seq", chunk_rows))
    tot = chunk_totals(df, ["rec"], "_chunk",
                       {"_mx": F.max("t_us"), "_last": F.max_by("t_us", "seq")},
                       {"_cmx": lambda w: F.max("_mx").over(w.rowsBetween(FIRST, PREV)),
                        "_clast": lambda w: F.lag("_last").over(w)})
    w = Window.partitionBy("rec", "_chunk").orderBy("seq")
    df = df.join(tot, ["rec", "_chunk"])
    return df.select(
        *[c for c in raw.columns if c not in ("t_us", "x", "p")],
        F.greatest(F.col("_cmx"), F.max("t_us").over(w.rowsBetween(FIRST, 0))).alias("t_us"),
        F.coalesce(F.col("t_us") < F.coalesce(F.lag("t_us").over(w), F.col("_clast")), F.lit(False)).alias("clamped"),
        F.col("x").bitwiseAND(F.lit(32767)).alias("x"), (F.col("p") > 0).cast("bigint").alias("p"))


def describe(df: DataFrame) -> DataFrame:
    """Name, type and non-null rows of each column, as rows."""
    cols = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    one = df.agg(*[F.count(c).alias(c) for c, _ in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("n_present"))
                      for c, t in cols])
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def inventory(ev: DataFrame, labels: DataFrame, sensor: Sensor, tick=1e-6) -> DataFrame:
    e = ev.groupBy("rec").agg(F.count(F.lit(1)).alias("n_events"), F.min("t_us").alias("t_first"),
                              F.max("t_us").alias("t_last"))
    b = labels.groupBy("rec").agg(F.count(F.lit(1)).alias("n_boxes"), F.countDistinct("track_id").alias("n_tracks"))
    dur = (F.col("t_last") - F.col("t_first")) * F.lit(tick)
    return e.join(b, "rec", "left").select(
        "rec", "n_events", "t_first", "t_last", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"),
        F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), dur.alias("duration_s"),
        F.when(dur > 0, F.col("n_events") / dur).alias("events_per_s"),
        F.when(dur > 0, F.col("n_events") / dur * (sensor.t0 * tick) / (sensor.width * sensor.height))
        .alias("events_per_pixel_window"))


def decode_words(words: DataFrame, chunk_rows=1 << 20) -> DataFrame:
    """32-bit word stream (rec, pos, word) to events. The time-high word is carried forward; CD words before the first
    one are dropped. Carrying is a running maximum of (pos, payload), in two phases."""
    typ = F.shiftrightunsigned("word", 28)
    df = words.select("rec", "pos", "word", typ.alias("typ"), idiv("pos", chunk_rows).alias("_chunk"),
                      F.when(typ == 8, F.struct(F.col("pos").alias("pos"),
                                                F.col("word").bitwiseAND(F.lit(0x0FFFFFFF)).alias("v"))).alias("_th"))
    df = running(df, ["rec"], ["pos"], "_chunk", "_th", F.max, "th")
    return df.filter((F.col("typ") <= 1) & F.col("th").isNotNull()).select(
        "rec", F.col("pos").alias("seq"),
        (F.col("th.v") * 64 + F.shiftright("word", 22).bitwiseAND(F.lit(63))).alias("t_us"),
        F.shiftright("word", 11).bitwiseAND(F.lit(2047)).alias("x"), F.col("word").bitwiseAND(F.lit(2047)).alias("y"),
        F.col("typ").cast("bigint").alias("p"))


def word_counts(words: DataFrame) -> DataFrame:
    typ = F.shiftrightunsigned("word", 28)
    first = F.min(F.when(typ == 8, F.col("pos")))
    w = words.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(typ <= 1).alias("n_cd"), F.count_if(typ == 8).alias("n_time_high"),
        F.count_if((typ > 1) & (typ != 8)).alias("n_other"), first.alias("first_th"))
    early = words.join(w.select("rec", "first_th"), "rec").filter(
        (typ <= 1) & (F.col("first_th").isNull() | (F.col("pos") < F.col("first_th")))).groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_cd_early"))
    return w.join(early, "rec", "left").select("rec", "n_words", "n_cd", "n_time_high", "n_other",
                                               F.coalesce("n_cd_early", F.lit(0)).alias("n_cd_early"))


def parse_text(lines: DataFrame, column="line") -> DataFrame:
    """Lines `t x y p` with t in seconds; other columns are kept."""
    part = F.split(F.col(column), " ")
    return lines.select(*[c for c in lines.columns if c != column],
                        F.rint(part[0].cast("double") * 1e6).cast("bigint").alias("t_us"),
                        part[1].cast("bigint").alias("x"), part[2].cast("bigint").alias("y"),
                        part[3].cast("bigint").alias("p"))


def read_text_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_text(spark.read.text(path).withColumnRenamed("value", "line"))


def ids_sha256(ids: DataFrame) -> DataFrame:
    """Hash and count of an allow list of any length, in two levels: ids are dealt by the first four digits of their own hash, each share is
    hashed in order, and the at most 65,536 share hashes are hashed in the order of their digits."""
    share = ids.select("rec").distinct().groupBy(F.substring(F.sha2("rec", 256), 1, 4).alias("digits")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("rec")), "\n"), 256).alias("hash"))
    return share.agg(F.sum("n").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("digits", "hash"))), lambda s: s["hash"]), "\n"), 256)
                     .alias("sha256"))


def allowed(ev: DataFrame, ids: DataFrame) -> DataFrame:
    return ev.join(ids.select("rec").distinct(), "rec", "left_semi")


def resolve(manifest: DataFrame, present: DataFrame) -> DataFrame:
    p = present.select("rec").distinct().withColumn("_f", F.lit(True))
    return manifest.join(p, "rec", "left").select("rec", F.coalesce("_f", F.lit(False)).alias("found"))


def lighting(rec="rec"):
    return F.when(F.col(rec).startswith("day_"), "day").when(F.col(rec).startswith("night_"), "night")


def write_rows(df: DataFrame, path: str, keys=("rec",)) -> None:
    """Resumable sink: rewriting a recording replaces its partition and no other."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def finite(c):
    """NaN and infinities to NULL, as reports need."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def json_rows(df: DataFrame) -> DataFrame:
    cols = [finite(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select("rec", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("report"))
