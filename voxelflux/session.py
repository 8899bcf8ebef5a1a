"""Session helpers: local session for tests and bench, and lineage cuts that survive lost executors."""
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", partitions=8, app="voxelflux") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a local session (tests) gets one of its own; on a cluster executors would each write to
    their own disks, so there a missing setting is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys, rows=0, most=1 << 19) -> DataFrame:
    """`df` by `keys` over all shuffle partitions. Adaptive execution makes tasks by the size of what they read; this is for rows that multiply afterwards.
    With `rows`, the number that they multiply to, there are as many partitions as give each `most`, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)
