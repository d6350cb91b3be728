"""Session settings and reliable checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "boardwalk", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks.  Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; a local session without one gets a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = root or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in a new shared folder: what made them runs once, however often they are read."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` of the session decides where; only a session without
    one (local tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)
