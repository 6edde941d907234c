"""Session defaults and the one way this package cuts lineage."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kindred")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job through the reliable checkpoint folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(spark) or f"{_local(spark)}/checkpoint")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back from compressed columns in a new folder of intermediate tables."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables."""
    shared = _shared(spark)
    return f"{shared.rstrip('/')}/kindred-{uuid.uuid4().hex}" if shared else _local(spark)


def _shared(spark: SparkSession) -> str | None:
    """The folder that the cluster shares, named in ``spark.checkpoint.dir``."""
    return spark.conf.get("spark.checkpoint.dir", None)


def _local(spark: SparkSession) -> str:
    """A temporary folder of this machine, which only a local session can read back."""
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="kindred-")
