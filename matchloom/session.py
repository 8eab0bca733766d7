"""Session helpers: configuration, checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "matchloom", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def jit_sized(spark: SparkSession) -> SparkSession:
    """Lets long projections run as several small methods: HotSpot interprets, and never compiles, a method above 8,000 bytes.

    Spark's own limit is 65,535 bytes; a value the session was given is kept.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, "8000")
    return spark


#: Folders of local sessions that name none, by application.
LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_DIRS:
        LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return LOCAL_DIRS[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back.

    Used where several branches read the same expensive rows: later stages get a columnar
    scan, and a lost executor re-reads files instead of replaying the whole plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(written: DataFrame) -> None:
    """Deletes a table that `cut_lineage` wrote, once nothing reads it any more; a table without rows stays."""
    files = written.inputFiles()
    if files:
        folder = written.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
