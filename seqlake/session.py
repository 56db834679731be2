"""Session helpers: a local session for tests and benchmarks, and the shared checkpoint folder."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, shuffle_partitions: int | None = None,
                  app: str = "seqlake", memory: str = "8g") -> SparkSession:
    """A local session configured like the clusters this library targets (AQE on, UTC, no UI)."""
    cores = cores or os.environ.get("SEQLAKE_CORES", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a plain local session (tests, one machine) that has none gets a private folder; on any
    other master a missing folder is an error, since executors could not see the driver's disk.
    """
    sc = spark.sparkContext
    conf = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="seqlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the table's true size in
    bytes, so that joins against it are broadcast or shuffled by the session's own threshold.
    The files go with :func:`release`, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop_path = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read any more: what was made from them is written itself."""
    for table in tables:
        path = getattr(table, "_settled_path", None)
        if path:
            fs, hadoop_path = _file_system(table.sparkSession, path)
            fs.delete(hadoop_path, True)
            table._settled_path = None


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
