"""Tables in the folder that all executors share: lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local master gets one of its own (tests); a cluster must
    name one, as no machine's own folder is shared."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        folder = sc.getCheckpointDir()
    return folder


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again. The table goes when dropped() or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cairn_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
