"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, a local session gets a temporary folder;
    a cluster must name its own, as executors can't read the driver's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="siltstone-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number, bytes and latest change of the files at ``path``."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = [s for s in system.listStatus(found) if not s.isDirectory()]
    return len(kept), sum(s.getLen() for s in kept), max((s.getModificationTime() for s in kept), default=0)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: what a loop's next step starts from."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
