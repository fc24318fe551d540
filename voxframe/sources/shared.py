"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, local mode (tests) gets a temporary one; on a cluster, whose machines share no such folder, RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxframe-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxframe-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, so a lost executor costs a read and not a recomputation."""
    return _reread(df, new_folder(df.sparkSession))


def _reread(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder of tables that nothing needs after the block: `with Scratch(spark) as s: t = s.cut(df)`; they are deleted at its end, whatever happens in it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.tables = spark, new_folder(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        if self.tables:
            remove(self.spark, self.folder)

    def cut(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return _reread(df, f"{self.folder}/{self.tables}")

    def drop(self, number: int) -> None:
        """Deletes the table that was cut as the number-th, before the block ends."""
        remove(self.spark, f"{self.folder}/{number}")
