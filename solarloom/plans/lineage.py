"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session,
    or the checkpoint folder of its context. Where neither is set, a local
    session (tests) gets a temporary one; on a cluster that is an error, since
    executors would not see each other's files."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def folder(spark: SparkSession, path: str):
    """The path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read
    it back. A lost executor costs a re-read, never a recomputation. What no
    ``discard`` deletes goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/solarloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = folder(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._solarloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote once nothing reads it any more."""
    for df in frames:
        where, store = folder(df.sparkSession, df._solarloom_path)
        store.delete(where, True)


class Cuts:
    """The cuts of one computation: ``keep`` writes its result and deletes all
    that led to it."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made.append(materialize(df))
        return self.made[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        self.drop()
        return out

    def drop(self) -> None:
        discard(*self.made)
        self.made = []
