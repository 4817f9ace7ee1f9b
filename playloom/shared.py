"""Folders that driver and executors share, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if configured is None and current.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="playloom-"))
        current = context._jsc.sc().getCheckpointDir()
    elif current.isEmpty():
        context.setCheckpointDir(configured)
    return (configured or current.get()).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so a
    lost executor costs the re-read of a few files only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one run of an operator, in one folder; what is not needed any more can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.frames: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once as Parquet and read it back, as :func:`materialize` does."""
        path = f"{self.folder}/{len(self.paths)}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.frames.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, which nothing reads any more."""
        context = self.spark.sparkContext
        for path in [p for df, p in self.frames if any(df is t for t in tables)]:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        self.frames = [(df, p) for df, p in self.frames if not any(df is t for t in tables)]

    def keep_last(self) -> None:
        """Delete all tables of this run but the last one."""
        self.drop(*[df for df, _ in self.frames[:-1]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
