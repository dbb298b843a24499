"""Session helpers shared by the corpus operators: shared scratch space, materialisation, table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session without that setting gets a fresh local one if its executors live in the same machine (tests, a laptop), else an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs no recomputation.

    Iterations use this rather than ``checkpoint``, which keeps the plan's size estimate: over some
    rounds of joins that grows beyond any bound, a table's is its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return table_at(spark, path, df.schema)


def table_at(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a scratch path, which ``discard`` deletes."""
    back = spark.read.schema(schema).parquet(path)
    back._tidemark_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads, once nothing reads it any more."""
    remove_path(df.sparkSession, df._tidemark_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for narrow tables; Spark deletes it when it is out of use."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
