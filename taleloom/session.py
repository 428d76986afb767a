"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("taleloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; one of its own only on a single machine, as in tests."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    spark.sparkContext.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master))


def checkpoint_folder(shared: str | None, master: str) -> str:
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="taleloom-checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: the rows survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a plain scan the bytes of its files. No job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks when the files make too few.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df if have >= want else df.repartition(want, *keys)
