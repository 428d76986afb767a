"""Streams over append-only logs: exactly-once copies, per-key state, budgets and a halt switch."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Budget:
    """Finite limits; None is no limit."""

    batches: int | None = None
    seconds: float | None = None
    halt_file: str | None = None
    disk_bytes: int | None = None
    disk_path: str | None = None

    def disk_used(self) -> int:
        """Bytes of all files under ``disk_path``, a folder of the driver's machine."""
        return sum(f.stat().st_size for f in Path(self.disk_path).rglob("*") if f.is_file()) if self.disk_path else 0

    def remaining(self, batches: int, began: float) -> dict[str, float | None]:
        """What is left of each limit, never below 0; None is no limit."""
        left = {"batches": (self.batches, batches), "seconds": (self.seconds, time.monotonic() - began), "disk_bytes": (self.disk_bytes, self.disk_used())}
        return {name: None if most is None else max(0, most - used) for name, (most, used) in left.items()}

    def spent(self, batches: int, began: float) -> str | None:
        """Why to stop, or None; a halt file's text is its reason."""
        if self.halt_file and Path(self.halt_file).exists():
            return Path(self.halt_file).read_text().strip() or "halted"
        if self.disk_bytes is not None and self.disk_used() >= self.disk_bytes:
            return "disk exhausted"
        if self.batches is not None and batches >= self.batches:
            return "batches exhausted"
        if self.seconds is not None and time.monotonic() - began >= self.seconds:
            return "time exhausted"
        return None


def log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """JSON lines of a growing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def copy_to(stream: DataFrame, out: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """What has arrived, exactly once: a repeated call goes on where the last one ended."""
    return stream.writeStream.format(kind).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_column: str, window: str, key: str, lateness: str) -> DataFrame:
    """Events per tumbling window and key; later ones than the watermark are dropped."""
    return stream.withWatermark(time_column, lateness).groupBy(F.window(time_column, window), key).agg(F.count(F.lit(1)).alias("events"))


def run_bounded(stream: DataFrame, handle, checkpoint: str, budget: Budget) -> str:
    """Hand each micro-batch to ``handle(frame, number)``; the budget is checked before each one.

    Returns why it ended. A batch that was not handled is not marked as done and comes again.
    """
    began, done, reason = time.monotonic(), 0, ["finished"]

    class Stop(Exception):
        pass

    def batch(frame: DataFrame, number: int) -> None:
        nonlocal done
        if why := budget.spent(done, began):
            reason[0] = why
            raise Stop(why)
        handle(frame, number)
        done += 1

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if reason[0] == "finished":
            raise
    return reason[0]
