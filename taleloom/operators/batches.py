"""Batches of token windows: inputs and targets, drawn by seed or in order, cut from shard files where they lie.

Offsets are drawn on the driver (a few numbers per row of a batch); the windows are cut by tasks that each read
whole shard files.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.operators.shards import read_index, sample_offsets, shard_files


def usable_shards(spark: SparkSession, root: str, split: str, seq_len: int) -> tuple[list[tuple[str, int]], str]:
    """``(path, tokens)`` of the shards that hold a window and its targets, in the index's order, and the type of a token."""
    rows = read_index(spark, root).where(F.col("split") == split).select("path", "tokens", "dtype").collect()
    if not rows:
        raise ValueError(f"no split {split!r} with shards in {root}")
    found = [(r["path"], r["tokens"]) for r in rows if r["tokens"] > seq_len]
    if not found:
        raise ValueError(f"a window of {seq_len} and its targets need {seq_len + 1} tokens; the largest shard of {split!r} has {max(r['tokens'] for r in rows)}")
    return found, rows[0]["dtype"]


def _lists(windows: np.ndarray) -> list[pa.Array]:
    """Inputs and targets, of windows with one token more than inputs."""
    n, width = windows.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * (width - 1))
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).ravel())) for part in (windows[:, :-1], windows[:, 1:])]


def seeded_batches(spark: SparkSession, root: str, split: str, seq_len: int, batch_size: int, steps: int, seed: int) -> DataFrame:
    """``(step, row, x, y)``: the same seed gives the same batches. Shards are drawn by their tokens, starts evenly within them."""
    shards, dtype = usable_shards(spark, root, split, seq_len)
    drawn = sample_offsets([n for _, n in shards], seq_len, batch_size, steps, seed)
    columns = np.array(drawn, np.int64).reshape(-1, 4).T
    paths = pa.array([path for path, _ in shards]).take(pa.array(columns[2]))
    offsets = spark.createDataFrame(pa.table({"step": columns[0].astype(np.int32), "row": columns[1].astype(np.int32), "path": paths, "start": columns[3]}))
    # One row for each shard file, so a file is read once whatever is drawn from it.
    wanted = offsets.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "step", "row"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, cuts in zip(batch["content"], batch["wanted"].to_pylist(), strict=True):
                tokens = np.frombuffer(content.as_buffer(), dtype)
                for at in range(0, len(cuts), 1_024):
                    part = cuts[at : at + 1_024]
                    starts = np.array([c["start"] for c in part])
                    x, y = _lists(tokens[starts[:, None] + np.arange(seq_len + 1)].astype(np.int64))
                    steps_of, rows_of = (pa.array([c[k] for c in part], pa.int32()) for k in ("step", "row"))
                    yield pa.RecordBatch.from_arrays([steps_of, rows_of, x, y], ["step", "row", "x", "y"])

    return shard_files(spark, root, split).join(wanted, "path").select("content", "wanted").mapInArrow(run, "step int, row int, x array<bigint>, y array<bigint>")


def sequential_batches(spark: SparkSession, root: str, split: str, seq_len: int, batch_size: int) -> DataFrame:
    """``(path, batch, row, x, y)``: every token once as an input, in order; the tail that fills no window is left out."""
    _, dtype = usable_shards(spark, root, split, seq_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                tokens = np.frombuffer(content.as_buffer(), dtype)
                count = (len(tokens) - 1) // seq_len if len(tokens) > seq_len else 0
                for at in range(0, count, 1_024):
                    windows = np.arange(at, min(count, at + 1_024))
                    x, y = _lists(tokens[windows[:, None] * seq_len + np.arange(seq_len + 1)].astype(np.int64))
                    arrays = [pa.array([path] * len(windows)), pa.array((windows // batch_size).astype(np.int32)), pa.array((windows % batch_size).astype(np.int32)), x, y]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "batch", "row", "x", "y"])

    return shard_files(spark, root, split).mapInArrow(run, "path string, batch int, row int, x array<bigint>, y array<bigint>")


def throughput(spark: SparkSession, root: str, split: str, seq_len: int, batch_size: int, steps: int = 50, seed: int = 0) -> dict[str, float]:
    """Tokens and batches a second and milliseconds a batch of seeded batches, after one run to warm up."""
    def once() -> None:
        seeded_batches(spark, root, split, seq_len, batch_size, steps, seed).write.format("noop").mode("overwrite").save()

    once()
    began = time.perf_counter()
    once()
    took = time.perf_counter() - began
    return {"tokens_per_sec": steps * batch_size * seq_len / took, "batches_per_sec": steps / took, "ms_per_batch": 1000 * took / steps}
