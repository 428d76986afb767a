"""Compact postings: (key, record) pairs that travel as sorted, compressed blocks.

A pair costs a few bytes in a shuffle instead of a row of thirty and more: within a block the keys
are sorted and stored as differences, and all numbers are split into byte planes before
compression. Buckets grow with the input, so that one bucket stays a few million postings; a task
takes its buckets one after the other. What collides makes a candidate too many, which the check on
the words removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.session import scan_bytes

BLOCK_SCHEMA = "bucket int, kind int, n int, payload binary"
KEY_BITS = np.uint64(32)
#: Input bytes (as stored) for which one bucket is made.
BUCKET_BYTES = 4 << 20
#: Sizes from which an estimate is no measure of files, and how much smaller texts are stored than they are.
UNKNOWN_BYTES = 1 << 60
STORED_SHARE = 0.4
MOST_BUCKETS = 1 << 26
MOST_TASKS = 100_000


def stored_bytes(source: DataFrame, text: str = "text") -> int:
    """Bytes of the files of a plain scan; for any other plan they are estimated from the lengths of its texts."""
    size = scan_bytes(source)
    if size < UNKNOWN_BYTES:
        return size
    return int(STORED_SHARE * (source.agg(F.sum(F.octet_length(text))).first()[0] or 0))


def bucket_count(source: DataFrame, size: int | None = None) -> int:
    """Buckets follow the input's stored size."""
    least = 2 * source.sparkSession.sparkContext.defaultParallelism
    return min(MOST_BUCKETS, max(least, (stored_bytes(source) if size is None else size) // BUCKET_BYTES))


def squeeze(*columns: np.ndarray) -> bytes:
    """64-bit columns of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(c).astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(payload: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(payload, decompressed_size=8 * n * columns, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def batch_of(buckets: list[int], kinds: list[int], sizes: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", "n", "payload"])


def cut_blocks(bucket: np.ndarray, keys: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    """One block for each bucket, of rows that are in the order of bucket and key."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    cuts = np.append(cuts, len(bucket)).tolist()
    payloads = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step = np.diff(keys[a:b], prepend=np.uint64(0))
        payloads.append(squeeze(step, *(c[a:b] for c in columns)))
    return batch_of(bucket[cuts[:-1]].tolist(), [kind] * len(payloads), np.diff(cuts).tolist(), payloads)


def blocks(keys: np.ndarray, columns: list[np.ndarray], buckets: int, kind: int) -> pa.RecordBatch:
    """Blocks of hashed keys: the bucket comes from the whole hash, 32 bits of it stay as the key."""
    bucket = keys % np.uint64(buckets)
    joint = bucket << KEY_BITS | keys >> (np.uint64(64) - KEY_BITS)
    order = np.argsort(joint)
    joint = joint[order]
    short = joint & ((np.uint64(1) << KEY_BITS) - np.uint64(1))
    return cut_blocks((joint >> KEY_BITS).astype(np.int64), short, [c[order] for c in columns], kind)


def opened(payload: bytes, n: int, columns: int) -> list[np.ndarray]:
    """Keys (ascending) and columns of a block."""
    keys, *rest = unsqueeze(payload, n, columns + 1)
    return [np.cumsum(keys, dtype=np.uint64), *rest]


def gathered(held: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    """Blocks merged in key order."""
    if not held:
        return [np.zeros(0, np.uint64)] * columns
    merged = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(merged[0], kind="stable")
    return [c[order] for c in merged]


def by_bucket(frame: DataFrame, buckets: int) -> DataFrame:
    """All blocks of a bucket in one task, kinds in order, payloads in a fixed order."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(MOST_TASKS, max(least, buckets))
    return frame.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket", "kind", F.xxhash64("payload"))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, kind, n, payload) one by one."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "payload")), strict=True)


def by_bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Each bucket with its ``(kind, n, payload)`` blocks."""
    current, held = None, []
    for bucket, *block in streamed(batches):
        if bucket != current and held:
            yield current, held
            held = []
        current = bucket
        held.append(tuple(block))
    if held:
        yield current, held
