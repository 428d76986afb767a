"""Filling containers of fixed capacity with items, by hierarchical residual packing.

Round 0 packs every input partition locally (best fit, largest first) without a shuffle;
nearly full bins are final, underfull ones become items of the next round. Each further
round deals the underfull bins of a container into groups of bounded size and packs each group again,
until one group is left, which is packed as a whole, or a round saves that container no more than LEAST_SAVED of its bins. Each container goes
its own way.

Defined results: an item larger than the capacity is divided into full pieces and one
remainder, any other item stays whole; an item of size 0 or null is assigned with length
0; an item without an id keeps a null id; repeated rows are items of their own; an empty table gives no rows. The input's extra
columns are not read. Bin ids are unique within a container name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.session import cut

#: Items packed together at most in one local step, and underfull bins in one later group.
LOCAL_ITEMS = 200_000
GROUP_BINS = 20_000
#: A bin filled to this share is final.
NEARLY_FULL = 0.995
#: Share of the waiting bins that a round must save to be followed by another.
LEAST_SAVED = 0.02
#: A null id on its way: no id of a table, as it is the least number there is.
NO_ID = -(1 << 63)

BIN_SCHEMA = (
    "container int, bin_id bigint, used int, unfinished boolean, "
    "item_ids array<bigint>, starts array<int>, lengths array<int>"
)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, taken in the given order; each goes where least room is left.

    Open bins are stacked by residual; a bit mask of the residuals in use finds the smallest
    that is large enough. Sizes lie in 1..capacity.
    """
    stacks: dict[int, list[int]] = {}
    mask, bins, out = 0, 0, []
    for size in sizes:
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            chosen = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, chosen, bins = capacity, bins, bins + 1
        left = room - size
        if left:
            stacks.setdefault(left, []).append(chosen)
            mask |= 1 << left
        out.append(chosen)
    return out


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _bins(container: int, first_id: int, used, unfinished, ids, starts, lengths, ends) -> pa.RecordBatch:
    n = len(used)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, container, np.int32)),
            pa.array(np.arange(first_id, first_id + n, dtype=np.int64)) if np.isscalar(first_id) else pa.array(first_id),
            pa.array(np.asarray(used, np.int32)),
            pa.array(np.asarray(unfinished, bool)),
            _lists(np.asarray(ids, np.int64), ends),
            _lists(np.asarray(starts, np.int32), ends),
            _lists(np.asarray(lengths, np.int32), ends),
        ],
        ["container", "bin_id", "used", "unfinished", "item_ids", "starts", "lengths"],
    )


def pack_local(container: int, capacity: int, ids: np.ndarray, sizes: np.ndarray, first_id: int) -> pa.RecordBatch:
    """Pack one block of items: whole pieces of oversized items first, then best fit on the rest."""
    full, rest = sizes // capacity, sizes % capacity
    owner = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    order = np.lexsort((ids, -rest))
    order = order[rest[order] > 0]
    chosen = np.asarray(best_fit(rest[order].tolist(), capacity), np.int64) + len(owner)
    empty = np.flatnonzero(sizes == 0)
    bins = len(owner) + (int(chosen.max()) + 1 - len(owner) if len(chosen) else 0)
    if len(empty) and not bins:
        bins = 1
    spot = np.arange(len(empty)) % max(1, bins)
    at = np.concatenate([np.arange(len(owner)), chosen, spot])
    item = np.concatenate([owner, order, empty])
    start = np.concatenate([piece * capacity, full[order] * capacity, np.zeros(len(empty), np.int64)])
    length = np.concatenate([np.full(len(owner), capacity), rest[order], np.zeros(len(empty), np.int64)])
    by = np.argsort(at, kind="stable")
    used = np.bincount(at, weights=length, minlength=bins).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=bins))])
    return _bins(container, first_id, used, used < NEARLY_FULL * capacity, ids[item[by]], start[by], length[by], ends)


def merge_bins(table: pa.Table, capacity: int) -> pa.Table:
    """Pack underfull bins as items of their used size; a merged bin keeps its first member's id."""
    table = table.combine_chunks()
    used = table["used"].to_numpy()
    bin_ids = table["bin_id"].to_numpy()
    order = np.lexsort((bin_ids, -used))
    chosen = np.asarray(best_fit(np.maximum(used[order], 1).tolist(), capacity), np.int64)
    by = order[np.argsort(chosen, kind="stable")]
    group = np.sort(chosen)
    rows = table.take(pa.array(by))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    total = np.add.reduceat(used[by], first) if len(first) else np.zeros(0, np.int64)
    counts = np.asarray(rows["item_ids"].combine_chunks().value_lengths())
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, first))]) if len(first) else np.zeros(1, np.int64)
    flat = [rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("item_ids", "starts", "lengths")]
    container = int(table["container"][0].as_py())
    batch = _bins(container, bin_ids[by][first], total, total < NEARLY_FULL * capacity, *flat, ends)
    return pa.Table.from_batches([batch])


def pack(items: DataFrame, containers: list[tuple[str, int]], id_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """``(container_name, bin_id, item id, start, length)``: one row per piece of each item and container."""
    if any(capacity is None or capacity <= 0 for _, capacity in containers):
        raise ValueError("a capacity must be positive")
    capacities = [capacity for _, capacity in containers]
    sizes = items.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.greatest(F.lit(0), F.coalesce(F.col(size_column), F.lit(0))).cast("int").alias("size"),
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = [TaskContext.get().partitionId() << 40] * len(capacities)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids, size = table["id"].fill_null(NO_ID).to_numpy(), table["size"].to_numpy().astype(np.int64)
            for k, capacity in enumerate(capacities):
                out = pack_local(k, capacity, ids, size, next_id[k])
                next_id[k] += out.num_rows
                yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LOCAL_ITEMS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    state = cut(sizes.mapInArrow(local, BIN_SCHEMA))
    parts, waiting, before, level = [state.where(~F.col("unfinished"))], state.where("unfinished"), {}, 0
    while True:
        counts = {r["container"]: r["count"] for r in waiting.groupBy("container").count().collect()}
        done = [k for k, n in counts.items() if k in before and n > (1 - LEAST_SAVED) * before[k]]
        going = {k: n for k, n in counts.items() if k not in done}
        if done:
            parts.append(waiting.where(F.col("container").isin(done)))
        if not going:
            break
        groups = F.lit(1)
        for k, n in going.items():
            groups = F.when(F.col("container") == k, F.lit(math.ceil(n / GROUP_BINS))).otherwise(groups)
        dealt = waiting.where(F.col("container").isin(list(going))).withColumn("part", F.pmod(F.xxhash64("bin_id", F.lit(level)), groups).cast("int"))

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            return merge_bins(table.drop_columns(["part"]), capacities[key[0].as_py()])

        merged = dealt.groupBy("container", "part").applyInArrow(merge, BIN_SCHEMA)
        if max(going.values()) <= GROUP_BINS:
            parts.append(merged)
            break
        merged = cut(merged)
        last = [k for k, n in going.items() if n <= GROUP_BINS]
        over = F.col("unfinished") & ~F.col("container").isin(last) if last else F.col("unfinished")
        parts.append(merged.where(~over))
        waiting, before, level = merged.where(over), going, level + 1

    bins = parts[0]
    for part in parts[1:]:
        bins = bins.unionByName(part)
    names = F.array(*[F.lit(name) for name, _ in containers])
    return bins.select(
        F.element_at(names, F.col("container") + 1).alias("container_name"),
        "bin_id",
        F.explode(F.arrays_zip("item_ids", "starts", "lengths")).alias("piece"),
    ).select(
        "container_name",
        "bin_id",
        F.nullif(F.col("piece.item_ids"), F.lit(NO_ID)).alias(id_column),
        F.col("piece.starts").alias("start"),
        F.col("piece.lengths").alias("length"),
    )


def usage(assignments: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """Bins, tokens and unused share of each container."""
    capacity = F.create_map(*[F.lit(x) for name, cap in containers for x in (name, cap)])
    per = assignments.groupBy("container_name", "bin_id").agg(F.sum("length").alias("used"))
    return per.groupBy("container_name").agg(
        F.count(F.lit(1)).alias("bins"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
    ).withColumn("unused_share", 1 - F.col("tokens") / (F.col("bins") * capacity[F.col("container_name")]))
