"""A hash-chained log: each entry's digest covers its index, the digest before and its payload."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(payload: dict) -> str:
    """Sorted keys, no blanks, ASCII only: the form that is hashed and stored."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def append(entries: list[dict], payload: dict) -> dict:
    """The next entry; a chain is written one entry after the other."""
    prev, index = (entries[-1]["digest"], entries[-1]["index"] + 1) if entries else (GENESIS, 0)
    text = canonical(payload)
    digest = hashlib.sha256(f"{index}|{prev}|{text}".encode()).hexdigest()
    return {"index": index, "prev": prev, "digest": digest, "payload": text}


def link(rows: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """Chains built from rows: a task streams its chains in order and holds one digest; a null payload is empty."""
    kind = dict(rows.dtypes)[chain]
    ordered = rows.select(F.col(chain).alias("chain"), F.col(order).alias("at"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, last = object(), 0, GENESIS
        for batch in batches:
            out = []
            for name, text in zip(batch["chain"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                if name != current:
                    current, index, last = name, 0, GENESIS
                digest = hashlib.sha256(f"{index}|{last}|{text}".encode()).hexdigest()
                out.append((index, last, digest))
                index, last = index + 1, digest
            columns = list(zip(*out, strict=True)) or [[], [], []]
            arrays = [batch["chain"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), batch["payload"]]
            yield pa.RecordBatch.from_arrays(arrays, ["chain", "index", "prev", "digest", "payload"])

    linked = ordered.repartition("chain").sortWithinPartitions("chain", "at", "payload").mapInArrow(run, f"chain {kind}, index bigint, prev string, digest string, payload string")
    return linked.withColumnRenamed("chain", chain)


def verify(entries: DataFrame, chain: str) -> DataFrame:
    """``(chain, entries, intact, first_break, problem)``: per entry an index gap, then the link, then the digest."""
    order = Window.partitionBy(chain).orderBy("index", "digest")
    place = F.row_number().over(order) - 1
    checked = entries.select(
        chain, "index", "prev", "digest", "payload", place.alias("place"),
        F.lag("digest", 1, GENESIS).over(order).alias("expected"),
    )
    problem = (
        F.when(F.col("index") != F.col("place"), "index")
        .when(F.col("prev") != F.col("expected"), "prev")
        .when(F.col("digest") != F.sha2(F.concat_ws("|", F.col("index").cast("string"), "prev", "payload"), 256), "digest")
    )
    first = F.min(F.when(problem.isNotNull(), F.struct(F.col("place").cast("bigint").alias("at"), problem.alias("problem"))))
    found = checked.groupBy(chain).agg(F.count(F.lit(1)).alias("entries"), first.alias("b"))
    return found.select(chain, "entries", F.col("b").isNull().alias("intact"), F.col("b.at").alias("first_break"), F.col("b.problem").alias("problem"))
