"""Corpora of an experiment's arms: replace, accumulate, control and mixes with real data.

Samples are taken in the order of a digest of seed and id: the same on any cluster, and a larger
sample holds the smaller one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Hex digits that are counted at a time, and keys that are few enough to be sorted.
DIGITS = 4
FEW = 10_000


def smallest_key(keys: DataFrame, wanted: int) -> str | None:
    """The ``wanted``-th smallest of hexadecimal ``_key``s, by counts of ever longer beginnings: at most 16 ** DIGITS rows a round come to the driver."""
    if not wanted:
        return None
    start, left, width = "", wanted, 0
    while True:
        width += DIGITS
        inside = keys.where(F.col("_key").startswith(start))
        for row in sorted(inside.groupBy(F.substring("_key", 1, width).alias("start")).count().collect()):
            if row["count"] >= left:
                break
            left -= row["count"]
        start = row["start"]
        if row["count"] <= FEW or width >= 64:
            found = keys.where(F.col("_key").startswith(start)).orderBy("_key").limit(left)
            return found.agg(F.max("_key")).first()[0]


def hash_sample(documents: DataFrame, fraction: float, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """``int(n * fraction)`` documents, those of the smallest digests; rows are neither sorted nor moved."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")), 256)
    marked = documents.withColumn("_key", key)
    last = smallest_key(marked.select("_key"), int(marked.count() * fraction))
    return (marked.where(F.col("_key") <= F.lit(last)) if last is not None else marked.limit(0)).drop("_key")


def control(real: DataFrame, history: list[DataFrame]) -> DataFrame:
    return real


def replace(real: DataFrame, history: list[DataFrame]) -> DataFrame:
    """Only the latest generation, or the real corpus before there is one."""
    return history[-1] if history else real


def accumulate(real: DataFrame, history: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, history, real)


def anchor(real: DataFrame, history: list[DataFrame], real_fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """A share of real documents and the rest from the latest generation."""
    if not 0 <= real_fraction <= 1:
        raise ValueError("real_fraction must lie in [0, 1]")
    if not history:
        return real
    return hash_sample(real, real_fraction, seed).unionByName(hash_sample(history[-1], 1 - real_fraction, seed))


def corpus(arm: str, real: DataFrame, history: list[DataFrame], **settings) -> DataFrame:
    """The corpus of an arm by its name; an unknown one is an error."""
    if arm not in ARMS:
        raise ValueError(f"no arm {arm!r}; there are {', '.join(sorted(ARMS))}")
    return ARMS[arm](real, history, **settings)


ARMS = {"control": control, "replace": replace, "accumulate": accumulate, "anchor": anchor}


def rejected(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents whose text was not kept; a copy of a kept text is none."""
    return candidates.join(kept.select("text").distinct(), "text", "left_anti")
