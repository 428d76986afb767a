"""Classes of identical texts: work is done once per text and handed back to every copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids up to this number (a few megabytes) are broadcast to pick their rows; more are joined by shuffle.
BROADCAST_IDS = 300_000


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1")]


def distinct_texts(documents: DataFrame, flags: dict[str, Column], min_chars: int = 20) -> DataFrame:
    """``text, rep`` (smallest id), ``copies`` and an OR of each flag; combined before the shuffle."""
    rows = documents.where((F.length("text") >= min_chars) & F.col("doc_id").isNotNull())
    return rows.groupBy("text").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        *[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()],
    )


def members(documents: DataFrame, *extra: Column, min_chars: int = 20) -> DataFrame:
    """``doc_id, rep`` and extra columns of every document; no text is moved."""
    keyed = documents.where((F.length("text") >= min_chars) & F.col("doc_id").isNotNull()).select(
        "doc_id", *extra, *text_keys(F.col("text"))
    )
    reps = keyed.groupBy("k0", "k1").agg(F.min("doc_id").alias("rep"))
    return keyed.join(reps, ["k0", "k1"]).drop("k0", "k1")


def pick(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep, text`` of the documents whose id is in ``ids(rep)``; a short list is broadcast, a long one is not."""
    rows = documents.select(F.col("doc_id").alias("rep"), "text")
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "rep", "left_semi").dropDuplicates(["rep"])
