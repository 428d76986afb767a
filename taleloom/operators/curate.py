"""Corpus curation: identity, splits, exact duplicates, quality filters, statistics, leakage.

Every "first" follows an explicit order column; nothing depends on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions import text as T

REASONS = ("too_short", "too_long", "too_few_words", "repetitive_lines", "mostly_non_alphabetic", "control_characters")


@dataclass(frozen=True)
class QualityFilters:
    min_chars: int = 16
    max_chars: int | None = None
    min_words: int = 3
    max_line_repeat_ratio: float = 0.5
    max_non_alpha_ratio: float = 0.6
    require_printable: bool = True


def document_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_of(digest: Column, val_permille: int = 10, test_permille: int = 10) -> Column:
    """A split by content: equal texts always share it, and growth does not move a document."""
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000
    return F.when(bucket < val_permille, "val").when(bucket < val_permille + test_permille, "test").otherwise("train")


def curated_columns(documents: DataFrame, source: Column | None = None) -> DataFrame:
    """The curated schema: id, text, source, chars, bytes, words, split."""
    hashed = documents.where(F.col("text").isNotNull()).withColumn("digest", document_hash(F.col("text")))
    return hashed.select(
        F.substring("digest", 1, 16).alias("id"),
        "text",
        (F.lit("unknown") if source is None else source).alias("source"),
        F.length("text").cast("bigint").alias("chars"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        T.word_count(F.col("text")).cast("bigint").alias("words"),
        split_of(F.col("digest")).alias("split"),
    )


def write_curated(curated: DataFrame, path: str) -> None:
    """Parquet with zstd, one folder per split, so that reading a split prunes the others."""
    curated.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def read_curated(spark, path: str, split: str | None = None) -> DataFrame:
    """Texts in id order."""
    frame = spark.read.parquet(path)
    if split is not None:
        frame = frame.where(F.col("split") == split)
    return frame.orderBy("id", "text").select("text")


def reject_reason(text: Column, filters: QualityFilters = QualityFilters()) -> Column:
    """The first failing filter, or null; the order of the filters is fixed."""
    length = F.length(text)
    lines = T.lines(text)
    repeated = (F.size(lines) > 2) & (
        T.longest_run(F.array_sort(lines)) / F.size(lines) > filters.max_line_repeat_ratio
    )
    kept = F.length(F.regexp_replace(text, r"[^\p{L}" + T.BLANKS + "]", "")) / length
    reason = F.when(length < filters.min_chars, "too_short")
    if filters.max_chars is not None:
        reason = reason.when(length > filters.max_chars, "too_long")
    reason = reason.when(T.word_count(text) < filters.min_words, "too_few_words")
    reason = reason.when(repeated, "repetitive_lines").when(kept < 1.0 - filters.max_non_alpha_ratio, "mostly_non_alphabetic")
    return reason.when(text.rlike(T.CONTROL), "control_characters") if filters.require_printable else reason


def exact_dedup(documents: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first document of each text and the number of copies; combined before the shuffle.

    The key is the digest, so the shuffle of a hot text carries one row per task.
    """
    rows = documents.where(F.col("text").isNotNull())
    return rows.groupBy(document_hash(F.col("text")).alias("digest")).agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("copies")
    )


def corpus_stats(curated: DataFrame) -> DataFrame:
    """One row of counts, sums and quantiles; distinctness is that of the 16-digit id."""
    total = curated.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("bytes").alias("bytes"),
        F.sum("words").alias("words"),
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        F.avg("chars").alias("mean_chars"),
        F.percentile("chars", F.lit(0.5)).alias("median_chars"),
        F.percentile("chars", F.lit(0.95)).alias("p95_chars"),
        F.countDistinct("id").alias("distinct_documents"),
    )
    return total.withColumn("duplicates", F.col("documents") - F.col("distinct_documents"))


def leakage(curated: DataFrame) -> DataFrame:
    """Texts that stand in two splits, for every pair of splits that shares any."""
    sides = curated.groupBy("id").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    pairs = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size("splits") - 1),
                lambda i: F.transform(
                    F.slice("splits", i + 1, F.size("splits")),
                    lambda b: F.struct(F.element_at("splits", i).alias("split_a"), b.alias("split_b")),
                ),
            )
        )
    )
    return sides.select(pairs.alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("shared"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows left and removed after each named stage."""
    out = None
    for at, (name, frame) in enumerate(stages):
        row = frame.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(at).alias("at"), F.lit(name).alias("stage"), "remaining")
        out = row if out is None else out.unionByName(row)
    first = stages[0][1].agg(F.count(F.lit(1)).alias("input"))
    from pyspark.sql import Window

    order = Window.orderBy("at")  # one row per stage
    return out.crossJoin(first).select(
        "at", "stage", "remaining",
        (F.coalesce(F.lag("remaining").over(order), F.col("input")) - F.col("remaining")).alias("removed"),
        F.when(F.col("input") > 0, 100.0 * (F.col("input") - F.col("remaining")) / F.col("input")).alias("removed_percent"),
    )
