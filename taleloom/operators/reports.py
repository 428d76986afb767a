"""Reports over experiments: cells of diversity, sweeps, selection bias, paired arms, ends of a series, filter summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.operators.expstats import regime

DIVERSITY = ("distinct_1", "distinct_2", "distinct_3", "vocabulary_fraction")


def diversity_means(rows: DataFrame, keys: list[str], measures: tuple[str, ...] = DIVERSITY) -> DataFrame:
    """Mean of each measure per cell, and the number of corpora in it."""
    return rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("corpora"))


def sweep_regimes(rows: DataFrame, temperature: Column, top_k: Column) -> DataFrame:
    """``(place, temperature, regime)`` of the different sampling regimes, by temperature, then by name."""
    found = rows.select(F.coalesce(temperature, F.lit(1.0)).alias("temperature"), regime(temperature, top_k).alias("regime")).distinct()
    return found.select(F.row_number().over(Window.orderBy("temperature", "regime")).alias("place"), "temperature", "regime")


def selection_bias(rows: DataFrame, seed: str, selected: str, fresh: str, stopped: str) -> DataFrame:
    """How much better a loop looks on the split it selects on: per seed and, with a null seed, the mean of all.

    ``stopped`` is why the seed's loop ended; those that ran out of a budget are marked ``truncated``.
    """
    gap = F.col(fresh) - F.col(selected)
    truncated = F.coalesce(F.col(stopped).contains("exhausted"), F.lit(False))
    per = rows.select(F.col(seed).alias("seed"), gap.alias("gap"), truncated.alias("truncated"))
    mean = per.agg(F.lit(None).cast(dict(per.dtypes)["seed"]).alias("seed"), F.avg("gap").alias("gap"), F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"))
    return per.unionByName(mean)


def paired_arms(rows: DataFrame, arm: str, seed: str, value: str, first: str, second: str) -> DataFrame:
    """``(seed, first, second, difference)`` of the seeds that both arms have; several runs of a seed count by their mean."""
    means = rows.where(F.col(arm).isin(first, second) & F.col(seed).isNotNull() & F.col(value).isNotNull()).groupBy(seed).agg(
        *[F.avg(F.when(F.col(arm) == name, F.col(value))).alias(column) for name, column in ((first, "first"), (second, "second"))]
    )
    return means.where("first is not null and second is not null").withColumn("difference", F.col("first") - F.col("second"))


def series_ends(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, first, last, best)`` of the values that are there, in order; the largest is the best, and of equal places the larger value holds."""
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(order).isNotNull())
    return held.groupBy(key).agg(
        F.min(F.struct(F.col(order).alias("at"), (-F.col(value)).alias("minus")))["minus"].alias("minus"),
        F.max(F.struct(F.col(order).alias("at"), F.col(value).alias("value")))["value"].alias("last"),
        F.max(value).alias("best"),
    ).select(key, (-F.col("minus")).alias("first"), "last", "best")


def filter_summary(stages: DataFrame, rejections: DataFrame) -> DataFrame:
    """One row of a curation: documents in and kept, removed ones and their share, by stage and by reason; both frames have a few rows."""
    ends = stages.agg(
        F.min_by("remaining", "at").alias("input"), F.max_by("remaining", "at").alias("kept"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "removed")))).alias("by_stage"),
    )
    reasons = rejections.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "documents")))).alias("rejections"))
    removed = F.col("input") - F.col("kept")
    share = F.coalesce(F.try_divide(removed, F.col("input")), F.lit(0.0))
    return ends.withColumn("removed", removed).withColumn("removed_fraction", share).crossJoin(reasons)


def top_by_magnitude(rows: DataFrame, key: str, name: str, value: str, top: int) -> DataFrame:
    """``(key, place, name, value)``: of each key the entries that are farthest from 0; ties go to the smaller name."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs(value)), name)
    return rows.where(F.col(value).isNotNull()).select(key, F.row_number().over(order).alias("place"), name, value).where(F.col("place") <= top)
