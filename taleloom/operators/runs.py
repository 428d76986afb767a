"""Experiment runs: the index of run directories, metric rows, leaderboards and seed groups."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the run table and their types.
RUN_SCHEMA = (
    "run_id STRING, name STRING, path STRING, started_at STRING, git_sha STRING, git_dirty INT, rung STRING, seed BIGINT, steps BIGINT, "
    "batch_size BIGINT, seq_len BIGINT, d_model BIGINT, n_layer BIGINT, n_head BIGINT, vocab_size BIGINT, lr DOUBLE, params_total BIGINT, "
    "params_non_embedding BIGINT, tokenizer STRING, best_step BIGINT, best_bpb DOUBLE, best_loss DOUBLE, final_train_loss DOUBLE, "
    "tokens_per_sec DOUBLE, wall_clock DOUBLE"
)
def _documents(spark: SparkSession, runs_dir: str, file: str) -> DataFrame:
    """``(run_id, text)`` of one file of every run directory that holds it."""
    folder, _, name = file.rpartition("/")
    inner = re.escape(folder) + "/" if folder else ""
    place = rf"/{re.escape(PurePath(runs_dir).name)}/([^/]+)/{inner}{re.escape(name)}$"
    files = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).option("wholetext", True).text(runs_dir)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), place, 1).alias("run_id"), F.col("value").alias("text")).where("run_id <> ''")


def metric_lines(spark: SparkSession, runs_dir: str) -> DataFrame:
    """``(run_id, line, text)`` of every line of every run's metrics; lines are ordered by their place in the file, also in one that is split."""
    place = rf"/{re.escape(PurePath(runs_dir).name)}/([^/]+)/metrics\.jsonl$"
    lines = spark.read.option("pathGlobFilter", "metrics.jsonl").option("recursiveFileLookup", True).text(runs_dir)
    return lines.select(
        F.regexp_extract(F.col("_metadata.file_path"), place, 1).alias("run_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        F.col("value").alias("text"),
    ).where("run_id <> ''")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``(run_id, line, m)``: the keys of every line with their typed values; blank and corrupt lines are dropped."""
    return lines.where(F.trim("text") != "").select("run_id", "line", F.from_json("text", "map<string,variant>").alias("m")).where("m is not null")


def _number(value: Column) -> Column:
    """The number a JSON value is; true and false count as 1 and 0, a string is none."""
    kind = F.schema_of_variant(value)
    numeric = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))


def metrics_table(parsed: DataFrame) -> DataFrame:
    """Attribute-value rows of all numeric keys but the step; booleans count as 1 and 0."""
    step = F.try_variant_get(F.element_at("m", "step"), "$", "bigint")
    rows = parsed.select("run_id", step.alias("step"), F.explode("m").alias("key", "v")).where("key <> 'step'")
    return rows.select("run_id", "step", "key", _number(F.col("v")).alias("value")).where("value is not null")


def assemble(config: DataFrame, manifest: DataFrame, best: DataFrame, parsed: DataFrame, runs_dir: str) -> DataFrame:
    """The run table from ``(run_id, text)`` of the three files and the parsed lines.

    A run without a config and a manifest that hold anything is no run; absent and corrupt files give nulls.
    What is empty or 0 falls back: the name to that of the directory, the rung to that of the best checkpoint, the sequence length
    to that of the training. Loss is that of the last line with a loss; speed and time are those of the last such lines that have them.
    """
    files = [
        f.groupBy("run_id").agg(F.max("text").alias("text")).select("run_id", F.try_parse_json("text").alias(name))
        for f, name in ((config, "config"), (manifest, "manifest"), (best, "best"))
    ]
    with_loss = parsed.where(F.map_contains_key("m", "loss"))

    def last(key: str) -> Column:
        return F.max_by(_number(F.element_at("m", key)), F.when(F.map_contains_key("m", key), F.col("line")))

    ends = with_loss.groupBy("run_id").agg(last("loss").alias("final_train_loss"), last("tokens_per_sec").alias("tokens_per_sec"), last("elapsed").alias("wall_clock"))
    joined = files[0].join(files[1], "run_id", "full").join(files[2], "run_id", "left").join(ends, "run_id", "left")
    holds = lambda c: F.coalesce(~F.to_json(c).isin("{}", "null"), F.lit(False))

    def value(file: str, path: str, kind: str) -> Column:
        return F.try_variant_get(F.col(file), f"$.{path}", kind)

    whole = lambda file, path: F.nullif(value(file, path, "bigint"), F.lit(0))
    text = lambda file, path: F.nullif(value(file, path, "string"), F.lit(""))
    return joined.where(holds(F.col("config")) | holds(F.col("manifest"))).select(
        "run_id",
        F.coalesce(text("config", "training.name"), F.regexp_replace("run_id", "^(?:[^-]*-){1,2}", "")).alias("name"),
        F.concat(F.lit(runs_dir.rstrip("/") + "/"), F.col("run_id")).alias("path"),
        value("manifest", "started_at", "string").alias("started_at"),
        value("manifest", "git.sha", "string").alias("git_sha"),
        F.coalesce(value("manifest", "git.dirty", "boolean").cast("int"), F.lit(0)).alias("git_dirty"),
        F.coalesce(text("config", "training.rung"), value("best", "rung", "string")).alias("rung"),
        *[value("config", f"training.{c}", "bigint").alias(c) for c in ("seed", "steps", "batch_size")],
        F.coalesce(whole("config", "model.seq_len"), value("config", "training.seq_len", "bigint")).alias("seq_len"),
        *[value("config", f"model.{c}", "bigint").alias(c) for c in ("d_model", "n_layer", "n_head", "vocab_size")],
        value("config", "training.lr", "double").alias("lr"),
        value("manifest", "parameters.total", "bigint").alias("params_total"),
        value("manifest", "parameters.non_embedding", "bigint").alias("params_non_embedding"),
        value("manifest", "tokenizer_fingerprint", "string").alias("tokenizer"),
        value("best", "step", "bigint").alias("best_step"),
        value("best", "val_bpb", "double").alias("best_bpb"),
        value("best", "val_loss", "double").alias("best_loss"),
        "final_train_loss", "tokens_per_sec", "wall_clock",
    )


def build_index(spark: SparkSession, runs_dir: str) -> tuple[DataFrame, DataFrame]:
    """The run table and the metric rows of a folder of run directories."""
    parsed = parsed_lines(metric_lines(spark, runs_dir))
    files = [_documents(spark, runs_dir, f) for f in ("config.yaml", "manifest.json", "checkpoints/best.json")]
    return assemble(*files, parsed, runs_dir), metrics_table(parsed)


def register(frame_by_name: dict[str, DataFrame]) -> None:
    """Make tables known by name to ad-hoc SQL of their session."""
    for name, frame in frame_by_name.items():
        frame.createOrReplaceTempView(name)


def latest_run(runs: DataFrame) -> DataFrame:
    """The run whose id is last in order; ids begin with their time."""
    return runs.orderBy(F.desc("run_id")).limit(1)


def comparison_table(groups: DataFrame) -> DataFrame:
    """Seed groups from the best mean, with their place and whether a single seed stands for them."""
    ranked = groups.select("label", "mean", "std", "spread", "n", "values", (F.col("n") == 1).alias("single_seed"))
    return ranked.orderBy("mean", "label")


def label(name: Column) -> Column:
    """A run's name without its seed suffix."""
    return F.regexp_replace(name, "-s[0-9]+$", "")


def seed_groups(runs: DataFrame, metric: str = "best_bpb", group_by: str = "name", name_like: str | None = None, strip_seed_suffix: bool = True) -> DataFrame:
    """``(label, n, mean, std, sem, spread, values)``; the deviation of a single run is 0."""
    rows = runs.where(F.col(metric).isNotNull() & F.col(group_by).isNotNull())
    if name_like is not None:
        rows = rows.where(F.col("name").ilike(name_like))
    key = label(F.col(group_by)) if strip_seed_suffix else F.col(group_by)
    value = F.col(metric).cast("double")
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return rows.groupBy(key.alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        std.alias("std"),
        (std / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        (F.max(value) - F.min(value)).alias("spread"),
        F.sort_array(F.collect_list(value)).alias("values"),
    )


def noise_floor(groups: DataFrame) -> DataFrame:
    """The deviation of the largest group, null below two runs; ties go to the smaller label."""
    top = groups.orderBy(F.desc("n"), "label").limit(1)
    return top.select("label", "n", F.when(F.col("n") >= 2, F.col("std")).alias("floor"))


def leaderboard(runs: DataFrame, metric: str = "best_bpb", limit: int = 25) -> DataFrame:
    """The best runs by a metric where lower is better; ties by run id."""
    return runs.where(F.col(metric).isNotNull()).orderBy(F.asc(metric), "run_id").limit(limit).select("run_id", "name", "rung", "seed", metric)


def best_so_far(metrics: DataFrame, key: str = "val_bpb") -> DataFrame:
    """Every step of a metric with the best value up to it and whether it improved."""
    rows = metrics.where((F.col("key") == key) & F.col("value").isNotNull() & ~F.isnan("value") & F.col("step").isNotNull())
    per_step = rows.groupBy("run_id", "step").agg(F.min("value").alias("value"))
    order = Window.partitionBy("run_id").orderBy("step")
    best = F.min("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.min("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return per_step.select("run_id", "step", "value", best.alias("best"), (before.isNull() | (F.col("value") < before)).alias("improved"))


def last_values(metrics: DataFrame) -> DataFrame:
    """The value of each metric of a run at its last step; ties go to the larger value."""
    rows = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("step").isNotNull())
    return rows.groupBy("run_id", "key").agg(F.max(F.struct("step", "value")).alias("m")).select("run_id", "key", "m.step", "m.value")
