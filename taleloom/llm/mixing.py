"""Mixing sources to target weights.

Tokens are aggregated per corpus, source and kind (synthetic or not), a repetition rate
is derived for each, and every shard is emitted floor(rate) times plus one copy drawn with the
fraction as probability. The draw is systematic: shards of a source and kind stand in the order of
their sizes, and from a start that a seeded hash of mix, source and kind gives every (1 / fraction)-th one is drawn. So
each shard is drawn with that probability, and the tokens of a source and kind are off by at most its largest shard.

Defined results: a path counts once, null tokens count 0, ``synthetic`` null counts as
not synthetic, a source without shards has 0 tokens. Only shards whose split is ``train``
(ignoring case and blanks) take part. A mix whose weights sum to 0 wants nothing. A null
or missing synthetic fraction leaves the kinds at the share they have in the source. If a mix
occurs in several loop rows the latest ``finished_at`` holds (ties: the larger fraction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.session import cut

#: Positions that one row lists at a time.
CHUNK = 4_096
DIGITS = 9

def train_shards(shards: DataFrame) -> DataFrame:
    """One row per path of the train split: ``corpus, source, path, tokens, synthetic``."""
    return (
        shards.where((F.trim(F.lower("split")) == "train") & F.col("path").isNotNull())
        .groupBy("path")
        .agg(
            F.min("corpus").alias("corpus"),
            F.min("source").alias("source"),
            F.max(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"),
            F.max(F.coalesce("synthetic", F.lit(False))).alias("synthetic"),
        )
    )


def source_tokens(shards: DataFrame) -> DataFrame:
    """Tokens per corpus and source, real and synthetic apart."""
    return train_shards(shards).groupBy("corpus", "source").agg(
        F.sum(F.when(F.col("synthetic"), 0).otherwise(F.col("tokens"))).alias("real_tokens"),
        F.sum(F.when(F.col("synthetic"), F.col("tokens")).otherwise(0)).alias("synthetic_tokens"),
        F.count_if(~F.col("synthetic")).alias("real_shards"),
        F.count_if("synthetic").alias("synthetic_shards"),
    )


def placed_shards(shards: DataFrame) -> DataFrame:
    """``train_shards`` with each shard's place among those of its corpus, source and kind, from the largest, from 1.

    Ranges of the order are numbered by themselves and the sizes of those before are added, so a source with most shards is no
    single task.
    """
    group = ["corpus", "source", "synthetic"]
    order = [*group, F.desc("tokens"), "path"]
    ordered = train_shards(shards).repartitionByRange(*order).sortWithinPartitions(*order)
    # Sorted, so the ids of a group within a partition follow each other.
    numbered = cut(ordered.withColumn("partition", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()))
    runs = numbered.groupBy("partition", *group).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("partition")) - F.col("size")
    offsets = runs.select("partition", *[F.col(c).alias(f"of_{c}") for c in group], "first", before.alias("offset"))
    same = numbered["partition"] == offsets["partition"]
    for c in group:
        same = same & numbered[c].eqNullSafe(offsets[f"of_{c}"])
    place = (F.col("id") - F.col("first") + F.col("offset") + 1).alias("place")
    return numbered.join(offsets, same).select(*group, "path", "tokens", place)


def mix_rates(targets: DataFrame, shards: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """The plan of every mix row: wanted tokens, reachable tokens and a rate for each kind of shard.

    Within the bounds of ``max_repeats`` each source takes its share; between the least and
    the most synthetic tokens it could take, all sources of a mix move by the same fraction so
    that the mix's synthetic share meets the target where it can.
    """
    mix = Window.partitionBy("mix_id")
    weights = targets.groupBy("mix_id").agg(F.sum("weight").alias("weights"))
    want = targets.join(weights, "mix_id").withColumn(
        "wanted",
        F.when(F.col("weights") != 0, F.col("weight") / F.col("weights") * F.col("total_tokens")).otherwise(0.0),
    )
    have = (
        want.join(source_tokens(shards), ["corpus", "source"], "left")
        .fillna(0, ["real_tokens", "synthetic_tokens", "real_shards", "synthetic_shards"])
        .withColumn("available", F.col("real_tokens") + F.col("synthetic_tokens"))
        .withColumn("short", F.col("max_repeats") * F.col("available") < F.col("wanted"))
        .withColumn("taken", F.least("wanted", (F.col("max_repeats") * F.col("available")).cast("double")))
    )
    if loops is None:
        fraction = have.withColumn("synthetic_fraction", F.lit(None).cast("double"))
    else:
        latest = loops.groupBy("mix_id").agg(
            F.max(F.struct("finished_at", F.col("proposal.synthetic_fraction").alias("f")))["f"].alias("synthetic_fraction")
        )
        fraction = have.join(latest, "mix_id", "left")
    least = F.greatest(F.lit(0.0), F.col("taken") - F.col("max_repeats") * F.col("real_tokens"))
    most = F.least("taken", (F.col("max_repeats") * F.col("synthetic_tokens")).cast("double"))
    bounded = fraction.withColumn("least", least).withColumn("most", F.greatest("least", most))
    room = F.sum(F.col("most") - F.col("least")).over(mix)
    wish = F.col("synthetic_fraction") * F.sum("taken").over(mix) - F.sum("least").over(mix)
    step = F.when(room > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), wish / room))).otherwise(0.0)
    natural = F.greatest(
        "least",
        F.least("most", F.when(F.col("available") > 0, F.col("taken") * F.col("synthetic_tokens") / F.col("available")).otherwise(0.0)),
    )
    synthetic = F.when(F.col("synthetic_fraction").isNull(), natural).otherwise(
        F.col("least") + step * (F.col("most") - F.col("least"))
    )
    planned = bounded.withColumn("synthetic_taken", synthetic)

    def rate(taken: Column, tokens: str) -> Column:
        wanted = F.when(F.col(tokens) > 0, F.least(taken / F.col(tokens), F.col("max_repeats").cast("double"))).otherwise(0.0)
        # Rounded, so that the order in which tokens were added up does not matter.
        return F.round(wanted, DIGITS)

    return planned.select(
        "mix_id", "corpus", "source", "weight", "max_repeats", "total_tokens", "wanted", "available",
        "real_tokens", "synthetic_tokens", "real_shards", "synthetic_shards", "short", "taken", "synthetic_fraction", "synthetic_taken",
        rate(F.col("taken") - F.col("synthetic_taken"), "real_tokens").alias("real_rate"),
        rate(F.col("synthetic_taken"), "synthetic_tokens").alias("synthetic_rate"),
    )


def emit(rates: DataFrame, shards: DataFrame, seed: int = 0) -> DataFrame:
    """``(mix_id, source, path, tokens, synthetic, copies)`` of every shard used at least once.

    The draw depends on seed, mix, source, kind and the shards alone, so a repeated task repeats it. Places are
    drawn before shards are joined, so only shards that are used are moved.
    """
    kinds = F.array(*[
        F.struct(F.lit(kind == "synthetic").alias("synthetic"), F.col(f"{kind}_rate").alias("rate"), F.col(f"{kind}_shards").alias("n"))
        for kind in ("real", "synthetic")
    ])
    rows = rates.select("mix_id", "corpus", "source", F.inline(kinds)).where("rate > 0 and n > 0")
    name = F.concat_ws(":", F.lit(str(seed)), "mix_id", "source", F.col("synthetic").cast("string"))
    start = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    whole = rows.withColumn("start", start).withColumn("whole", F.floor("rate")).withColumn("rest", F.col("rate") - F.floor("rate"))
    chunks = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))))
    places = chunks.withColumn("place", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK))))
    drawn = F.floor(F.col("start") + F.col("rest") * F.col("place")) - F.floor(F.col("start") + F.col("rest") * (F.col("place") - 1))
    used = places.withColumn("copies", (F.col("whole") + drawn).cast("int")).where("copies > 0")
    return used.join(placed_shards(shards), ["corpus", "source", "synthetic", "place"]).select(
        "mix_id", "source", "path", "tokens", "synthetic", "copies"
    )


def copies(emitted: DataFrame) -> DataFrame:
    """One row per copy, numbered from 0."""
    return emitted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def shares(rates: DataFrame, emitted: DataFrame) -> DataFrame:
    """Target and reached share of every mix row, and the mix's synthetic share."""
    got = emitted.groupBy("mix_id", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("emitted_tokens"),
        F.sum(F.when(F.col("synthetic"), F.col("copies") * F.col("tokens")).otherwise(0)).alias("emitted_synthetic"),
    )
    mix = Window.partitionBy("mix_id")
    both = rates.join(got, ["mix_id", "source"], "left").fillna(0, ["emitted_tokens", "emitted_synthetic"])
    total = F.sum("emitted_tokens").over(mix)
    return both.select(
        "mix_id", "source", "wanted", "short", "emitted_tokens",
        F.when(F.col("total_tokens") > 0, F.col("wanted") / F.col("total_tokens")).alias("target_share"),
        F.when(total > 0, F.col("emitted_tokens") / total).alias("actual_share"),
        "synthetic_fraction",
        F.when(total > 0, F.sum("emitted_synthetic").over(mix) / total).alias("actual_synthetic_share"),
    )


def short_sources(rates: DataFrame) -> DataFrame:
    return rates.where("short").select("mix_id", "source")
