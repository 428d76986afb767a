"""Metrics over stored logits and token sequences, as array expressions and windows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG2 = math.log(2.0)


def _add(s: Column, v: Column) -> Column:
    return s + v


def log_softmax(logits: Column) -> Column:
    """Shifted by the maximum, so large logits do not overflow.

    Scalars enter as repeated arrays: inside a lambda they would be computed for every element.
    """
    wide = F.transform(logits, lambda x: x.cast("double"))
    shifted = F.zip_with(wide, F.array_repeat(F.array_max(wide), F.size(logits)), lambda x, top: x - top)
    norm = F.ln(F.aggregate(F.transform(shifted, F.exp), F.lit(0.0), _add))
    return F.zip_with(shifted, F.array_repeat(norm, F.size(logits)), lambda x, n: x - n)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of one prediction, in nats."""
    return -F.element_at(log_softmax(logits), target + 1)


def mean_squared_error(a: Column, b: Column) -> Column:
    """Of two arrays of one length; an empty pair has none."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.try_divide(F.aggregate(squares, F.lit(0.0), _add), F.size(a))


def surprisal_bits(log_probs: Column, target: Column) -> Column:
    return -F.element_at(log_probs, target + 1) / LOG2


def entropy_bits(log_probs: Column) -> Column:
    return -F.aggregate(F.transform(log_probs, lambda x: F.exp(x) * x), F.lit(0.0), _add) / LOG2


def rank(log_probs: Column, target: Column) -> Column:
    """1 and the number of strictly likelier tokens."""
    actual = F.array_repeat(F.element_at(log_probs, target + 1), F.size(log_probs))
    above = F.zip_with(log_probs, actual, lambda x, a: (x > a).cast("int"))
    return F.aggregate(above, F.lit(0), _add) + 1


def top_k(log_probs: Column, k: int) -> Column:
    """The k likeliest tokens with their probabilities; ties go to the smaller id."""
    pairs = F.transform(log_probs, lambda x, i: F.struct((-x).alias("minus"), i.alias("token")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["token"].alias("token"), F.exp(-p["minus"]).alias("probability")))


def top_k_mask(logits: Column, k: int, temperature: float = 1.0) -> Column:
    """Logits over the temperature; those below the k-th largest become null, ties with it stay."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    scaled = F.transform(logits, lambda x: x / temperature)
    kth = F.array_repeat(F.element_at(F.reverse(F.array_sort(scaled)), F.least(F.lit(k), F.size(scaled))), F.size(scaled))
    return F.zip_with(scaled, kth, lambda x, t: F.when(x >= t, x))


def confident_and_wrong(entropy: Column, surprisal: Column) -> Column:
    return (entropy < 2.0) & (surprisal > 4.0)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(700.0)))


def bits_per_byte(bits: Column, octets: Column) -> Column:
    return F.when(octets > 0, bits / octets).otherwise(F.raise_error(F.lit("bits per byte needs bytes")).cast("double"))


def learning_rate(step: Column, steps: int, warmup: int, peak: float, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to ``floor`` of the peak."""
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, steps - warmup)))
    decay = peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * done)))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(decay)


def predictions(rows: DataFrame, logits: str, target: str, k: int = 5) -> DataFrame:
    """Surprisal, entropy, rank and the top k of every stored prediction."""
    lp = rows.withColumn("log_probs", log_softmax(F.col(logits)))
    p, t = F.col("log_probs"), F.col(target)
    out = lp.withColumns({"surprisal": surprisal_bits(p, t), "entropy": entropy_bits(p), "rank": rank(p, t), "top": top_k(p, k)})
    return out.withColumn("confident_and_wrong", confident_and_wrong(F.col("entropy"), F.col("surprisal"))).drop("log_probs")


def evaluation(predicted: DataFrame, batch: Column) -> DataFrame:
    """Bits per token, loss, perplexity, and accuracy as the plain mean of batch means."""
    per = predicted.groupBy(batch.alias("batch")).agg(
        F.sum("surprisal").alias("bits"), F.count(F.lit(1)).alias("tokens"), F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"), F.avg((F.col("rank") <= 5).cast("double")).alias("accuracy_5")
    )
    total = per.agg(F.sum("bits").alias("bits"), F.sum("tokens").alias("tokens"), F.avg("accuracy").alias("accuracy"), F.avg("accuracy_5").alias("accuracy_5"))
    bits = F.col("bits") / F.col("tokens")
    return total.select("tokens", bits.alias("bits_per_token"), (bits * LOG2).alias("loss"), perplexity(bits * LOG2).alias("perplexity"), "accuracy", "accuracy_5")


def bits_per_byte_of(predicted: DataFrame, octets: Column) -> DataFrame:
    """``(bits, bytes, bits_per_byte)`` of all predictions together; no bytes is an error."""
    return predicted.agg(F.sum("surprisal").alias("bits"), F.sum(octets).alias("bytes")).withColumn("bits_per_byte", bits_per_byte(F.col("bits"), F.col("bytes")))


def diversity(tokens: DataFrame, group: str, position: str, token: str, vocab_size: int) -> DataFrame:
    """Share of different n-grams among all (n = 1..3) and vocabulary used, per ordered sequence."""
    order = Window.partitionBy(group).orderBy(position)
    rows = tokens.select(group, F.col(token).alias("t1"), F.lead(token, 1).over(order).alias("t2"), F.lead(token, 2).over(order).alias("t3"))
    share = lambda d, n: F.when(n > 0, d / n).otherwise(0.0)
    two = F.when(F.col("t2").isNotNull(), F.struct("t1", "t2"))
    three = F.when(F.col("t3").isNotNull(), F.struct("t1", "t2", "t3"))
    found = rows.groupBy(group).agg(
        F.countDistinct("t1").alias("d1"), F.countDistinct(two).alias("d2"), F.countDistinct(three).alias("d3"),
        F.count("t1").alias("n1"), F.count(two).alias("n2"), F.count(three).alias("n3"),
    )
    return found.select(
        group,
        *[share(F.col(f"d{n}"), F.col(f"n{n}")).alias(f"distinct_{n}") for n in (1, 2, 3)],
        F.col("d1").alias("vocabulary_used"),
        (F.col("d1") / vocab_size).alias("vocabulary_fraction"),
    )


def diversity_of_arrays(sequences: Column, vocab_size: int) -> Column:
    """The same for an array column, without a shuffle."""
    def part(n: int) -> Column:
        count = F.size(sequences) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(sequences, i, n))
        return F.when(count > 0, F.size(F.array_distinct(grams)) / count).otherwise(0.0)

    used = F.size(F.array_distinct(sequences))
    return F.struct(part(1).alias("distinct_1"), part(2).alias("distinct_2"), part(3).alias("distinct_3"), used.alias("vocabulary_used"), (used / vocab_size).alias("vocabulary_fraction"))


def frequent_tokens(tokens: DataFrame, token: str, top: int) -> DataFrame:
    """The most frequent tokens; ties go to the smaller one."""
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), token).limit(top)


def bigram_bits(pairs: DataFrame, prev: str, nxt: str) -> DataFrame:
    """The closed-form bigram model: probabilities by counts, and the bits it spends on its data."""
    joint = pairs.groupBy(prev, nxt).agg(F.count(F.lit(1)).alias("n"))
    total = joint.groupBy(prev).agg(F.sum("n").alias("of"))
    return joint.join(total, prev).select(prev, nxt, "n", (-F.log2(F.col("n") / F.col("of"))).alias("bits"))


def split_on_separator(tokens: DataFrame, group: str, position: str, token: str, separator) -> DataFrame:
    """Documents of a token stream: ``(group, document, tokens)``; separators and empty documents vanish."""
    order = Window.partitionBy(group).orderBy(position)
    numbered = tokens.withColumn("document", F.sum((F.col(token) == F.lit(separator)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = numbered.where(F.col(token) != F.lit(separator))
    return kept.groupBy(group, "document").agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(token).alias("t"))))["t"].alias("tokens"))


def repeated_blocks(trials: int, block: int, pool: list[int], seed: int = 0) -> list[list[int]]:
    """Sequences of a random block and its repetition, from a pool of (frequent) tokens."""
    rng = np.random.default_rng(seed)
    halves = [rng.choice(np.asarray(pool), size=block, replace=True).tolist() for _ in range(trials)]
    return [h + h for h in halves]


def induction(bits: DataFrame, block: int, pool_size: int, position: str = "position", value: str = "bits") -> DataFrame:
    """In-context copying from stored surprisals of repeated blocks.

    ``position`` counts predictions. The block's last prediction in the first copy and the one before the second copy's second
    token tell nothing about copying and are in neither mean.
    """
    per = bits.groupBy(F.col(position).alias("p")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"))
    first, second = F.col("p") < block - 1, F.col("p") >= block
    late = F.col("p") >= block + (block - 1) // 2
    mean = lambda where: F.sum(F.when(where, F.col("total"))) / F.sum(F.when(where, F.col("n")))
    return per.agg(
        mean(first).alias("first_copy_bits"), mean(second).alias("second_copy_bits"),
        (mean(first) - mean(second)).alias("score_bits"), F.avg(F.when(late, F.col("mean"))).alias("late_bits"),
        F.lit(math.log2(pool_size)).alias("uniform_baseline_bits"),
    )


def generated_stats(texts: DataFrame, tokens: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
    """Documents, tokens, bytes and mean tokens per document of a generated corpus."""
    sizes = tokens.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"))
    octets = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("utf8_bytes"))
    return sizes.crossJoin(octets).withColumn("mean_document_tokens", F.coalesce(F.try_divide("tokens", "documents"), F.lit(0.0)))
