"""Near-duplicate records by SetSketch registers.

Each text's set of word sequences is sketched into registers: the minimum of exponentially
distributed hash values, kept as its truncated logarithm to a base (exponentially spaced
values, one byte each). Sketches of parts merge by the larger register. Bands of registers
bring similar sets together; the pair's similarity is then estimated jointly from both
sketches by maximum likelihood, and what is left is verified on the words themselves.

Recall: at the threshold 0.7 a pair is missed by all 50 bands of 5 registers with a
probability of about 1e-4, at 0.8 of 1e-9; the estimate drops a true pair only if it is off
by more than five standard errors.

Defined results: null texts and texts under 20 words take no part; texts with equal
sequence sets have similarity 1; identical texts are one class until pairs are listed; repeated
rows of one id are one record; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm import copies, postings
from taleloom.llm.overlap import _sets
from taleloom.llm.words import mix, sequences
from taleloom.operators.components import components
from taleloom.session import cut

BASE = 1.05
TOP = 255
BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
#: An estimate this far below the threshold still goes on to verification.
MARGIN = 0.25

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets x REGISTERS) bytes. Sets are consecutive, ``starts`` holds their starts and the total."""
    out = np.empty((REGISTERS, len(starts) - 1), np.float64)
    for at in range(0, len(starts) - 1, 256):
        edge = starts[at : at + 257]
        block = hashes[edge[0] : edge[-1]]
        for i, seed in enumerate(_SEEDS):
            # A seeded multiplication of mixed hashes; its high bits decide the minimum.
            low = np.minimum.reduceat(block * seed, edge[:-1] - edge[0])
            out[i, at : at + len(low)] = low
    uniform = (out + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    level = np.floor(1 - np.log(value) / math.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint8).T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likelihood_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) of sets of known sizes.

    With u and v the sets' shares of the summed sizes, a register of the first is the larger
    with probability p(u - vJ), of the second with p(v - uJ), p(x) = -log_b(1 - x (b-1)/b).
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :]
    j = np.minimum(grid, np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    first, second = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    total = more[:, None] * np.log(first + tiny) + less[:, None] * np.log(second + tiny)
    total += same[:, None] * np.log(np.maximum(1 - first - second, tiny))
    return j[np.arange(len(j)), total.argmax(1)]


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, starts = sequences(batch["text"].to_pylist(), size)
            if not len(at):
                continue
            sketch = registers(hashes, starts)
            pick = pa.array(at)
            arrays = [
                batch["rep"].take(pick),
                batch["copies"].take(pick),
                pa.array(np.diff(starts).astype(np.int32)),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "copies", "n", "sketch"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _band_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = _matrix(batch["sketch"]).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :]
            for r in range(ROWS):
                key = key << np.uint64(8) | bands[:, :, r]
            rep = np.repeat(batch["rep"].to_numpy().view(np.uint64), BANDS)
            n = np.repeat(batch["n"].to_numpy().astype(np.uint64), BANDS)
            yield postings.blocks(mix(key.ravel()), [rep, n], buckets, 0)

    return run


def _band_pairs(threshold: float):
    """Pairs that share a band and whose sizes allow the threshold.

    Members of a band are sorted by size and each meets only the larger ones up to
    size / threshold.
    """

    def close(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, rep, n = postings.gathered(held, 3)
        order = np.lexsort((n, key))
        key, rep, n = key[order], rep[order].view(np.int64), n[order].astype(np.int64)
        # One number per row that grows with key, then size: the range of partners is a search.
        run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        span = int(n.max()) + 1
        place = run * span + n
        last = np.searchsorted(place, run * span + np.minimum(np.floor(n / threshold + 1e-9), span - 1).astype(np.int64), "right")
        width = last - np.arange(len(n)) - 1
        rows = np.flatnonzero(width > 0)
        for part in np.array_split(rows, max(1, int(width[rows].sum()) // 500_000 + 1)):
            w = width[part]
            if not w.sum():
                continue
            left = np.repeat(rep[part], w)
            right = rep[np.arange(w.sum()) + np.repeat(part + 1 - (np.cumsum(w) - w), w)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for bucket, _, n, payload in postings.streamed(batches):
            if bucket != current and held:
                yield from close(held)
                held = []
            current = bucket
            held.append(postings.opened(payload, n, 2))
        if held:
            yield from close(held)

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = (batch[c].to_numpy().astype(float) for c in ("n_a", "n_b"))
            j = likelihood_estimate(_matrix(batch["sketch_a"]), _matrix(batch["sketch_b"]), *sizes)
            yield batch.select(["a", "b"]).filter(pa.array(j >= least))

    return run


def _verified(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = []
            for x, y in zip(_sets(batch["text_a"], size), _sets(batch["text_b"], size), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - shared
                similarity.append(shared / union if union else 0.0)
            out = batch.select(["a", "b"]).append_column("similarity", pa.array(similarity, pa.float64()))
            yield out.filter(pa.array([s >= threshold for s in similarity], pa.bool_()))

    return run


def class_pairs(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity)`` of representatives, a < b; a class with copies is paired with itself."""
    texts = copies.distinct_texts(documents.select("doc_id", "text"), {})
    sketches = cut(texts.mapInArrow(_sketches(size), "rep bigint, copies bigint, n int, sketch binary"))
    buckets = postings.bucket_count(documents)
    bands = sketches.select("rep", "n", "sketch").mapInArrow(_band_blocks(buckets), postings.BLOCK_SCHEMA)
    met = postings.by_bucket(bands, buckets).mapInArrow(_band_pairs(threshold), "a bigint, b bigint").distinct()

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    likely = cut(met.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(threshold - MARGIN), "a bigint, b bigint"))
    ids = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    found = copies.pick(documents, ids)
    verified = (
        likely.join(found.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .join(found.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(_verified(size, threshold), "a bigint, b bigint, similarity double")
    )
    own = sketches.where("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    return verified.unionByName(own)


def record_pairs(documents: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, the smaller first, of every pair of records; copies are expanded."""
    pairs = class_pairs(documents, size, threshold)
    everyone = copies.members(documents)
    left = everyone.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    right = everyone.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .distinct()
    )


def groups(documents: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, class_id, links)`` of every document that has a near-duplicate.

    ``class_id`` is the smallest document of the connected group; ``links`` counts the documents that
    reach the threshold with this one, copies included. Copies are not expanded into pairs.
    """
    pairs = cut(class_pairs(documents, size, threshold).select("a", "b"))
    everyone = cut(copies.members(documents))
    sizes = everyone.groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    other = pairs.where("a <> b")
    both = other.unionByName(other.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("others"))
    found = components(other).select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    per_class = (
        reps.join(sizes, "rep").join(linked, "rep", "left").join(found, "rep", "left")
        .select("rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    )
    return everyone.join(per_class, "rep").select("doc_id", "class_id", "links")
