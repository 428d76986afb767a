"""MinHash signatures, banded candidates and verified pairs.

Two hash families: the exact one reproduces 64-bit arithmetic that wraps before the modulus
and needs NumPy; the 31-bit one uses products below 2**62 that SQL can follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.operators.components import components
from taleloom.session import cut, spread

M61 = (1 << 61) - 1
M31 = (1 << 31) - 1
#: Shingles whose hashes a worker remembers, and texts whose signatures are made together.
KNOWN_SHINGLES = 1_000_000
TOGETHER = 64


def draws(num_perm: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets, drawn in this order from one seeded generator."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, M61, size=num_perm, dtype=np.uint64), rng.integers(0, M61, size=num_perm, dtype=np.uint64)


def draws31(num_perm: int) -> list[tuple[int, int]]:
    """Multipliers and offsets below 2**31 - 1 by a linear congruential rule."""
    x, out = 12345, []
    for _ in range(num_perm):
        x = (48271 * x) % M31
        y = (48271 * x) % M31
        out.append((x, y))
        x = y
    return out


#: Hashes of shingles, of which texts of one kind share most.
_DIGESTS: dict[bytes | str, int] = {}


def _remember(shingles: set) -> None:
    """Hash the shingles that are not known; the memory is emptied when it is full."""
    if len(_DIGESTS) + len(shingles) > KNOWN_SHINGLES:
        _DIGESTS.clear()
    new = list(shingles.difference(_DIGESTS))
    if new and isinstance(new[0], bytes):
        raw = b"".join([hashlib.blake2b(g, digest_size=8).digest() for g in new])
        values = np.frombuffer(raw, ">u8").astype(np.uint64) % np.uint64(M61)
        _DIGESTS.update(zip(new, values.tolist(), strict=True))
    else:
        _DIGESTS.update({g: int(hashlib.md5(g.encode()).hexdigest()[:15], 16) % M31 for g in new})


def _shingles(data: bytes | str, ngram: int) -> set:
    return {data[i : i + ngram] for i in range(max(1, len(data) - ngram + 1))}


def _modulo(x: np.ndarray, bits: int) -> np.ndarray:
    """Modulo 2**bits - 1, by adding the upper bits to the lower ones; the array is used up."""
    prime = np.uint64((1 << bits) - 1)
    high = x >> np.uint64(bits)
    x &= prime
    x += high
    np.subtract(x, prime, out=x, where=x >= prime)
    return x


def signature_matrix(texts: list[str], multipliers: np.ndarray, offsets: np.ndarray, ngram: int = 8, exact: bool = True) -> np.ndarray:
    """(texts x permutations): smallest (a*h + b) modulo the family's prime over a text's distinct shingles.

    The exact family takes shingles of bytes and lets the product wrap at 64 bits; the other one takes shingles of characters and
    products below 2**62.
    """
    out = np.empty((len(texts), len(multipliers)), np.uint64)
    for at in range(0, len(texts), TOGETHER):
        sets = [_shingles(t.encode("utf-8") if exact else t, ngram) for t in texts[at : at + TOGETHER]]
        sizes = [len(s) for s in sets]
        _remember(set().union(*sets))
        h = np.fromiter(map(_DIGESTS.__getitem__, chain.from_iterable(sets)), np.uint64, sum(sizes))
        starts = np.cumsum([0, *sizes[:-1]])
        for i, (a, b) in enumerate(zip(multipliers, offsets, strict=True)):
            x = h * a
            x += b
            if not exact:  # up to 62 bits need the fold twice
                x = _modulo(x, 31)
            out[at : at + len(sets), i] = np.minimum.reduceat(_modulo(x, 61 if exact else 31), starts)
    return out


def signatures(documents: DataFrame, num_perm: int = 64, ngram: int = 8, seed: int = 0, exact: bool = True, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, signature)`` of every document with a text."""
    rows = documents.where(F.col("text").isNotNull()).select(F.col(id_column).alias("doc_id"), "text")
    a, b = draws(num_perm, seed) if exact else np.array(draws31(num_perm), np.uint64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = signature_matrix(batch["text"].to_pylist(), a, b, ngram, exact).astype(np.int64).ravel()
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), num_perm).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "signature"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, signature array<bigint>")


def classes(signed: DataFrame) -> DataFrame:
    """One row per different signature: its smallest document and number of documents.

    Kept as a checkpoint: candidates and both sides of their check read it.
    """
    return cut(signed.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("documents")))


def candidates(classed: DataFrame, num_perm: int, bands: int) -> DataFrame:
    """Pairs of different signatures that agree in a band, smaller document first.

    Equal signatures were made one beforehand, so a hot group of copies is a single member.
    """
    if num_perm % bands:
        raise ValueError(f"{bands} bands of equal size cannot be made of {num_perm} values")
    rows = num_perm // bands
    keyed = classed.select(
        "rep",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.slice("signature", i * rows + 1, rows))).alias("band", "key"),
    )
    left, right = keyed.withColumnRenamed("rep", "a"), keyed.withColumnRenamed("rep", "b")
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def agreement(left, right):
    """Share of equal positions."""
    equal = F.zip_with(left, right, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda s, v: s + v) / F.size(left)


def near_pairs(classed: DataFrame, num_perm: int, threshold: float = 0.8, bands: int = 16) -> DataFrame:
    """``(a, b, similarity)`` of candidate pairs whose signatures agree to the threshold."""
    met = candidates(classed, num_perm, bands)
    sides = [classed.select(F.col("rep").alias(n), F.col("signature").alias(f"s_{n}")) for n in "ab"]
    joined = met.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", agreement(F.col("s_a"), F.col("s_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicate_groups(signed: DataFrame, num_perm: int, threshold: float = 0.8, bands: int = 16) -> DataFrame:
    """``(doc_id, component, links)`` of every document in a group of two or more.

    ``links`` counts linked documents: those of equal signature and those of linked classes.
    """
    classed = classes(signed)
    pairs = near_pairs(classed, num_perm, threshold, bands)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classed.select(F.col("rep").alias("b"), F.col("documents"))
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("documents").alias("others"))
    found = components(pairs).withColumnRenamed("node", "rep")
    grouped = (
        classed.join(found, "rep", "left")
        .join(linked, "rep", "left")
        .where((F.col("documents") > 1) | F.col("component").isNotNull())
        .select(
            "signature",
            F.coalesce("component", "rep").alias("component"),
            (F.col("documents") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        )
    )
    return signed.join(grouped, "signature").select("doc_id", "component", "links")


def curate(documents: DataFrame, filters=None, near_duplicate_threshold: float | None = 0.85, ngram: int = 8, seed: int = 0, order: str = "doc_id") -> dict[str, DataFrame]:
    """Exact duplicates, quality filters, near duplicates; the first document in order survives.

    Returns the kept documents and the frames of the report: ``stages`` and ``rejections``.
    The near-duplicate stage is absent if it is disabled.
    """
    from taleloom.operators import curate as C

    given = documents.where(F.col("text").isNotNull()).select(F.col(order).alias("doc_id"), "text")
    first = C.exact_dedup(given).select("doc_id")
    reason = C.reject_reason(F.col("text"), filters or C.QualityFilters())
    # Judged where the texts lie, before they meet the first ones.
    every = spread(given, "doc_id").select("doc_id", reason.alias("reason"))
    judged = cut(every.join(first, "doc_id", "left_semi"))
    passed = given.join(judged.where(F.col("reason").isNull()), "doc_id", "left_semi")
    stages = [("input", given), ("exact_duplicates", judged), ("quality", judged.where(F.col("reason").isNull()))]
    kept = passed
    if near_duplicate_threshold is not None:
        signed = cut(signatures(passed, 64, ngram, seed))
        groups = cut(duplicate_groups(signed, 64, near_duplicate_threshold).where("doc_id <> component").select("doc_id"))
        kept = passed.join(groups, "doc_id", "left_anti")
        stages.append(("near_duplicates", signed.select("doc_id").join(groups, "doc_id", "left_anti")))
    return {
        "kept": kept,
        "stages": C.funnel(stages),
        "rejections": judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("documents")),
    }
