"""Suffix arrays of many texts, partitioned by ranges of suffixes.

The alphabet is one of word classes: a word's class is the leading bits of its hash, and classes are
ordered by these bits. A text is the string of its words' classes, and a suffix is known by its
first eight of them, in order, followed by bits of the hash of the eight words themselves, which tell apart words of
one class. Both make one number, whose order is the suffixes' order. Splitters drawn
from a sample of suffixes cut the array into ranges of like size; a run of equal suffixes
that is larger than such a range (a passage that a great part of the texts holds) is dealt over several
buckets of its own, and every one of them is told the sizes of the whole run.

Within a bucket all suffixes are sorted and each is compared with its neighbour: the common prefix is the
number of leading words in which the two agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm import postings
from taleloom.llm.words import MIN_WORDS, sequences

#: Words of a suffix that are compared, and bits of a word's class.
DEPTH = 8
CLASS_BITS = 4
#: Ranges that splitters make at most; beyond, each range is divided again by a hash of its suffixes' first half.
MOST_RANGES = 16_384
#: Stored bytes of the sample for each range, and at least; suffixes taken of a sampled text.
SAMPLE_BYTES, LEAST_SAMPLE, OF_A_TEXT = 4 << 10, 2 << 20, 8

MARK_EVAL, MARK_TRAIN, EVAL, TRAIN = range(4)


@dataclass(frozen=True)
class Ranges:
    """The cut of the array: splitters, the division of a range, and large runs with their first bucket and width.

    ``check`` is the number of bits that tell words of one class apart.
    """

    check: int
    splitters: np.ndarray
    division: int
    large: np.ndarray
    first: np.ndarray
    spread: np.ndarray

    @property
    def plain(self) -> int:
        """Buckets of ranges; those of large runs follow."""
        return (len(self.splitters) + 1) * self.division

    @property
    def buckets(self) -> int:
        return self.plain + int(self.spread.sum())

    def run_of(self, bucket: int) -> int:
        """The large run whose bucket it is, or -1."""
        return -1 if bucket < self.plain else int(np.searchsorted(self.first, bucket, "right")) - 1

    def bucket_of(self, key: np.ndarray, record: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.splitters, key, "right").astype(np.int64) * self.division
        if self.division > 1:
            head = key >> np.uint64(self.check)
            out += ((head * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.division
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, key), len(self.large) - 1)
            of_run = self.large[at] == key
            out[of_run] = self.first[at[of_run]] + (record[of_run] % self.spread[at[of_run]].astype(np.uint64)).astype(np.int64)
        return out


def check_bits(buckets: int) -> int:
    """The longer the array, the more, so that sequences are told apart as well at any size."""
    return min(64 - DEPTH * CLASS_BITS, 8 + int(buckets).bit_length())


def suffixes(texts: list[str | None], check: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, size, key, place)``: texts with enough words and their numbers of different suffixes; keys and word numbers of these.

    Of suffixes that agree in all their words the first one in a text counts.
    """
    at, grams, starts, places, classes, begins = sequences(texts, DEPTH, MIN_WORDS, CLASS_BITS)
    if not len(at):
        return at, np.zeros(0, np.int64), grams, places
    key, span = classes, 1
    while span < DEPTH:
        key = (key[: len(key) - span] << np.uint64(CLASS_BITS * span)) | key[span:]
        span *= 2
    size = np.diff(starts)
    return at, size, key[places] << np.uint64(check) | grams >> np.uint64(64 - check), places - np.repeat(begins, size)


def common_prefix(a: np.ndarray, b: np.ndarray, check: int) -> np.ndarray:
    """Number of leading classes in which keys agree; DEPTH only if the words do, too."""
    apart = a ^ b
    out = np.full(len(apart), DEPTH)
    out[apart > 0] = DEPTH - 1
    for k in range(1, DEPTH):
        out[(apart >> np.uint64(check + CLASS_BITS * k)) > 0] = DEPTH - 1 - k
    return out


def draw_ranges(texts: DataFrame, size: int, buckets: int, check: int | None = None) -> Ranges:
    """Splitters and large runs from a sample of texts whose size follows the number of ranges."""
    check = check_bits(buckets) if check is None else check
    ranges = min(buckets, MOST_RANGES)
    fraction = min(1.0, max(LEAST_SAMPLE, SAMPLE_BYTES * ranges) / max(1, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["text"].to_pylist()
            at, n, key, _ = suffixes(column, check)
            ends = np.cumsum(n)
            picked = []
            for i, first, count in zip(at.tolist(), (ends - n).tolist(), n.tolist(), strict=True):
                lot = np.random.default_rng(xxhash.xxh3_64_intdigest(column[i].encode("utf-8", "surrogatepass")))
                picked.append(first + lot.choice(count, min(OF_A_TEXT, count), replace=False))
            keys = key[np.concatenate(picked)] if picked else key
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    sample = texts.select("text").sample(fraction, seed=1) if fraction < 1 else texts.select("text")
    drawn = sample.mapInArrow(run, "key bigint").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    return cut_ranges(drawn, check, ranges, max(1, buckets // ranges))


def cut_ranges(drawn: np.ndarray, check: int, ranges: int, division: int) -> Ranges:
    keys, often = np.unique(drawn, return_counts=True)
    if not len(keys):
        none = np.zeros(0, np.int64)
        return Ranges(check, keys, division, keys, none, none)
    share = often * (ranges * division) / often.sum()
    large = share > 1
    spread = np.ceil(share[large]).astype(np.int64) + 1
    ends = np.cumsum(often[~large])
    wanted = np.arange(1, ranges) * (ends[-1] / ranges) if len(ends) else np.zeros(0)
    splitters = np.unique(keys[~large][np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)]) if len(ends) else keys[:0]
    first = (len(splitters) + 1) * division + np.cumsum(spread) - spread
    return Ranges(check, splitters, division, keys[large], first, spread)


def suffix_blocks(ranges: Ranges):
    """Blocks of the suffixes of ``rep, text, evaluates, trains``: of evaluation texts with place and number of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, key, place = suffixes(batch["text"].to_pylist(), ranges.check)
            if not len(at):
                continue
            record = np.repeat(batch["rep"].to_numpy()[at].view(np.uint64), n)
            order = np.argsort(key, kind="stable")
            for kind, mark, name in ((EVAL, MARK_EVAL, "evaluates"), (TRAIN, MARK_TRAIN, "trains")):
                side = np.repeat(batch[name].to_numpy(zero_copy_only=False)[at], n)[order]
                chosen = order[side]
                if not len(chosen):
                    continue
                keys, records = key[chosen], record[chosen]
                columns = [records]
                if kind == EVAL:
                    columns += [np.repeat(n, n)[chosen].astype(np.uint64), place[chosen].astype(np.uint64)]
                bucket = ranges.bucket_of(keys, records)
                if ranges.division > 1 or bucket[-1] >= ranges.plain or len(ranges.large):
                    by = np.argsort(bucket, kind="stable")
                    bucket, keys, columns = bucket[by], keys[by], [c[by] for c in columns]
                yield postings.cut_blocks(bucket, keys, columns, kind)
                if bucket[-1] >= ranges.plain:
                    yield _marks(ranges, bucket[bucket >= ranges.plain], mark)

    return run


def _marks(ranges: Ranges, bucket: np.ndarray, mark: int) -> pa.RecordBatch:
    """The sizes of parts of large runs, for every bucket of the run."""
    runs, often = np.unique(np.searchsorted(ranges.first, bucket, "right") - 1, return_counts=True)
    buckets = [b for r in runs.tolist() for b in range(ranges.first[r], ranges.first[r] + ranges.spread[r])]
    sizes = np.repeat(often, ranges.spread[runs]).tolist()
    return postings.batch_of(buckets, [mark] * len(buckets), sizes, [b""] * len(buckets))


def neighbours(ranges: Ranges):
    """Of each bucket the suffixes that stand beside one of the other side with all words in common.

    Evaluation suffixes come with the number of training ones in their run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in postings.by_bucket_of(batches):
            told = {m: sum(n for kind, n, _ in parts if kind == m) for m in (MARK_EVAL, MARK_TRAIN)}
            evals = postings.gathered([postings.opened(p, n, 3) for kind, n, p in parts if kind == EVAL], 4)
            trains = postings.gathered([postings.opened(p, n, 1) for kind, n, p in parts if kind == TRAIN], 2)
            keys = np.concatenate([evals[0], trains[0]])
            if not len(keys):
                continue
            side = np.repeat([0, 1], [len(evals[0]), len(trains[0])])
            order = np.argsort(keys, kind="stable")
            keys, side = keys[order], side[order]
            prefix = common_prefix(keys[:-1], keys[1:], ranges.check)
            number = np.cumsum(np.r_[0, prefix < DEPTH])
            if ranges.run_of(bucket) >= 0:
                sizes = np.array([[told[MARK_EVAL], told[MARK_TRAIN]]])
            else:
                sizes = np.stack([np.bincount(number[side == s], minlength=number[-1] + 1) for s in (0, 1)], 1)
            both = (sizes > 0).all(1)
            for kind, columns, s in ((EVAL, evals, 0), (TRAIN, trains, 1)):
                mine = number[side == s]
                hit = both[mine]
                if hit.any():
                    kept = [c[hit] for c in columns] + ([sizes[mine[hit], 1].astype(np.uint64)] if kind == EVAL else [])
                    step = np.diff(kept[0], prepend=np.uint64(0))
                    yield postings.batch_of([bucket], [kind], [int(hit.sum())], [postings.squeeze(step, *kept[1:])])

    return run
