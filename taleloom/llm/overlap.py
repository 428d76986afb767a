"""Records of evaluation splits that also stand in training records.

A suffix array over all texts, cut into ranges of suffixes (``suffixes``): where suffixes of both sides stand side by side
with eight words in common, the evaluation record shares a sequence with the training split. Shared sequences that
follow each other are merged into spans, and the spans of a record give its coverage, the
share of its different sequences that the training split holds.

Only records that are covered to the threshold by the training split as a whole go on. Such a
record with m covered of n sequences must share at least one of its rarest m - ceil(t n) + 1
covered sequences with any qualifying training record, so only the runs of those make candidates;
every candidate is then checked on all its sequences, made anew from the texts.

Defined results: null texts and texts under 20 words take no part; a null or unknown split
belongs to neither side; identical texts count as one until the pairs are listed; repeated rows
of one id are one record per side; a sequence that recurs in a record counts once, at its first place; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm import copies, postings
from taleloom.llm.suffixes import CLASS_BITS, DEPTH, EVAL, TRAIN, Ranges, draw_ranges, neighbours, suffix_blocks
from taleloom.llm.words import sequences
from taleloom.session import cut

THRESHOLD = 0.5
#: Rows of covered suffixes that are judged together, whole records always.
BLOCK_ROWS = 500_000
_NO = np.zeros(0, np.uint64)


def split_name(column: str = "split") -> F.Column:
    """train, val, test or null, by the first letters."""
    low = F.lower(F.regexp_replace(F.col(column), r"^\s+", ""))
    return F.regexp_extract(low, "^(train|val|test)", 1)


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """The least number of shared sequences out of n that reaches the threshold."""
    k = np.ceil(n * threshold - 1e-9).astype(np.int64)
    return np.maximum(k, 1)


def _open_eval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, n, payload in postings.streamed(batches):
        key, rep, size, place, df = postings.opened(payload, n, 4)
        # Rarity beyond what an int holds does not matter.
        narrow = [c.astype(np.int32) for c in (size, place, np.minimum(df, np.uint64(2**31 - 1)))]
        columns = [rep.view(np.int64), narrow[0], key.view(np.int64), *narrow[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["e", "n", "key", "place", "df"])


def spans(record: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in the order of records: the row at which each span begins, and its length in words.

    A span is a run of shared sequences at consecutive places.
    """
    new = np.r_[True, (record[1:] != record[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(place)]) + DEPTH - 1


def probing(table: pa.Table, threshold: float) -> np.ndarray:
    """Rows of whole records (sorted by record and place) that probe: the rarest of those of records covered to the threshold."""
    record, place, n, df = (table[c].to_numpy() for c in ("e", "place", "n", "df"))
    first, length = spans(record, place)
    begins = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])
    # A span of k words holds k - DEPTH + 1 sequences.
    coverage = np.add.reduceat(length - (DEPTH - 1), np.searchsorted(first, begins))
    spare = coverage - needed(n[begins], threshold) + 1
    owner = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(record)]))
    order = np.lexsort((table["key"].to_numpy(), df, owner))
    rank = np.arange(len(order)) - begins[owner]
    return order[rank < spare[owner]]


def _probe_blocks(ranges: Ranges, threshold: float):
    """Probes of the covered suffixes that stream by record; those of a large run go to each of its buckets."""

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = probing(table, threshold)
        key, rep = (table[c].to_numpy()[rows].view(np.uint64) for c in ("key", "e"))
        bucket = ranges.bucket_of(key, rep)
        order = np.lexsort((key, bucket))
        bucket, key, rep = bucket[order], key[order], rep[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for a, z in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            payload = postings.squeeze(np.diff(key[a:z], prepend=np.uint64(0)), rep[a:z])
            b = int(bucket[a])
            of_run = ranges.run_of(b)
            to = [b] if of_run < 0 else list(range(ranges.first[of_run], ranges.first[of_run] + ranges.spread[of_run]))
            yield postings.batch_of(to, [EVAL] * len(to), [int(z - a)] * len(to), [payload] * len(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_records(batches):
            yield from packed(table)

    return run


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by record, in tables that hold whole records."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.searchsorted(table["e"].to_numpy(), table["e"][-1].as_py()))
        if last:  # the last record may go on
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            rows -= last
    if rows:
        yield pa.Table.from_batches(held)


def _coverage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(e, sequences, covered, spans, longest)`` of each record."""
    for table in _whole_records(batches):
        record, place = (table[c].to_numpy() for c in ("e", "place"))
        first, length = spans(record, place)
        begins = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])
        at = np.searchsorted(first, begins)
        columns = [
            record[begins], table["n"].to_numpy()[begins], np.add.reduceat(length - (DEPTH - 1), at).astype(np.int32),
            np.diff(np.r_[at, len(first)]).astype(np.int32), np.maximum.reduceat(length, at).astype(np.int32),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["e", "sequences", "covered", "spans", "longest"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(evaluation record, training record) for every probe and training suffix of one run."""
    for _, parts in postings.by_bucket_of(batches):
        probe, probing = postings.gathered([postings.opened(p, n, 1) for kind, n, p in parts if kind == EVAL], 2)
        if not len(probe):
            continue
        for kind, n, payload in parts:
            if kind != TRAIN:
                continue
            key, rep = postings.opened(payload, n, 1)
            low, high = np.searchsorted(probe, key, "left"), np.searchsorted(probe, key, "right")
            width = high - low
            hit = width > 0
            for part in np.array_split(np.flatnonzero(hit), max(1, int(width[hit].sum()) // 200_000 + 1)):
                w = width[part]
                if not w.sum():
                    continue
                at = np.arange(w.sum()) + np.repeat(low[part] - (np.cumsum(w) - w), w)
                pairs = np.unique(np.stack([probing[at], np.repeat(rep[part], w)], 1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["e", "t"])


def _covered(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            evals, trains = _sets(batch["text_e"], DEPTH), _sets(batch["text_t"], DEPTH)
            for a, b in zip(evals, trains, strict=True):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(len(a) > 0 and shared >= needed(np.asarray(len(a)), threshold))
            yield batch.select(["e", "t"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(column: pa.Array, depth: int) -> list[np.ndarray]:
    """Sequences of each row; equal texts are cut once."""
    coded = column.dictionary_encode()
    at, grams, starts = sequences(coded.dictionary.to_pylist(), depth)
    by = {int(i): grams[a:b] for i, a, b in zip(at, starts[:-1], starts[1:], strict=True)}
    return [by.get(i, _NO) for i in coded.indices.to_pylist()]


def shared_suffixes(documents: DataFrame, check: int | None = None) -> tuple[DataFrame, Ranges]:
    """Blocks of the suffixes that both sides have, and the cut of the array.

    By default keys have only as many bits as it takes to make few candidates too many; with 32 check bits they tell sequences apart by themselves.
    """
    rows = documents.select("doc_id", "text", split_name().alias("side"))
    wanted = rows.where("side <> ''")
    texts = copies.distinct_texts(wanted, {"trains": F.col("side") == "train", "evaluates": F.col("side") != "train"})
    size = postings.stored_bytes(documents)
    ranges = draw_ranges(wanted, size, postings.bucket_count(documents, size), check)
    array = texts.drop("copies").mapInArrow(suffix_blocks(ranges), postings.BLOCK_SCHEMA)
    return cut(postings.by_bucket(array, ranges.buckets).mapInArrow(neighbours(ranges), postings.BLOCK_SCHEMA)), ranges


def covered_suffixes(shared: DataFrame) -> DataFrame:
    """The evaluation suffixes among them, by record and place."""
    covered = shared.where(F.col("kind") == EVAL).mapInArrow(_open_eval, "e bigint, n int, key bigint, place int, df int")
    return covered.repartition("e").sortWithinPartitions("e", "place")


def record_coverage(documents: DataFrame) -> DataFrame:
    """``(doc_id, sequences, covered, spans, longest)`` of every evaluation record that shares a sequence with the training split as a whole.

    ``longest`` is the length of the longest span in words. Sequences are told apart by 64 bits.
    """
    shared, _ = shared_suffixes(documents, 64 - DEPTH * CLASS_BITS)
    found = covered_suffixes(shared).mapInArrow(_coverage, "e bigint, sequences int, covered int, spans int, longest int")
    sided = documents.select("doc_id", "text", split_name().alias("side")).where("side <> ''")
    evals = copies.members(sided, F.col("side")).where("side <> 'train'").select(F.col("rep").alias("e"), "doc_id")
    return evals.join(found, "e").drop("e").dropDuplicates(["doc_id"])


def class_pairs(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(e, t)``: representatives of texts of which the first, in an evaluation split, is covered by the second in train.

    A text that stands in both meets its own suffixes and is paired with itself.
    """
    shared, ranges = shared_suffixes(documents)
    by_record = covered_suffixes(shared)
    probe_blocks = by_record.mapInArrow(_probe_blocks(ranges, threshold), postings.BLOCK_SCHEMA)
    meeting = postings.by_bucket(shared.where(F.col("kind") == TRAIN).unionByName(probe_blocks), ranges.buckets)
    candidates = cut(meeting.mapInArrow(_meet, "e bigint, t bigint").distinct())

    ids = candidates.select(F.explode(F.array("e", "t")).alias("rep")).distinct()
    found = copies.pick(documents, ids)
    return (
        candidates.join(found.select(F.col("rep").alias("e"), F.col("text").alias("text_e")), "e")
        .join(found.select(F.col("rep").alias("t"), F.col("text").alias("text_t")), "t")
        .mapInArrow(_covered(threshold), "e bigint, t bigint")
    )


def record_pairs(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(eval_id, train_id, eval_split, eval_source, train_source)`` of every overlapping pair of records."""
    pairs = class_pairs(documents, threshold)
    # The same rows as in class_pairs, so that a class has the same representative.
    sided = documents.select("doc_id", "text", "source", split_name().alias("side")).where("side <> ''")
    everyone = copies.members(sided, F.col("side"), F.col("source"))
    evals = everyone.where("side <> 'train'").select(
        F.col("rep").alias("e"), F.col("doc_id").alias("eval_id"), F.col("side").alias("eval_split"), F.col("source").alias("eval_source")
    )
    trains = everyone.where("side = 'train'").select(
        F.col("rep").alias("t"), F.col("doc_id").alias("train_id"), F.col("source").alias("train_source")
    )
    return pairs.join(evals, "e").join(trains, "t").drop("e", "t").dropDuplicates(["eval_id", "train_id"])


def report(pairs: DataFrame) -> DataFrame:
    """Overlapping evaluation records and pairs per split and source."""
    return pairs.groupBy("eval_split", "eval_source").agg(
        F.countDistinct("eval_id").alias("records"), F.count(F.lit(1)).alias("pairs")
    )
