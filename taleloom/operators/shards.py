"""Token shards: greedy packing, the index, windows and batches.

A shard closes once it holds its budget, so each boundary depends on the one before. Cutting
runs over token counts alone (a few bytes per document) in document order, one split in one
task; the tokens follow by a join on the document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX_SCHEMA = (
    "vocab_size INT, dtype STRING, tokenizer_fingerprint STRING, splits MAP<STRING, STRUCT<tokens: BIGINT, documents: BIGINT, utf8_bytes: BIGINT, "
    "shards: ARRAY<STRUCT<path: STRING, tokens: BIGINT, documents: BIGINT, utf8_bytes: BIGINT, synthetic: BOOLEAN, quarantine_tag: STRING>>>>"
)


def choose_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65_536 else "uint32"


def assign_shards(sizes: DataFrame, shard_tokens: int, split: str = "split", order: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """``(split, doc_id, n_tokens, shard)``: a shard takes documents until it holds ``shard_tokens``."""
    if shard_tokens <= 0:
        raise ValueError("shard_tokens must be positive")
    rows = sizes.select(F.col(split).alias("split"), F.col(order).alias("doc_id"), F.col(tokens).cast("bigint").alias("n_tokens"))
    ordered = rows.repartition("split").sortWithinPartitions("split", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, held = object(), 0, 0
        for batch in batches:
            sizes = batch["n_tokens"].fill_null(0).to_numpy().astype(np.int64)
            names = batch["split"].dictionary_encode(null_encoding="encode")
            codes = names.indices.to_numpy()
            out = np.empty(len(sizes), np.int32)
            edges = [*np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist(), len(codes)] if len(codes) else []
            for a, b in pairwise(edges):
                name = names.dictionary[int(codes[a])].as_py()
                if name != current:
                    current, shard, held = name, 0, 0
                upto = np.cumsum(sizes[a:b])
                begin = 0
                while begin < b - a:
                    if held >= shard_tokens:
                        shard, held = shard + 1, 0
                    before = int(upto[begin - 1]) if begin else 0
                    # The document that fills the shard is its last.
                    end = min(b - a, int(np.searchsorted(upto, before + shard_tokens - held)) + 1)
                    out[a + begin : a + end] = shard
                    held += int(upto[end - 1]) - before
                    begin = end
            yield batch.append_column("shard", pa.array(out))

    return ordered.mapInArrow(run, "split string, doc_id bigint, n_tokens bigint, shard int")


def shard_totals(assigned: DataFrame) -> DataFrame:
    """Tokens and documents per shard, per split and in all."""
    return assigned.rollup("split", "shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def validate_synthetic(shards: DataFrame) -> DataFrame:
    """Shards that break the rule that synthetic data carries a tag."""
    return shards.where(F.coalesce("synthetic", F.lit(False)) & (F.coalesce(F.trim("quarantine_tag"), F.lit("")) == ""))


def split_summary(shards: DataFrame) -> DataFrame:
    """Totals, bytes per token and synthetic token share of every split; a path counts once."""
    once = shards.groupBy("path").agg(*[F.max(c).alias(c) for c in ("split", "tokens", "documents", "utf8_bytes", "synthetic")])
    per = once.groupBy("split").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("utf8_bytes"), F.lit(0)).alias("utf8_bytes"),
        F.coalesce(F.sum(F.when(F.col("synthetic"), F.col("tokens"))), F.lit(0)).alias("synthetic_tokens"),
    )
    return per.withColumn("bytes_per_token", F.coalesce(F.try_divide("utf8_bytes", "tokens"), F.lit(0.0))).withColumn(
        "synthetic_share", F.coalesce(F.try_divide("synthetic_tokens", "tokens"), F.lit(0.0))
    )


def windows(tokens: DataFrame, seq_len: int, group: str = "shard", position: str = "pos", token: str = "token") -> DataFrame:
    """Non-overlapping windows with targets shifted by one: ``(group, window, x, y)``; the tail is dropped."""
    order = Window.partitionBy(group).orderBy(position)
    shifted = tokens.select(group, F.col(position).alias("pos"), F.col(token).alias("x"), F.lead(token).over(order).alias("y"))
    packed = (
        shifted.where(F.col("y").isNotNull())
        .groupBy(group, F.floor(F.col("pos") / seq_len).alias("window"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("rows"))
        .where(F.size("rows") == seq_len)
    )
    return packed.select(group, "window", F.col("rows.x").alias("x"), F.col("rows.y").alias("y"))


def sample_offsets(lengths: list[int], seq_len: int, batch_size: int, steps: int, seed: int) -> list[tuple[int, int, int, int]]:
    """``(step, row, shard, start)`` of seeded batches: shards by their tokens, starts evenly; shards without a window are left out."""
    usable = np.array([i for i, n in enumerate(lengths) if n > seq_len])
    if not len(usable):
        raise ValueError("no shard holds seq_len + 1 tokens")
    sizes = np.array(lengths)[usable]
    share = sizes.astype(float) / sizes.sum()
    lot = np.random.default_rng(seed)
    out = []
    for step in range(steps):
        # All shards of a batch are drawn before its starts.
        shards = lot.choice(len(usable), size=batch_size, p=share)
        starts = [int(lot.integers(0, sizes[k] - seq_len)) for k in shards]
        out += [(step, row, int(usable[k]), start) for row, (k, start) in enumerate(zip(shards, starts, strict=True))]
    return out


def shard_name(split: str, number: int) -> str:
    """Fixed format: the name of a shard file."""
    return f"{split}_{number:03d}.bin"


def shard_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``(path, content)`` of a split's shard files, the path as in the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}_*.bin").load(root)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")
    return named.where(F.col("path").rlike(rf"^{re.escape(split)}_\d+\.bin$"))


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder."""
    return fs.FileSystem.from_uri(root if "://" in root else Path(root).absolute().as_uri())


def write_shards(encoded: DataFrame, root: str, split: str, vocab_size: int, fingerprint: str, shard_tokens: int = 50_000_000, separator: int | None = None, synthetic: bool = False, quarantine_tag: str | None = None, mode: str = "error") -> None:
    """Flat little-endian token files and ``meta.json``, in a folder that all executors share (a path or an address Arrow knows); one file is written by one task.

    ``encoded`` has ``doc_id, ids`` and optionally ``utf8_bytes``. An existing split is an error unless
    ``mode`` is ``append``; vocabulary size and fingerprint must match those already there.
    """
    if synthetic and not quarantine_tag:
        raise ValueError("synthetic shards need a quarantine_tag")
    system, base = file_system(root)
    meta_path = f"{base}/meta.json"
    dtype = choose_dtype(vocab_size)
    meta = json.loads(system.open_input_stream(meta_path).read()) if system.get_file_info(meta_path).type == fs.FileType.File else {"vocab_size": vocab_size, "dtype": dtype, "tokenizer_fingerprint": fingerprint, "splits": {}}
    if (meta["vocab_size"], meta["tokenizer_fingerprint"]) != (vocab_size, fingerprint):
        raise ValueError("the corpus was made with another tokenizer")
    if split in meta["splits"] and mode != "append":
        raise ValueError(f"split {split} exists; use mode='append'")
    rows = encoded if "utf8_bytes" in encoded.columns else encoded.withColumn("utf8_bytes", F.lit(0))
    with_end = rows.withColumn("ids", F.concat("ids", F.array(F.lit(separator)))) if separator is not None else rows
    sized = with_end.select("doc_id", "utf8_bytes", "ids", F.size("ids").alias("n_tokens"))
    placed = assign_shards(sized.select(F.lit(split).alias("split"), "doc_id", "n_tokens"), shard_tokens).select("doc_id", "shard")
    first = len(meta["splits"].get(split, {}).get("shards", []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        system.create_dir(base, recursive=True)
        current, handle, totals, out = None, None, [0, 0, 0], []

        def place(shard: int) -> str:
            return f"{base}/{shard_name(split, first + shard)}"

        def close() -> None:
            if handle is not None:
                handle.close()
                system.move(f"{place(current)}.partial", place(current))
                out.append((current, *totals))

        for batch in batches:
            for shard, ids, octets in zip(batch["shard"].to_pylist(), batch["ids"], batch["utf8_bytes"].to_pylist(), strict=True):
                if shard != current:
                    close()
                    current, totals = shard, [0, 0, 0]
                    handle = system.open_output_stream(f"{place(shard)}.partial")
                data = np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], dtype)
                handle.write(data.tobytes())
                totals = [totals[0] + len(data), totals[1] + 1, totals[2] + octets]
        close()
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "tokens", "documents", "utf8_bytes"])

    ready = sized.join(placed, "doc_id").repartition("shard").sortWithinPartitions("shard", "doc_id")
    written = ready.select("shard", "ids", "utf8_bytes").mapInArrow(run, "shard bigint, tokens bigint, documents bigint, utf8_bytes bigint")
    # One row per file.
    entries = [
        {"path": shard_name(split, first + r["shard"]), "tokens": r["tokens"], "documents": r["documents"], "utf8_bytes": r["utf8_bytes"], "synthetic": synthetic, "quarantine_tag": quarantine_tag}
        for r in sorted(written.collect(), key=lambda r: r["shard"])
    ]
    every = meta["splits"].get(split, {"shards": []})["shards"] + entries
    meta["splits"][split] = {k: sum(e[k] for e in every) for k in ("tokens", "documents", "utf8_bytes")} | {"shards": every}
    with system.open_output_stream(meta_path) as out:
        out.write(json.dumps(meta).encode())


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per shard of ``meta.json``."""
    raw = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(f"{root}/meta.json")
    splits = raw.select("dtype", F.explode("splits").alias("split", "info"))
    return splits.select("dtype", "split", F.explode("info.shards").alias("s")).select("dtype", "split", "s.*")


def read_tokens(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``(path, pos, token)`` of every token of a split."""
    index = read_index(spark, root).where(F.col("split") == split)
    row = index.select("dtype").first()
    if row is None:
        return spark.createDataFrame([], "path string, pos bigint, token bigint")
    dtype = row[0]
    files = shard_files(spark, root, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                data = np.frombuffer(content, dtype).astype(np.int64)
                for at in range(0, len(data), 100_000):
                    part = data[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["path", "pos", "token"])

    return files.select("path", "content").mapInArrow(run, "path string, pos bigint, token bigint")
