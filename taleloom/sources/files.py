"""Raw corpora, file digests, manifests and JSON lines."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.functions import text as T

MANIFEST_ENTRY = "name STRING, url STRING, licence STRING, description STRING, sha256 STRING, expected_bytes BIGINT, actual_bytes BIGINT, local_path STRING, retrieved_at STRING, stage INT"
CHUNK = 1 << 20


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole files; invalid UTF-8 becomes U+FFFD."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.decode("utf-8", "replace") for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], ["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def split_into_documents(raw: DataFrame, max_documents: int | None = None) -> DataFrame:
    """``(path, ord, text)``: parts between separator tokens where there are any, else between blank lines; stripped, none empty."""
    parts = F.when(F.contains("text", F.lit(T.SEPARATOR)), F.split("text", r"\Q" + T.SEPARATOR + r"\E")).otherwise(F.split("text", "\n\n"))
    rows = raw.select("path", F.posexplode(parts).alias("ord", "text")).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    return rows if max_documents is None else rows.orderBy("path", "ord").limit(max_documents)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that end in a line feed; a carriage return stays."""
    return spark.read.option("lineSep", "\n").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source."""
    schema = f"version INT, sources MAP<STRING, STRUCT<{MANIFEST_ENTRY.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' INT', ': INT')}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("sources").alias("key", "s")).select("key", "s.*")


def upsert(entries: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """New entries replace those of the same key."""
    return entries.join(new.select(key), key, "left_anti").unionByName(new)


def verify_sources(registry: DataFrame, digests: DataFrame) -> DataFrame:
    """Registered sources beside the files found, with ``ok`` (null where nothing was expected)."""
    found = digests.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("sha256").alias("actual"), F.col("bytes").alias("actual_bytes"))
    both = registry.join(found, registry["name"] == F.regexp_replace(found["file"], r"\.[^.]+$", ""), "left")
    return both.select("name", "actual", "actual_bytes", ((F.col("sha256") == F.col("actual")) & F.coalesce(F.col("expected_bytes") == F.col("actual_bytes"), F.lit(True))).alias("ok"))


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def fetch(source: dict, dest_dir: str, force: bool = False) -> Path:
    """Download to a partial file, check size and digest, rename, note it in the manifest.

    A file that is there is not fetched again: it is noted if it has the registered digest, or that of the manifest, or if
    none is known; with another digest it is an error, as results that were computed from it need another look.
    """
    folder = Path(dest_dir)
    folder.mkdir(parents=True, exist_ok=True)
    manifest_path = folder / "MANIFEST.json"
    manifest = json.loads(manifest_path.read_text()) if manifest_path.exists() else {"version": 1, "sources": {}}
    target = folder / (source["name"] + Path(source["url"]).suffix)
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def note(digest: str) -> Path:
        manifest["sources"][source["name"]] = {**source, "sha256": digest, "actual_bytes": target.stat().st_size, "local_path": str(target), "retrieved_at": stamp}
        manifest_path.write_text(json.dumps(manifest, indent=2))
        return target

    known = source.get("sha256") or digest_for(manifest, source["name"])
    if target.exists() and not force:
        digest = sha256_file(str(target))
        if known and digest != known:
            raise ValueError(f"{target} has the digest {digest}, known is {known}; remove it to fetch it again")
        return note(digest)
    partial = target.with_name(target.name + ".partial")
    try:
        with urlopen(source["url"]) as reply, open(partial, "wb") as out:
            shutil.copyfileobj(reply, out, CHUNK)
        digest, size = sha256_file(str(partial)), partial.stat().st_size
        if source.get("sha256") and digest != source["sha256"]:
            raise ValueError(f"{source['name']}: digest {digest} is not the expected one")
        if source.get("expected_bytes") and size != source["expected_bytes"]:
            raise ValueError(f"{source['name']}: {size} bytes, {source['expected_bytes']} expected")
        partial.rename(target)
    finally:
        partial.unlink(missing_ok=True)
    return note(digest)


def digest_for(manifest: dict, name: str) -> str | None:
    """The recorded digest of a source."""
    return manifest["sources"].get(name, {}).get("sha256")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Absent keys are null; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, files, bytes)`` of everything under a path, per folder and in all (a null folder); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.rollup(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, step)`` of the checkpoints ``step-N`` of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"/(step-\d+)(?:\.[^/]*|/.*)?$", 1)
    return files.select(name.alias("name")).where("name <> ''").distinct().withColumn("step", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint"))


def latest_checkpoint(found: DataFrame) -> DataFrame:
    """The checkpoint of the largest step, by number."""
    return found.orderBy(F.desc("step"), "name").limit(1)


def save_checkpoint(state: DataFrame, folder: str, step: int, keep: int | None = None) -> None:
    """Named arrays of a step as Parquet in ``step-N``; a step that is there is an error. Older ones beyond ``keep`` are removed."""
    state.write.mode("error").parquet(f"{folder.rstrip('/')}/step-{step}")
    if keep is None:
        return
    spark = state.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in rotate(checkpoints(spark, folder), keep).collect():  # names of a folder's checkpoints
        old = hadoop(f"{folder.rstrip('/')}/{row['name']}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def load_checkpoint(spark: SparkSession, folder: str, step: int | None = None) -> DataFrame:
    """The state of a step, or of the latest one."""
    if step is None:
        row = latest_checkpoint(checkpoints(spark, folder)).first()
        if row is None:
            raise ValueError(f"no checkpoint in {folder}")
        step = row["step"]
    return spark.read.parquet(f"{folder.rstrip('/')}/step-{step}")


def write_evaluation(evaluation: DataFrame, path: str) -> None:
    """An evaluation of one row as one JSON object per line."""
    evaluation.coalesce(1).write.mode("overwrite").json(path)


def rotate(checkpoints: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """Checkpoints ``step-N`` beyond the newest ``keep``, by number."""
    step = F.regexp_extract(F.col(name), r"^step-(\d+)$", 1)
    numbered = checkpoints.where(F.col(name).rlike(r"^step-\d+$")).withColumn("step", step.cast("bigint"))
    newest = numbered.orderBy(F.desc("step"), name).limit(keep).select(name)
    return numbered.join(newest, name, "left_anti")
