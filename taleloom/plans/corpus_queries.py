"""Curation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.operators import curate, minhash
from taleloom.operators.components import components
from taleloom.session import read_table, spread

PERMS, BANDS, THRESHOLD = 32, 8, 0.8

# The classes of functions/text.py in the notation of SQL's regular expressions.
_BLANKS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in enough partitions for work on whole texts; large inputs have them anyway."""
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.curated_columns(_documents(spark, sf_dir), F.coalesce("source", F.lit("unknown")))


def doc_hash_split(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null").withColumn("digest", curate.document_hash(F.col("text")))
    return docs.select("doc_id", "digest", curate.split_of(F.col("digest")).alias("content_split"))


def curated_columns(spark, sf_dir):
    return _curated(spark, sf_dir).drop("text")


def corpus_stats(spark, sf_dir):
    return curate.corpus_stats(_curated(spark, sf_dir)).withColumn("mean_chars", F.round("mean_chars", 6))


def split_counts(spark, sf_dir):
    return _curated(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("documents"))


def exact_dedup(spark, sf_dir):
    return curate.exact_dedup(_documents(spark, sf_dir))


def quality_reason(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", F.coalesce(curate.reject_reason(F.col("text")), F.lit("kept")).alias("reason"))


def rejection_counts(spark, sf_dir):
    return quality_reason(spark, sf_dir).where("reason <> 'kept'").groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def curation_funnel(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null").select("doc_id", "text")
    unique = docs.join(curate.exact_dedup(docs).select("doc_id"), "doc_id", "left_semi")
    passed = unique.where(curate.reject_reason(F.col("text")).isNull())
    stages = curate.funnel([("input", docs), ("exact_duplicates", unique), ("quality", passed)])
    return stages.withColumn("removed_percent", F.round("removed_percent", 6))


def leakage_matrix(spark, sf_dir):
    """Texts that stand in several of the recorded splits."""
    docs = _documents(spark, sf_dir).where("text is not null and split is not null")
    return curate.leakage(docs.select(F.substring(F.sha2("text", 256), 1, 16).alias("id"), F.lower(F.trim("split")).alias("split")))


def length_histogram(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null")
    return docs.groupBy((F.length("text") / 1000).alias("kilochars")).agg(F.count(F.lit(1)).alias("documents"))


def length_bins(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null")
    return docs.groupBy(F.floor(F.length("text") / 1000).alias("bin")).agg(F.count(F.lit(1)).alias("documents"))


def _signed(spark, sf_dir):
    return minhash.signatures(_documents(spark, sf_dir), PERMS, exact=False)


def minhash31_signatures(spark, sf_dir):
    return _signed(spark, sf_dir)


def lsh_candidates(spark, sf_dir):
    return minhash.candidates(minhash.classes(_signed(spark, sf_dir)), PERMS, BANDS)


def near_dup_pairs(spark, sf_dir):
    return minhash.near_pairs(minhash.classes(_signed(spark, sf_dir)), PERMS, THRESHOLD, BANDS)


def dup_components(spark, sf_dir):
    return components(near_dup_pairs(spark, sf_dir))


def dup_groups(spark, sf_dir):
    return minhash.duplicate_groups(_signed(spark, sf_dir), PERMS, THRESHOLD, BANDS)


def minhash_exact_groups(spark, sf_dir):
    return minhash.duplicate_groups(minhash.signatures(_documents(spark, sf_dir)), 64, 0.85)


def curated_documents(spark, sf_dir):
    return minhash.curate(_documents(spark, sf_dir))["kept"].select("doc_id")


def curation_stages(spark, sf_dir):
    return minhash.curate(_documents(spark, sf_dir))["stages"]


QUERIES = {
    f.__name__: f
    for f in (
        doc_hash_split, curated_columns, corpus_stats, split_counts, exact_dedup, quality_reason, rejection_counts, curation_funnel,
        leakage_matrix, length_histogram, length_bins, minhash31_signatures, lsh_candidates, near_dup_pairs, dup_components, dup_groups,
        minhash_exact_groups, curated_documents, curation_stages,
    )
}

_SPLIT = """CASE WHEN bucket < 10 THEN 'val' WHEN bucket < 20 THEN 'test' ELSE 'train' END"""
_HASHED = """SELECT *, sha256(text) AS digest, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 1000 AS bucket FROM documents WHERE text IS NOT NULL"""
_CURATED = rf"""
    SELECT substr(digest, 1, 16) AS id, coalesce(source, 'unknown') AS source, CAST(length(text) AS BIGINT) AS chars,
           CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
           CAST(len(regexp_extract_all(text, '[^{_BLANKS}]+')) AS BIGINT) AS words, {_SPLIT} AS split
    FROM ({_HASHED})
"""
_REASON = rf"""
    SELECT doc_id, text, CASE
        WHEN length(text) < 16 THEN 'too_short'
        WHEN len(regexp_extract_all(text, '[^{_BLANKS}]+')) < 3 THEN 'too_few_words'
        WHEN len(lines) > 2 AND list_max(map_values(list_histogram(lines))) / len(lines) > 0.5 THEN 'repetitive_lines'
        WHEN length(regexp_replace(text, '[^\p{{L}}{_BLANKS}]', '', 'g')) / length(text) < 1.0::DOUBLE - 0.6::DOUBLE THEN 'mostly_non_alphabetic'
        WHEN regexp_matches(text, '{_CONTROL}') THEN 'control_characters' ELSE 'kept' END AS reason
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_BREAK}'), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS lines
          FROM documents WHERE text IS NOT NULL)
"""
_MINIMA = ",\n".join(f"min(({a} * h + {b}) % 2147483647)" for a, b in minhash.draws31(PERMS))
_SIGNED = f"""
    SELECT doc_id, [{_MINIMA}] AS signature FROM (
        SELECT doc_id, ('0x' || substr(md5(g), 1, 15))::BIGINT % 2147483647 AS h FROM (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 7, 1) + 1), lambda i: substr(text, i, 8))) AS g
            FROM documents WHERE text IS NOT NULL)
    ) GROUP BY doc_id
"""
_CLASSES = f"SELECT signature, min(doc_id) AS rep, count(*) AS documents FROM ({_SIGNED}) GROUP BY signature"
_BANDED = f"""
    SELECT rep, band, signature[band * {PERMS // BANDS} + 1 : (band + 1) * {PERMS // BANDS}] AS key, signature
    FROM classes, range({BANDS}) r(band)
"""
_CANDIDATES = "SELECT DISTINCT l.rep AS a, r.rep AS b FROM banded l JOIN banded r ON l.band = r.band AND l.key = r.key AND l.rep < r.rep"
_WITH = f"classes AS ({_CLASSES}), banded AS ({_BANDED}), candidates AS ({_CANDIDATES})"
_PAIRS = f"""
    SELECT a, b, similarity FROM (
        SELECT a, b, len(list_filter(range(1, {PERMS + 1}), lambda i: x.signature[i] = y.signature[i])) / {PERMS}.0::DOUBLE AS similarity
        FROM candidates JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b
    ) WHERE similarity >= {THRESHOLD}
"""
_COMPONENTS = """
    SELECT node, min(other) AS component FROM (
        SELECT node, node AS other FROM reach UNION SELECT node, other FROM reach
    ) GROUP BY node
"""
_REACH = f"""
    pairs AS ({_PAIRS}),
    links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
    reach(node, other) AS (SELECT x, y FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other)
"""

SQL = {
    "doc_hash_split": f"SELECT doc_id, digest, {_SPLIT} AS content_split FROM ({_HASHED})",
    "curated_columns": _CURATED,
    "corpus_stats": f"""SELECT count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(words) AS BIGINT) AS words,
        min(chars) AS min_chars, max(chars) AS max_chars, round(avg(chars), 6) AS mean_chars, CAST(median(chars) AS DOUBLE) AS median_chars,
        CAST(quantile_cont(chars, 0.95) AS DOUBLE) AS p95_chars, count(DISTINCT id) AS distinct_documents,
        count(*) - count(DISTINCT id) AS duplicates FROM ({_CURATED})""",
    "split_counts": f"SELECT split, count(*) AS documents FROM ({_CURATED}) GROUP BY split",
    "exact_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "quality_reason": f"SELECT doc_id, reason FROM ({_REASON})",
    "rejection_counts": f"SELECT reason, count(*) AS documents FROM ({_REASON}) WHERE reason <> 'kept' GROUP BY reason",
    "curation_funnel": f"""
        WITH judged AS ({_REASON}), first AS (SELECT min(doc_id) AS doc_id FROM judged GROUP BY text),
        n AS (SELECT (SELECT count(*) FROM judged) AS a, (SELECT count(*) FROM first) AS b,
                     (SELECT count(*) FROM judged JOIN first USING (doc_id) WHERE reason = 'kept') AS c)
        SELECT 0 AS at, 'input' AS stage, a AS remaining, 0::BIGINT AS removed, 0.0::DOUBLE AS removed_percent FROM n
        UNION ALL SELECT 1, 'exact_duplicates', b, a - b, round(100.0::DOUBLE * (a - b) / a, 6) FROM n
        UNION ALL SELECT 2, 'quality', c, b - c, round(100.0::DOUBLE * (a - c) / a, 6) FROM n""",
    "leakage_matrix": """
        WITH s AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS id, lower(trim(split)) AS split FROM documents
                   WHERE text IS NOT NULL AND split IS NOT NULL)
        SELECT x.split AS split_a, y.split AS split_b, count(*) AS shared FROM s x JOIN s y ON x.id = y.id AND x.split < y.split GROUP BY 1, 2""",
    "length_histogram": "SELECT length(text) / 1000 AS kilochars, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "length_bins": "SELECT CAST(length(text) // 1000 AS BIGINT) AS bin, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "minhash31_signatures": _SIGNED,
    "lsh_candidates": f"WITH {_WITH} SELECT * FROM candidates",
    "near_dup_pairs": f"WITH {_WITH} SELECT * FROM ({_PAIRS})",
    "dup_components": f"WITH RECURSIVE {_WITH}, {_REACH} {_COMPONENTS}",
    "dup_groups": f"""
        WITH RECURSIVE signed AS ({_SIGNED}), {_WITH}, {_REACH}, comp AS ({_COMPONENTS}),
        near AS (SELECT x AS rep, sum(documents) AS others FROM links JOIN classes ON rep = y GROUP BY x)
        SELECT s.doc_id, coalesce(comp.component, c.rep) AS component, CAST(c.documents - 1 + coalesce(others, 0) AS BIGINT) AS links
        FROM signed s JOIN classes c ON s.signature = c.signature LEFT JOIN comp ON comp.node = c.rep LEFT JOIN near ON near.rep = c.rep
        WHERE c.documents > 1 OR comp.node IS NOT NULL""",
}
