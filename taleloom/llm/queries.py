"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.llm import encode, mixing, near, overlap, packing, quality, residue
from taleloom.session import cut, read_table


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_pairs(read_table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train records that hold at least half of an evaluation record."""
    pairs = _overlaps(spark, sf_dir)
    return pairs.select(
        F.least("eval_id", "train_id").alias("doc_id_a"), F.greatest("eval_id", "train_id").alias("doc_id_b")
    ).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return overlap.report(_overlaps(spark, sf_dir))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each evaluation record the training split holds, and in what spans."""
    return overlap.record_coverage(read_table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose sets of 3-word sequences agree to 0.7."""
    return near.record_pairs(read_table(spark, sf_dir, "documents"), size=3, threshold=0.7)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and the number of links of every document with a near-duplicate."""
    return near.groups(read_table(spark, sf_dir, "documents"), size=3, threshold=0.7)


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shards = read_table(spark, sf_dir, "shards")
    return mixing.mix_rates(read_table(spark, sf_dir, "mix_targets"), shards, read_table(spark, sf_dir, "loop_iterations")), shards


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixing.short_sources(_rates(spark, sf_dir)[0])


def p3_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and available tokens of each mix row."""
    return _rates(spark, sf_dir)[0].select("mix_id", "source", "available", "real_tokens", "synthetic_tokens", "short")


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every shard that the mixes take."""
    rates, shards = _rates(spark, sf_dir)
    return mixing.copies(mixing.emit(rates, shards))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares."""
    rates, shards = _rates(spark, sf_dir)
    found = mixing.shares(rates, mixing.emit(rates, shards))
    rounded = ("wanted", "target_share", "actual_share", "actual_synthetic_share")
    return found.withColumns({c: F.round(c, 6) for c in rounded})


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(quality.outlier_scores(cut(_statistics(spark, sf_dir))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part no running text."""
    strict = read_table(spark, sf_dir, "quality_filters").where("filter_name = 'strict'").select("min_words").first()
    return quality.not_running(_scored(spark, sf_dir), strict[0] if strict else 20).select("doc_id").distinct()


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain statistics of every document against every named setting."""
    compared = quality.against_filters(_statistics(spark, sf_dir), read_table(spark, sf_dir, "quality_filters"))
    plain = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
    return compared.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in plain], "filter_name", "too_few_words", "mostly_non_alphabetic")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of running text, of different triples of words and of a looping phrase."""
    return _statistics(spark, sf_dir).select("doc_id", "language", *[F.round(c, 6).alias(c) for c in ("running_share", "distinct_triples", "looping")])


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlier score of every document."""
    return _scored(spark, sf_dir).select("doc_id", "language", "words", F.round("score", 6).alias("score"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, error messages or script notices."""
    return _residue(spark, sf_dir).select("doc_id").distinct()


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per reason."""
    return _residue(spark, sf_dir).groupBy("reason").agg(F.countDistinct("doc_id").alias("documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document's text."""
    return encode.encode_corpus(read_table(spark, sf_dir, "documents"))


def _containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The named capacities; a setting of a few rows."""
    rows = read_table(spark, sf_dir, "containers").orderBy("container_name").collect()
    return [(r["container_name"], r["capacity"]) for r in rows]


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a bin of every container."""
    sizes = encode.token_counts(read_table(spark, sf_dir, "documents"))
    return packing.pack(sizes, _containers(spark, sf_dir))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and unused share of every container."""
    return packing.usage(p7_assignments(spark, sf_dir), _containers(spark, sf_dir)).withColumn(
        "unused_share", F.round("unused_share", 6)
    )


_TRAIN = """
    SELECT path, min(corpus) AS corpus, min(source) AS source, max(coalesce(tokens, 0)) AS tokens,
           bool_or(coalesce(synthetic, FALSE)) AS synthetic
    FROM shards WHERE trim(lower(split)) = 'train' AND path IS NOT NULL GROUP BY path
"""
_SOURCES = f"""
    SELECT corpus, source, CAST(sum(CASE WHEN synthetic THEN 0 ELSE tokens END) AS BIGINT) AS real_tokens,
           CAST(sum(CASE WHEN synthetic THEN tokens ELSE 0 END) AS BIGINT) AS synthetic_tokens,
           count(*) FILTER (NOT synthetic) AS real_shards, count(*) FILTER (synthetic) AS synthetic_shards
    FROM ({_TRAIN}) GROUP BY corpus, source
"""
_HAVE = f"""
    SELECT t.*, coalesce(real_tokens, 0) AS real_tokens, coalesce(synthetic_tokens, 0) AS synthetic_tokens, coalesce(real_shards, 0) AS real_shards,
           coalesce(synthetic_shards, 0) AS synthetic_shards, coalesce(real_tokens, 0) + coalesce(synthetic_tokens, 0) AS available,
           CASE WHEN weights <> 0 THEN weight / weights * total_tokens ELSE 0 END AS wanted, f
    FROM mix_targets t JOIN (SELECT mix_id, sum(weight) AS weights FROM mix_targets GROUP BY mix_id) USING (mix_id)
    LEFT JOIN ({_SOURCES}) s ON t.corpus = s.corpus AND t.source = s.source
    LEFT JOIN (SELECT mix_id, max_by(proposal.synthetic_fraction, (finished_at, coalesce(proposal.synthetic_fraction, -1))) AS f FROM
        (SELECT * FROM loop_iterations WHERE finished_at IS NOT NULL) GROUP BY mix_id) l ON t.mix_id = l.mix_id
"""
_BOUNDED = f"""
    SELECT *, greatest(0.0::DOUBLE, taken - max_repeats * real_tokens) AS least, greatest(greatest(0.0::DOUBLE, taken - max_repeats * real_tokens),
        least(taken, (max_repeats * synthetic_tokens)::DOUBLE)) AS most FROM (SELECT *, least(wanted, (max_repeats * available)::DOUBLE) AS taken FROM ({_HAVE}))
"""
_SYNTHETIC = f"""
    SELECT *, CASE WHEN f IS NULL THEN greatest(least, least(most, CASE WHEN available > 0 THEN taken * synthetic_tokens / available ELSE 0.0::DOUBLE END))
        ELSE least + (CASE WHEN room > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (f * taken_all - least_all) / room)) ELSE 0.0::DOUBLE END) * (most - least) END AS made
    FROM (SELECT *, sum(most - least) OVER (PARTITION BY mix_id) AS room, sum(taken) OVER (PARTITION BY mix_id) AS taken_all,
            sum(least) OVER (PARTITION BY mix_id) AS least_all FROM ({_BOUNDED}))
"""
_RATED = f"""
    SELECT mix_id, corpus, source, FALSE AS synthetic, real_shards AS n,
        round(CASE WHEN real_tokens > 0 THEN least((taken - made) / real_tokens, max_repeats::DOUBLE) ELSE 0.0::DOUBLE END, 9) AS rate FROM ({_SYNTHETIC})
    UNION ALL SELECT mix_id, corpus, source, TRUE, synthetic_shards,
        round(CASE WHEN synthetic_tokens > 0 THEN least(made / synthetic_tokens, max_repeats::DOUBLE) ELSE 0.0::DOUBLE END, 9) FROM ({_SYNTHETIC})
"""
_EMITTED = f"""
    SELECT mix_id, source, path, tokens, synthetic, CAST(floor(rate) + floor(start + (rate - floor(rate)) * place) - floor(start + (rate - floor(rate)) * (place - 1)) AS INTEGER) AS copies
    FROM (SELECT r.mix_id, r.source, s.path, s.tokens, r.synthetic, r.rate, s.place,
            ('0x' || substr(md5(concat_ws(':', '0', r.mix_id, r.source, r.synthetic::VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
        FROM ({_RATED}) r JOIN (SELECT *, row_number() OVER (PARTITION BY corpus, source, synthetic ORDER BY tokens DESC, path) AS place FROM ({_TRAIN})) s
            ON r.corpus = s.corpus AND r.source = s.source AND r.synthetic = s.synthetic WHERE r.rate > 0)
"""
_PLAN = f"""
    SELECT t.mix_id, t.source, coalesce(real_tokens, 0) + coalesce(synthetic_tokens, 0) AS available,
           coalesce(real_tokens, 0) AS real_tokens, coalesce(synthetic_tokens, 0) AS synthetic_tokens,
           max_repeats * (coalesce(real_tokens, 0) + coalesce(synthetic_tokens, 0)) <
           CASE WHEN weights <> 0 THEN weight / weights * total_tokens ELSE 0 END AS short
    FROM mix_targets t JOIN (SELECT mix_id, sum(weight) AS weights FROM mix_targets GROUP BY mix_id) USING (mix_id)
    LEFT JOIN ({_SOURCES}) s ON t.corpus = s.corpus AND t.source = s.source
"""

_WORDS = r"""
    SELECT doc_id, CASE WHEN starts_with(s, 'train') THEN 'train' WHEN starts_with(s, 'val') OR starts_with(s, 'test') THEN 'eval' END AS side, w
    FROM (SELECT doc_id, lower(trim(split)) AS s, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)
    WHERE len(w) >= 20
"""


def _sequences(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT DISTINCT doc_id, side, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM ({_WORDS}))"


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_coverage": p2_coverage,
    "p3_found": p3_found,
    "p3_plan": p3_plan,
    "p3_copies": p3_copies,
    "p3_shares": p3_shares,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_statistics": p5_statistics,
    "p5_shares": p5_shares,
    "p5_scores": p5_scores,
    "p6_ids": p6_ids,
    "p7_assignments": p7_assignments,
    "p7_usage": p7_usage,
    "p8_found": p8_found,
    "p8_reasons": p8_reasons,
}

_BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STATISTICS = rf"""
    SELECT doc_id, len(w) AS words, round(chars / nullif(len(w), 0)::DOUBLE, 6) AS mean_word_length, round(1 - letters / nullif(chars, 0)::DOUBLE, 6) AS symbol_ratio, 1 - letters / nullif(chars, 0)::DOUBLE AS ratio,
        round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;,。！？"''”»)][{_BLANK}]*$')))::DOUBLE / nullif(len(lines), 0), 6) AS punctuated_lines,
        round(len(list_filter(w, lambda x: list_contains(common, lower(trim(x, '.,;:!?"''“”„«»()[]…—–-¿¡*_#|<>‘’')))))::DOUBLE / nullif(len(w), 0), 6) AS common_words
    FROM (SELECT doc_id, w, lines, length(array_to_string(w, '')) AS chars, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
            (SELECT list(DISTINCT lower(word)) FROM common_words WHERE word IS NOT NULL) AS common
        FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS lines FROM documents))
"""
_OVERLAPS = f"""
    WITH g AS ({_sequences(8)}), n AS (SELECT doc_id, count(*) AS n FROM g WHERE side = 'eval' GROUP BY doc_id),
    m AS (SELECT e.doc_id AS e, t.doc_id AS t, count(*) AS c FROM g e JOIN g t ON e.g = t.g AND e.side = 'eval' AND t.side = 'train' GROUP BY 1, 2)
"""

_PLACED = "SELECT doc_id, side, g, min(i) AS i FROM (" + _sequences(8).replace("SELECT DISTINCT doc_id, side,", "SELECT doc_id, side, i,") + ") GROUP BY 1, 2, 3"

SQL = {
    "p2_coverage": f"""
        WITH s AS MATERIALIZED ({_PLACED}), t AS (SELECT DISTINCT g FROM s WHERE side = 'train'),
        c AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s WHERE side = 'eval' AND g IN (SELECT g FROM t)),
        p AS (SELECT doc_id, count(*) AS k FROM c GROUP BY doc_id, island)
        SELECT p.doc_id, CAST(any_value(n) AS INTEGER) AS sequences, CAST(sum(k) AS INTEGER) AS covered, CAST(count(*) AS INTEGER) AS spans, CAST(max(k) + 7 AS INTEGER) AS longest
        FROM p JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) q ON p.doc_id = q.doc_id GROUP BY p.doc_id""",
    "p3_copies": f"SELECT mix_id, source, path, tokens, synthetic, CAST(unnest(range(copies)) AS INTEGER) AS copy FROM ({_EMITTED}) WHERE copies > 0",
    "p3_shares": f"""
        SELECT h.mix_id, h.source, round(wanted, 6) AS wanted, max_repeats * available < wanted AS short, CAST(coalesce(e, 0) AS BIGINT) AS emitted_tokens,
            round(CASE WHEN total_tokens > 0 THEN wanted / total_tokens END, 6) AS target_share,
            round(CASE WHEN sum(coalesce(e, 0)) OVER w > 0 THEN coalesce(e, 0) / (sum(coalesce(e, 0)) OVER w)::DOUBLE END, 6) AS actual_share, f AS synthetic_fraction,
            round(CASE WHEN sum(coalesce(e, 0)) OVER w > 0 THEN (sum(coalesce(m, 0)) OVER w)::DOUBLE / (sum(coalesce(e, 0)) OVER w)::DOUBLE END, 6) AS actual_synthetic_share
        FROM ({_HAVE}) h LEFT JOIN (SELECT mix_id, source, sum(copies * tokens) AS e, sum(CASE WHEN synthetic THEN copies * tokens ELSE 0 END) AS m
            FROM ({_EMITTED}) WHERE copies > 0 GROUP BY 1, 2) g ON h.mix_id = g.mix_id AND h.source = g.source WINDOW w AS (PARTITION BY h.mix_id)""",
    "p2_found": f"{_OVERLAPS} SELECT least(e, t) AS doc_id_a, greatest(e, t) AS doc_id_b FROM m JOIN n ON e = n.doc_id WHERE 2 * c >= n",
    "p2_report": f"""
        {_OVERLAPS} SELECT regexp_extract(lower(trim(d.split)), '^(train|val|test)', 1) AS eval_split, d.source AS eval_source,
            count(DISTINCT e) AS records, count(*) AS pairs
        FROM m JOIN n ON e = n.doc_id JOIN documents d ON d.doc_id = e WHERE 2 * c >= n GROUP BY 1, 2""",
    "p5_statistics": f"""
        SELECT doc_id, CAST(words AS INTEGER) AS words, mean_word_length, symbol_ratio, punctuated_lines, common_words, filter_name,
            words < min_words AS too_few_words, ratio > max_non_alpha_ratio AS mostly_non_alphabetic FROM ({_STATISTICS}), quality_filters""",
    "p4_groups": f"""
        WITH RECURSIVE g AS ({_sequences(3)}), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        p AS MATERIALIZED (SELECT a, b FROM m JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 10 * c >= 7 * (p.n + q.n - c)),
        l AS MATERIALIZED (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, other) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
        SELECT r.doc_id, least(r.doc_id, min(r.other)) AS class_id, CAST(any_value(k) AS BIGINT) AS links
        FROM r JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) c ON c.x = r.doc_id GROUP BY r.doc_id""",
    "p4_found": f"""
        WITH g AS ({_sequences(3)}), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
        SELECT a AS doc_id_a, b AS doc_id_b FROM m JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 10 * c >= 7 * (p.n + q.n - c)""",
    "p3_found": f"SELECT mix_id, source FROM ({_PLAN}) WHERE short",
    "p3_plan": f"SELECT mix_id, source, available, real_tokens, synthetic_tokens, short FROM ({_PLAN})",
}
