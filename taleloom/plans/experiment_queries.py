"""Queries over runs, metrics, loops, shards, token sequences and stored vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions import text as T
from taleloom.operators import arms, bpe, expstats, gates, lineage, logits, runs, shards, tasks
from taleloom.session import read_table, spread

R6 = 6
#: The vocabulary sizes of the reference's sweep.
SWEEP = (256, 512, 1024, 2048, 4096, 8192)


def _rounded(frame, *columns):
    return frame.withColumns({c: F.round(c, R6) for c in columns})


# Tokenizer and shards -----------------------------------------------------------------------


def letter_chunk_freq(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    words = F.explode(F.regexp_extract_all("text", F.lit(r" ?[a-zA-Z]+"), 0))
    return docs.select(words.alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def chunk_freq(spark, sf_dir):
    return bpe.chunk_counts(read_table(spark, sf_dir, "documents"))


def pair_counts(spark, sf_dir):
    return bpe.pair_counts(letter_chunk_freq(spark, sf_dir))


def byte_pair_counts(spark, sf_dir):
    """Adjacent bytes in all pre-tokens of whole texts."""
    return bpe.pair_counts(chunk_freq(spark, sf_dir))


def best_byte_pair(spark, sf_dir):
    return bpe.best_pair(byte_pair_counts(spark, sf_dir))


def best_pair(spark, sf_dir):
    return bpe.best_pair(pair_counts(spark, sf_dir))


def bpe_compression(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    return bpe.compression(docs, bpe.train(docs, 512))


def vocabulary_sweep(spark, sf_dir):
    return bpe.vocabulary_sweep(spread(read_table(spark, sf_dir, "documents"), "doc_id"), SWEEP)


def alphabet(spark, sf_dir):
    return bpe.alphabet(read_table(spark, sf_dir, "documents"))


def _word_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.substring(F.sha2("text", 256), 1, 1).alias("split"), "doc_id", F.length("text").alias("n_tokens"))


def shard_packing(spark, sf_dir):
    return shards.assign_shards(_word_counts(spark, sf_dir), 20_000).select("split", "doc_id", "shard")


def shard_rollup(spark, sf_dir):
    return shards.shard_totals(read_table(spark, sf_dir, "shards").select(F.col("corpus").alias("split"), F.col("source").alias("shard"), F.col("tokens").alias("n_tokens")))


def split_summary(spark, sf_dir):
    return _rounded(shards.split_summary(read_table(spark, sf_dir, "shards")), "bytes_per_token", "synthetic_share")


def untagged_shards(spark, sf_dir):
    return shards.validate_synthetic(read_table(spark, sf_dir, "shards")).select("path", "corpus", "source")


def windows_packed(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("token"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    packed = shards.windows(events.withColumn("pos", place), 8, "user_id")
    return packed.select("user_id", "window", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


def diversity(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(":", "event_type", F.floor("value").cast("string")).alias("token"))
    return _rounded(logits.diversity(events, "user_id", "event_id", "token", 100), "distinct_1", "distinct_2", "distinct_3", "vocabulary_fraction")


def frequent_tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("token"))
    return logits.frequent_tokens(docs, "token", 50)


def bigram_model(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    events = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("prev"), F.lead("event_type").over(order).alias("next"))
    return _rounded(logits.bigram_bits(events.where("next is not null"), "prev", "next"), "bits")


def split_on_separator(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = logits.split_on_separator(events, "user_id", "event_id", "event_type", "purchase")
    return out.select("user_id", F.col("document").cast("bigint").alias("document"), F.array_join("tokens", " ").alias("tokens"))


# Experiments --------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    return read_table(spark, sf_dir, "runs")


def _groups(spark, sf_dir):
    return runs.seed_groups(_runs(spark, sf_dir))


def metrics_unpivot(spark, sf_dir):
    wide = _runs(spark, sf_dir).select("run_id", "best_bpb", "best_loss", "final_train_loss", "tokens_per_sec", "wall_clock")
    return wide.unpivot("run_id", wide.columns[1:], "key", "value").where("value is not null")


def seed_groups(spark, sf_dir):
    return _rounded(_groups(spark, sf_dir).drop("values"), "mean", "std", "sem", "spread")


def noise_floor(spark, sf_dir):
    return _rounded(runs.noise_floor(_groups(spark, sf_dir)), "floor")


def leaderboard(spark, sf_dir):
    return runs.leaderboard(_runs(spark, sf_dir))


def best_so_far(spark, sf_dir):
    return runs.best_so_far(read_table(spark, sf_dir, "metrics"))


def last_values(spark, sf_dir):
    return runs.last_values(read_table(spark, sf_dir, "metrics"))


def orphan_metrics(spark, sf_dir):
    """Metric rows of runs that are not registered, counted per run."""
    metrics = read_table(spark, sf_dir, "metrics").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return metrics.join(_runs(spark, sf_dir).select("run_id"), "run_id", "left_anti")


def _rung_groups(spark, sf_dir):
    """The best run of each rung and residue of the seed: at most five values a rung, as SQL can enumerate."""
    few = _runs(spark, sf_dir).where("rung is not null and seed is not null")
    per = few.groupBy("rung", F.pmod("seed", F.lit(5)).alias("seed")).agg(F.min("best_bpb").alias("best_bpb")).where("best_bpb is not null")
    return runs.seed_groups(per.withColumn("name", F.col("rung")), group_by="rung", strip_seed_suffix=False)


def _whole_groups(spark, sf_dir):
    """All runs of each rung."""
    return runs.seed_groups(_runs(spark, sf_dir), group_by="rung", strip_seed_suffix=False)


def _compared(groups, tasks=None):
    """Every two groups; with ``tasks`` they are dealt out to so many, as large groups take seconds a pair."""
    sides = [groups.select(*[F.col(c).alias(f"{c}_{s}") for c in ("label", "mean", "std", "values")]) for s in "ab"]
    pairs = sides[0].join(sides[1], F.col("label_a") < F.col("label_b"))
    return expstats.compare(pairs.repartition(tasks) if tasks else pairs)


def _p_values(groups, tasks=None):
    return _rounded(_compared(groups, tasks).select("label_a", "label_b", "p_value", "min_p"), "p_value", "min_p")


def _verdicts(groups, tasks=None):
    return _rounded(_compared(groups, tasks).select("label_a", "label_b", "difference", "effect", "winner", "verdict"), "difference", "effect")


def permutation_exact(spark, sf_dir):
    return _p_values(_rung_groups(spark, sf_dir))


def verdicts(spark, sf_dir):
    return _verdicts(_rung_groups(spark, sf_dir))


def permutation_whole(spark, sf_dir):
    return _p_values(_whole_groups(spark, sf_dir), spark.sparkContext.defaultParallelism)


def verdicts_whole(spark, sf_dir):
    return _verdicts(_whole_groups(spark, sf_dir), spark.sparkContext.defaultParallelism)


def _cells(spark, sf_dir, parity=None):
    base = _runs(spark, sf_dir).where("best_bpb is not null")
    if parity is not None:
        base = base.where(F.pmod("seed", F.lit(2)) == parity)
    return expstats.cells(base, ["rung", "n_layer"], "best_bpb")


def cell_means(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir), "mean", "std")


def regime_pivot(spark, sf_dir):
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations"))
    rows = loops.withColumn("bin", F.concat(F.lit("f"), F.floor(F.col("synthetic_fraction") * 4).cast("string")))
    pivot = rows.groupBy("iteration").pivot("bin", ["f0", "f1", "f2", "f3"]).agg(F.avg("val_bpb"))
    return _rounded(pivot, "f0", "f1", "f2", "f3")


def regimes(spark, sf_dir):
    p = read_table(spark, sf_dir, "loop_iterations").select(F.col("proposal.temperature").alias("t"), F.col("proposal.top_k").alias("k"))
    return p.groupBy(expstats.regime(F.col("t"), F.col("k")).alias("regime")).agg(F.count(F.lit(1)).alias("rows"))


def cells_full_outer(spark, sf_dir):
    found = expstats.outer_cells(_cells(spark, sf_dir, 0), _cells(spark, sf_dir, 1), ["rung", "n_layer"])
    return _rounded(found, "old_mean", "new_mean", "difference", "own_std")


def against_control(spark, sf_dir):
    found = expstats.against_control(_cells(spark, sf_dir).where("rung is not null"), "rung", "v5_rope", ["n_layer"])
    return _rounded(found.select("rung", "n_layer", "mean", "control_mean", "difference"), "mean", "control_mean", "difference")


def drift_first_last(spark, sf_dir):
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations"))
    found = expstats.drift(expstats.cells(loops, ["loop_id", "iteration"], "val_bpb"), ["loop_id"], "iteration")
    return _rounded(found, "first", "last", "drift")


def promotion_rates(spark, sf_dir):
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations"))
    return _rounded(expstats.promotion_rates(loops), "rate")


def rejection_reasons(spark, sf_dir):
    return expstats.rejection_reasons(expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations")))


def rejections_by_fraction(spark, sf_dir):
    return expstats.rejections_by_fraction(expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations")))


def relative_drop(spark, sf_dir):
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations")).where("val_bpb is not null")
    return _rounded(expstats.relative_drop(loops, "loop_id", "iteration", "val_bpb", 0.01), "drop")


def _chains(spark, sf_dir):
    docs = read_table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(500)).alias("chain"), "o_orderkey", F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}')).alias("payload"))
    return lineage.link(docs, "chain", "o_orderkey", "payload")


def lineage_chain(spark, sf_dir):
    return _chains(spark, sf_dir)


def lineage_verify(spark, sf_dir):
    """Chains of which every seventh was tampered with."""
    broken = (F.pmod("chain", F.lit(7)) == 0) & (F.col("index") == 2)
    return lineage.verify(_chains(spark, sf_dir).withColumn("payload", F.when(broken, F.lit("{}")).otherwise(F.col("payload"))), "chain")


def gate_results(spark, sf_dir):
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations"))
    stats = loops.withColumn("coverage", F.lit(1) - F.col("synthetic_fraction")).withColumn("distinct_3", F.col("val_bpb") / 20)
    checks = {
        "no_regression": gates.no_regression(F.col("val_bpb"), F.col("incumbent_bpb")),
        "diversity": gates.diversity_floor(F.col("coverage"), F.col("distinct_3"), F.lit(None).cast("double"), F.lit(1) - F.col("synthetic_fraction"), F.col("synthetic_fraction").isNotNull(), 0.9, 0.11),
    }
    out = stats.withColumn("gate", gates.gate(checks))
    return out.select("loop_id", "iteration", F.col("gate.passed").alias("passed"), F.array_join("gate.failed", ",").alias("failed"))


def gate_quarantine(spark, sf_dir):
    return gates.quarantined(read_table(spark, sf_dir, "shards"), "corpus")


# Vectors as logits --------------------------------------------------------------------------


def _predicted(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.pmod("label", F.size("embedding")).alias("target"))
    return logits.predictions(rows, "embedding", "target")


def logit_surprisal(spark, sf_dir):
    found = _predicted(spark, sf_dir).select("vec_id", "surprisal", "entropy", F.col("rank").cast("bigint").alias("rank"))
    return _rounded(found, "surprisal", "entropy")


def topk_tokens(spark, sf_dir):
    found = _predicted(spark, sf_dir).select("vec_id", F.posexplode("top").alias("place", "t"))
    return _rounded(found.select("vec_id", "place", F.col("t.token").alias("token"), F.col("t.probability").alias("probability")), "probability")


def evaluation(spark, sf_dir):
    found = logits.evaluation(_predicted(spark, sf_dir), F.floor(F.col("vec_id") / 64))
    return _rounded(found, "bits_per_token", "loss", "perplexity", "accuracy", "accuracy_5")


def learning_rates(spark, sf_dir):
    steps = read_table(spark, sf_dir, "metrics").where("step is not null and step >= 0").select("step").distinct()
    return _rounded(steps.select("step", logits.learning_rate(F.col("step"), 2000, 100, 0.003).alias("lr")), "lr")


# Corpora and tasks --------------------------------------------------------------------------


def arm_mix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    real, made = docs.where("source not like 'gen-%'"), docs.where("source like 'gen-%'")
    return arms.anchor(real, [made], 0.5, 7).select("doc_id")


def arm_accumulate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return arms.accumulate(docs.where("source not like 'gen-%'"), [docs.where("source like 'gen-%'")]).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def search_grid(spark, sf_dir):
    return tasks.search_grid(spark)


def task_examples(spark, sf_dir):
    made = [tasks.examples(spark, name, 500).select(F.lit(name).alias("task"), "*") for name in tasks.TASKS]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def visible_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "sources")
    return docs.select("name", T.visible(F.col("description")).alias("shown"))


def events_per_window(spark, sf_dir):
    """Tumbling windows, as the streaming operator makes them."""
    events = read_table(spark, sf_dir, "events")
    counted = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.unix_timestamp("w.start").alias("start"), "event_type", "events")


QUERIES = {
    f.__name__: f
    for f in (
        letter_chunk_freq, chunk_freq, pair_counts, best_pair, byte_pair_counts, best_byte_pair, bpe_compression, vocabulary_sweep, alphabet, shard_packing, shard_rollup,
        split_summary, untagged_shards, windows_packed, diversity, frequent_tokens, bigram_model, split_on_separator, metrics_unpivot,
        seed_groups, noise_floor, leaderboard, best_so_far, last_values, orphan_metrics, permutation_exact, verdicts, permutation_whole,
        verdicts_whole, cell_means,
        regime_pivot, regimes, cells_full_outer, against_control, drift_first_last, promotion_rates, rejection_reasons,
        rejections_by_fraction, relative_drop, lineage_chain, lineage_verify, gate_results, gate_quarantine, logit_surprisal, topk_tokens,
        evaluation, learning_rates, arm_mix, arm_accumulate, search_grid, task_examples, visible_text, events_per_window,
    )
}
_ONE = """
    SELECT loop_id, iteration, unnest(arg_max(struct_pack(val_bpb := val_bpb, incumbent_bpb := incumbent_bpb, promoted := promoted, reasons := reasons,
        synthetic_fraction := proposal.synthetic_fraction, steps := proposal.steps), (finished_at, -coalesce(val_bpb, 1e300))))
    FROM loop_iterations GROUP BY loop_id, iteration
"""
_CHUNKS = "SELECT chunk, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[a-zA-Z]+')) AS chunk FROM documents) GROUP BY chunk"
_BYTE_PAIRS = f"""
    SELECT ascii(substr(chunk, i, 1)) AS a, ascii(substr(chunk, i + 1, 1)) AS b, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT chunk, n, unnest(range(1, length(chunk))) AS i FROM ({_CHUNKS})) GROUP BY 1, 2
"""
# Pre-tokens of whole texts: a run of blanks gives its last one to the word behind it, so a mark that no text holds is set before that.
_BLANK = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = r"\x{10fffe}"
_PRETOKENS = rf"""
    SELECT chunk, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(regexp_replace(text, '([{_BLANK}])([{_BLANK}][^{_BLANK}])', '\1' || chr(1114110) || '\2', 'g'),
            '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}{_MARK}]+|[{_BLANK}]+')) AS chunk FROM documents) GROUP BY chunk
"""
_WHOLE_PAIRS = f"""
    SELECT ('0x' || substr(h, i, 2))::INTEGER AS a, ('0x' || substr(h, i + 2, 2))::INTEGER AS b, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT h, n, unnest(range(1, length(h) - 2, 2)) AS i FROM (SELECT hex(encode(chunk)) AS h, n FROM ({_PRETOKENS}))) GROUP BY 1, 2
"""
_GROUPS = """
    SELECT regexp_replace(name, '-s[0-9]+$', '') AS label, count(*) AS n, avg(best_bpb) AS mean, coalesce(stddev_samp(best_bpb), 0) AS std,
           coalesce(stddev_samp(best_bpb), 0) / sqrt(count(*)) AS sem, max(best_bpb) - min(best_bpb) AS spread
    FROM runs WHERE best_bpb IS NOT NULL AND name IS NOT NULL GROUP BY 1
"""
_CELLS = """
    SELECT rung, n_layer, avg(best_bpb) AS mean, coalesce(stddev_samp(best_bpb), 0) AS std, count(*) AS n
    FROM runs WHERE best_bpb IS NOT NULL {} GROUP BY rung, n_layer
"""
_RUNGS = """
    SELECT rung AS label, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, list(v ORDER BY v) AS vals
    FROM (SELECT rung, seed % 5 AS s, min(best_bpb) AS v FROM runs WHERE rung IS NOT NULL AND seed IS NOT NULL GROUP BY 1, 2)
    WHERE v IS NOT NULL GROUP BY rung
"""
_COMPARED = f"""
    SELECT *, len(va) AS na, len(va) + len(vb) AS nn, list_concat(va, vb) AS pooled, mean_b - mean_a AS difference,
           CASE WHEN greatest(std_a, std_b) = 0 THEN 'Infinity'::DOUBLE ELSE abs(mean_b - mean_a) / greatest(std_a, std_b) END AS effect
    FROM (SELECT x.label AS label_a, y.label AS label_b, x.mean AS mean_a, y.mean AS mean_b, x.std AS std_a, y.std AS std_b, x.vals AS va, y.vals AS vb
          FROM ({_RUNGS}) x JOIN ({_RUNGS}) y ON x.label < y.label)
"""
_TESTED = f"""
    SELECT *, least(1.0::DOUBLE, 2.0::DOUBLE / (factorial(nn::INTEGER)::DOUBLE / (factorial(na::INTEGER)::DOUBLE * factorial((nn - na)::INTEGER)::DOUBLE))) AS min_p,
        (SELECT avg(CASE WHEN abs(l / na - (t - l) / (nn - na)) >= abs(list_sum(va) / na - (t - list_sum(va)) / (nn - na)) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
         FROM (SELECT list_sum(list_transform(range(1, nn + 1), lambda i: CASE WHEN (k >> (i - 1)::INTEGER) & 1 = 1 THEN pooled[i] ELSE 0.0::DOUBLE END)) AS l,
                      list_sum(pooled) AS t FROM range(65536) r(k) WHERE k < (1 << nn::INTEGER) AND bit_count(k) = na)) AS p_value
    FROM ({_COMPARED})
"""
_DIGEST = "sha256(concat_ws('|', c.i::VARCHAR, c.digest, o.payload))"
_ORDERED = """
    SELECT o_custkey % 500 AS chain, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) - 1 AS i,
           '{"status":"' || o_orderstatus || '"}' AS payload FROM orders
"""
_CHAIN = f"""
    WITH RECURSIVE o AS MATERIALIZED ({_ORDERED}),
    c(chain, i, prev, digest, payload) AS (
        SELECT chain, i, '{lineage.GENESIS}', sha256(concat_ws('|', '0', '{lineage.GENESIS}', payload)), payload FROM o WHERE i = 0
        UNION ALL
        SELECT c.chain, o.i, c.digest, sha256(concat_ws('|', o.i::VARCHAR, c.digest, o.payload)), o.payload FROM c JOIN o ON o.chain = c.chain AND o.i = c.i + 1)
"""
_LOGITS = """
    SELECT vec_id, target, list_transform(l, lambda x: x - top - ln(list_sum(list_transform(l, lambda y: exp(y - top))))) AS p FROM (
        SELECT vec_id, label % len(embedding) AS target, list_transform(embedding, lambda x: x::DOUBLE) AS l, list_max(embedding)::DOUBLE AS top FROM embeddings)
"""
_SURPRISAL = f"""
    SELECT vec_id, -p[target + 1] / ln(2) AS surprisal, -list_sum(list_transform(p, lambda x: exp(x) * x)) / ln(2) AS entropy,
           CAST(len(list_filter(p, lambda x: x > p[target + 1])) + 1 AS BIGINT) AS rank FROM ({_LOGITS})
"""
_EVENT_WINDOWS = """
    SELECT user_id, (row_number() OVER w) - 1 AS pos, token, lead(token) OVER w AS nxt FROM (
        SELECT user_id, event_id, event_type AS token FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
"""
_ARM = """
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id)) AS r, count(*) OVER () AS n FROM documents WHERE source {} 'gen-%')
    WHERE r <= floor(n * 0.5)
"""
_SHARDS_ONCE = """
    SELECT path, max(split) AS split, max(tokens) AS tokens, max(documents) AS documents, max(utf8_bytes) AS utf8_bytes, bool_or(synthetic) AS synthetic FROM shards GROUP BY path
"""

SQL: dict[str, str] = {
    "letter_chunk_freq": _CHUNKS,
    "chunk_freq": _PRETOKENS,
    "byte_pair_counts": _WHOLE_PAIRS,
    "best_byte_pair": f"SELECT * FROM ({_WHOLE_PAIRS}) ORDER BY n DESC, a, b LIMIT 1",
    "pair_counts": _BYTE_PAIRS,
    "best_pair": f"SELECT * FROM ({_BYTE_PAIRS}) ORDER BY n DESC, a, b LIMIT 1",
    "alphabet": "SELECT DISTINCT character FROM (SELECT unnest(string_split(text, '')) AS character FROM documents) WHERE character <> ''",
    "shard_rollup": "SELECT corpus AS split, source AS shard, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS documents FROM shards GROUP BY ROLLUP (corpus, source)",
    "split_summary": f"""
        SELECT split, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(documents), 0) AS BIGINT) AS documents,
               CAST(coalesce(sum(utf8_bytes), 0) AS BIGINT) AS utf8_bytes, CAST(coalesce(sum(tokens) FILTER (synthetic), 0) AS BIGINT) AS synthetic_tokens,
               round(coalesce(sum(utf8_bytes)::DOUBLE / nullif(sum(tokens), 0)::DOUBLE, 0), 6) AS bytes_per_token,
               round(coalesce(coalesce(sum(tokens) FILTER (synthetic), 0)::DOUBLE / nullif(sum(tokens), 0)::DOUBLE, 0), 6) AS synthetic_share FROM ({_SHARDS_ONCE}) GROUP BY split""",
    "windows_packed": """
        WITH e AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, pos // 8 AS window, string_agg(event_type, ',' ORDER BY pos) AS x, string_agg(nxt, ',' ORDER BY pos) AS y
        FROM e WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 8""",
    "shard_packing": """
        WITH RECURSIVE d AS MATERIALIZED (SELECT substr(sha256(text), 1, 1) AS split, doc_id, length(text) AS n, row_number() OVER (PARTITION BY substr(sha256(text), 1, 1) ORDER BY doc_id) AS i
            FROM documents WHERE text IS NOT NULL),
        s(split, i, doc_id, shard, held) AS (
            SELECT split, i, doc_id, 0, n FROM d WHERE i = 1
            UNION ALL SELECT d.split, d.i, d.doc_id, CASE WHEN s.held >= 20000 THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.held >= 20000 THEN d.n ELSE s.held + d.n END
            FROM s JOIN d ON s.split = d.split AND d.i = s.i + 1)
        SELECT split, doc_id, shard FROM s""",
    "regimes": """
        SELECT 'T' || printf('%g', coalesce(proposal.temperature, 1.0::DOUBLE)) || coalesce(',k' || proposal.top_k::VARCHAR, '') AS regime, count(*) AS rows FROM loop_iterations GROUP BY 1""",
    "untagged_shards": "SELECT path, corpus, source FROM shards WHERE coalesce(synthetic, FALSE) AND coalesce(trim(quarantine_tag), '') = ''",
    "diversity": """
        WITH t AS (SELECT user_id, event_id, concat_ws(':', event_type, floor(value)::BIGINT::VARCHAR) AS a FROM events),
        g AS (SELECT user_id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, round(count(DISTINCT a)::DOUBLE / count(a), 6) AS distinct_1,
               round(coalesce(count(DISTINCT CASE WHEN b IS NOT NULL THEN a || '|' || b END)::DOUBLE / nullif(count(b), 0), 0), 6) AS distinct_2,
               round(coalesce(count(DISTINCT CASE WHEN c IS NOT NULL THEN a || '|' || b || '|' || c END)::DOUBLE / nullif(count(c), 0), 0), 6) AS distinct_3,
               count(DISTINCT a) AS vocabulary_used, round(count(DISTINCT a) / 100.0::DOUBLE, 6) AS vocabulary_fraction FROM g GROUP BY user_id""",
    "frequent_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "bigram_model": f"""
        WITH j AS (SELECT token AS prev, nxt AS next, count(*) AS n FROM ({_EVENT_WINDOWS}) WHERE nxt IS NOT NULL GROUP BY 1, 2)
        SELECT prev, next, n, round(-log2(n::DOUBLE / (sum(n) OVER (PARTITION BY prev))::DOUBLE), 6) AS bits FROM j""",
    "split_on_separator": """
        SELECT user_id, CAST(document AS BIGINT) AS document, string_agg(event_type, ' ' ORDER BY event_id) AS tokens FROM (
            SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS document FROM events)
        WHERE event_type <> 'purchase' GROUP BY user_id, document""",
    "metrics_unpivot": "SELECT * FROM (UNPIVOT (SELECT run_id, best_bpb, best_loss, final_train_loss, tokens_per_sec, wall_clock FROM runs) ON COLUMNS(* EXCLUDE run_id) INTO NAME key VALUE value)",
    "seed_groups": f"SELECT label, n, round(mean, 6) AS mean, round(std, 6) AS std, round(sem, 6) AS sem, round(spread, 6) AS spread FROM ({_GROUPS})",
    "noise_floor": f"SELECT label, n, CASE WHEN n >= 2 THEN round(std, 6) END AS floor FROM ({_GROUPS}) ORDER BY n DESC, label LIMIT 1",
    "leaderboard": "SELECT run_id, name, rung, seed, best_bpb FROM runs WHERE best_bpb IS NOT NULL ORDER BY best_bpb, run_id LIMIT 25",
    "best_so_far": """
        WITH p AS (SELECT run_id, step, min(value) AS value FROM metrics WHERE key = 'val_bpb' AND value IS NOT NULL AND NOT isnan(value) AND step IS NOT NULL GROUP BY 1, 2)
        SELECT run_id, step, value, min(value) OVER (PARTITION BY run_id ORDER BY step) AS best,
               coalesce(value < min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM p""",
    "last_values": """
        SELECT run_id, key, max(step) AS step, arg_max(value, (step, value)) AS value FROM metrics
        WHERE value IS NOT NULL AND NOT isnan(value) AND step IS NOT NULL GROUP BY run_id, key""",
    "orphan_metrics": "SELECT run_id, count(*) AS rows FROM metrics WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = metrics.run_id) GROUP BY run_id",
    "permutation_exact": f"SELECT label_a, label_b, round(p_value, 6) AS p_value, round(min_p, 6) AS min_p FROM ({_TESTED})",
    "verdicts": f"""
        SELECT label_a, label_b, round(difference, 6) AS difference, round(effect, 6) AS effect,
               CASE WHEN difference > 0 THEN label_a ELSE label_b END AS winner,
               CASE WHEN effect < 1 THEN 'below the noise floor' WHEN min_p > 0.05 THEN 'underpowered' WHEN p_value > 0.05 THEN 'not significant' ELSE 'better' END AS verdict
        FROM ({_TESTED})""",
    "cell_means": f"SELECT rung, n_layer, round(mean, 6) AS mean, round(std, 6) AS std, n FROM ({_CELLS.format('')})",
    "regime_pivot": "SELECT iteration, " + ", ".join(f"round(avg(val_bpb) FILTER (floor(synthetic_fraction * 4) = {k}), 6) AS f{k}" for k in range(4)) + f" FROM ({_ONE}) GROUP BY iteration",
    "cells_full_outer": f"""
        SELECT coalesce(o.rung, n.rung) AS rung, coalesce(o.n_layer, n.n_layer) AS n_layer,
               CASE WHEN n.mean IS NULL THEN 'only_old' WHEN o.mean IS NULL THEN 'only_new' ELSE 'shared' END AS side,
               round(o.mean, 6) AS old_mean, round(n.mean, 6) AS new_mean, round(n.mean - o.mean, 6) AS difference, round(greatest(o.std, n.std), 6) AS own_std
        FROM ({_CELLS.format("AND seed % 2 = 0")}) o FULL JOIN ({_CELLS.format("AND seed % 2 = 1")}) n
          ON o.rung IS NOT DISTINCT FROM n.rung AND o.n_layer IS NOT DISTINCT FROM n.n_layer""",
    "against_control": f"""
        WITH c AS ({_CELLS.format("AND rung IS NOT NULL")})
        SELECT x.rung, x.n_layer, round(x.mean, 6) AS mean, round(y.mean, 6) AS control_mean, round(x.mean - y.mean, 6) AS difference
        FROM c x JOIN c y ON x.n_layer = y.n_layer AND y.rung = 'v5_rope' WHERE x.rung <> 'v5_rope'""",
    "drift_first_last": f"""
        SELECT loop_id, round(arg_min(val_bpb, iteration), 6) AS first, round(arg_max(val_bpb, iteration), 6) AS last, count(*) AS steps,
               round(arg_max(val_bpb, iteration) - arg_min(val_bpb, iteration), 6) AS drift FROM ({_ONE}) WHERE val_bpb IS NOT NULL GROUP BY loop_id""",
    "promotion_rates": f"""
        SELECT loop_id, count(*) AS iterations, count(*) FILTER (promoted) AS promotions, CAST(coalesce(sum(CASE WHEN promoted THEN steps ELSE 0 END), 0) AS BIGINT) AS promoted_steps,
               CAST(sum(steps) AS BIGINT) AS spent_steps, round((count(*) FILTER (promoted))::DOUBLE / count(*), 6) AS rate FROM ({_ONE}) GROUP BY loop_id""",
    "rejection_reasons": f"SELECT reason, count(*) AS rejections FROM (SELECT split_part(unnest(reasons), ':', 1) AS reason FROM ({_ONE}) WHERE NOT coalesce(promoted, FALSE)) GROUP BY reason",
    "rejections_by_fraction": f"SELECT synthetic_fraction, count(*) FILTER (NOT coalesce(promoted, FALSE)) AS rejected, count(*) AS total FROM ({_ONE}) GROUP BY 1",
    "relative_drop": f"""
        WITH o AS ({_ONE}), l AS (SELECT loop_id, iteration, val_bpb, lag(val_bpb) OVER (PARTITION BY loop_id ORDER BY iteration) AS b FROM o WHERE val_bpb IS NOT NULL)
        SELECT loop_id, iteration, val_bpb, round(CASE WHEN b <> 0 THEN (b - val_bpb) / b END, 6) AS drop, coalesce((b - val_bpb) / b > 0.01, FALSE) AS fell FROM l""",
    "lineage_chain": f"{_CHAIN} SELECT chain, i AS index, prev, digest, payload FROM c",
    "lineage_verify": f"""{_CHAIN}, t AS (SELECT chain, i, prev, digest, CASE WHEN chain % 7 = 0 AND i = 2 THEN '{{}}' ELSE payload END AS payload FROM c),
        v AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(digest) OVER w, '{lineage.GENESIS}') AS expected FROM t WINDOW w AS (PARTITION BY chain ORDER BY i, digest)),
        p AS (SELECT chain, place, CASE WHEN i <> place THEN 'index' WHEN prev <> expected THEN 'prev'
            WHEN digest <> sha256(concat_ws('|', i::VARCHAR, prev, payload)) THEN 'digest' END AS problem FROM v)
        SELECT chain, count(*) AS entries, count(problem) = 0 AS intact, CAST(min(place) FILTER (problem IS NOT NULL) AS BIGINT) AS first_break,
            arg_min(problem, place) FILTER (problem IS NOT NULL) AS problem FROM p GROUP BY chain""",
    "gate_results": f"""
        WITH g AS (SELECT loop_id, iteration,
            CASE WHEN val_bpb IS NULL OR isnan(val_bpb) THEN FALSE WHEN incumbent_bpb IS NULL THEN TRUE ELSE val_bpb - incumbent_bpb <= 0.01 END AS a,
            CASE WHEN synthetic_fraction IS NULL THEN TRUE WHEN val_bpb IS NULL THEN FALSE
                 WHEN 1 - synthetic_fraction < 0.9 OR val_bpb / 20 < 0.11 THEN 1 - synthetic_fraction >= 0.2 ELSE TRUE END AS b FROM ({_ONE}))
        SELECT loop_id, iteration, a AND b AS passed, concat_ws(',', CASE WHEN NOT a THEN 'no_regression' END, CASE WHEN NOT b THEN 'diversity' END) AS failed FROM g""",
    "gate_quarantine": """
        SELECT corpus, count(*) FILTER (coalesce(synthetic, FALSE) AND coalesce(trim(quarantine_tag), '') = '') = 0 AS passes,
               count(*) FILTER (coalesce(synthetic, FALSE) AND coalesce(trim(quarantine_tag), '') = '') AS untagged FROM shards GROUP BY corpus""",
    "logit_surprisal": f"SELECT vec_id, round(surprisal, 6) AS surprisal, round(entropy, 6) AS entropy, rank FROM ({_SURPRISAL})",
    "topk_tokens": f"""
        SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(token AS INTEGER) AS token, round(probability, 6) AS probability FROM (
            SELECT vec_id, i - 1 AS token, exp(p[i]) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) - 1 AS place
            FROM (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS i FROM ({_LOGITS}))) WHERE place < 5""",
    "evaluation": f"""
        SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(bits) / sum(tokens), 6) AS bits_per_token, round(sum(bits) / sum(tokens) * ln(2), 6) AS loss,
               round(exp(least(sum(bits) / sum(tokens) * ln(2), 700)), 6) AS perplexity, round(avg(acc), 6) AS accuracy, round(avg(acc5), 6) AS accuracy_5
        FROM (SELECT vec_id // 64 AS batch, sum(surprisal) AS bits, count(*) AS tokens, avg((rank = 1)::INTEGER) AS acc, avg((rank <= 5)::INTEGER) AS acc5 FROM ({_SURPRISAL}) GROUP BY 1)""",
    "learning_rates": """
        SELECT step, round(CASE WHEN step < 100 THEN 0.003::DOUBLE * (step + 1) / 100
            ELSE 0.003::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (step - 100) / 1900.0::DOUBLE))))) END, 6) AS lr
        FROM (SELECT DISTINCT step FROM metrics WHERE step IS NOT NULL AND step >= 0)""",
    "arm_mix": f"{_ARM.format('NOT LIKE')} UNION ALL {_ARM.format('LIKE')}",
    "arm_accumulate": "SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY source",
    "search_grid": """
        SELECT f AS synthetic_fraction, t AS temperature, NULL::INTEGER AS top_k, lr, 300.0::DOUBLE AS steps, 1 - f AS real_fraction
        FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) a(f), (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE)) b(t), (VALUES (0.001::DOUBLE), (0.003::DOUBLE)) c(lr)
        WHERE 1 - f >= 0.25""",
    "visible_text": "SELECT name, translate(description, ' ' || chr(9) || chr(10), '·→⏎') AS shown FROM sources",
    "events_per_window": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
