"""Queries over the run index, model sizes and experiment reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom.functions import arrays as A
from taleloom.functions import render
from taleloom.functions import text as T
from taleloom.operators import curate, expstats, logits, reports, runs, tasks
from taleloom.plans import corpus_queries as corpus
from taleloom.session import cut, read_table

_MODEL = ("d_model", "n_layer", "n_head", "vocab_size", "seq_len")
_TRAINING = ("name", "seed", "steps", "rung", "lr", "batch_size")


def _rounded(frame, *columns):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _lines(spark, sf_dir):
    """The logged numbers of a run and step as one line of its log."""
    rows = read_table(spark, sf_dir, "metrics").where("run_id is not null and key is not null and step is not null and value is not null and not isnan(value) and abs(value) < 1e300")
    per = rows.groupBy("run_id", "step", "key").agg(F.max("value").alias("value"))
    numbers = per.groupBy("run_id", "step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("m"))
    with_step = F.map_concat(F.create_map(F.lit("step"), F.col("step").cast("double")), F.map_filter("m", lambda k, v: k != "step"))
    return numbers.select("run_id", F.struct(F.lit(0).alias("block"), F.col("step").alias("row")).alias("line"), F.to_json(with_step).alias("text"))


def _files(spark, sf_dir):
    """The texts of configurations, manifests and best checkpoints that would have made the run table."""
    r = read_table(spark, sf_dir, "runs")
    config = F.struct(F.struct(*_MODEL).alias("model"), F.struct(*_TRAINING).alias("training"))
    git = F.struct(F.col("git_sha").alias("sha"), (F.col("git_dirty") != 0).alias("dirty"))
    parameters = F.struct(F.col("params_total").alias("total"), F.col("params_non_embedding").alias("non_embedding"))
    manifest = F.struct(git.alias("git"), "started_at", F.col("tokenizer").alias("tokenizer_fingerprint"), parameters.alias("parameters"))
    best = F.struct(F.col("best_step").alias("step"), F.col("best_bpb").alias("val_bpb"), F.col("best_loss").alias("val_loss"))
    return [r.select("run_id", F.to_json(f).alias("text")) for f in (config, manifest, best)]


def run_index(spark, sf_dir):
    """The run table, built from the texts of run directories."""
    found = runs.assemble(*_files(spark, sf_dir), runs.parsed_lines(_lines(spark, sf_dir)), "runs")
    return _rounded(found, "final_train_loss", "tokens_per_sec", "wall_clock")


def run_metrics(spark, sf_dir):
    """The metric rows of the same texts."""
    return runs.metrics_table(runs.parsed_lines(_lines(spark, sf_dir)))


def latest_run(spark, sf_dir):
    return runs.latest_run(read_table(spark, sf_dir, "runs")).select("run_id", "name", "rung")


def comparison_table(spark, sf_dir):
    found = runs.comparison_table(runs.seed_groups(read_table(spark, sf_dir, "runs"))).drop("values")
    return _rounded(found, "mean", "std", "spread")


def rung_parameters(spark, sf_dir):
    """Weights of every run's model with the switches of each rung of the ladder."""
    models = read_table(spark, sf_dir, "runs").select("run_id", "d_model", "n_layer", "vocab_size", "seq_len", F.explode(F.array(*map(F.lit, tasks.RUNGS))).alias("ladder"))
    counted = tasks.parameter_counts(tasks.with_rungs(models, "ladder"))
    return counted.select("run_id", "ladder", "embedding", "per_layer", "non_embedding", "total")


def embedding_costs(spark, sf_dir):
    sizes = read_table(spark, sf_dir, "runs").where("vocab_size is not null").select("vocab_size").distinct()
    return tasks.embedding_costs(sizes, 256)


def diversity_cells(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(":", "event_type", F.floor("value").cast("string")).alias("token"))
    rows = logits.diversity(events, "user_id", "event_id", "token", 100).withColumn("cell", F.pmod("user_id", F.lit(7)))
    return _rounded(reports.diversity_means(rows, ["cell"]), *reports.DIVERSITY)


def sweep_regimes(spark, sf_dir):
    loops = read_table(spark, sf_dir, "loop_iterations")
    return reports.sweep_regimes(loops, F.col("proposal.temperature"), F.col("proposal.top_k"))


def selection_bias(spark, sf_dir):
    """The gap between the last incumbent and the best promoted value of each loop."""
    loops = expstats.one_per_iteration(read_table(spark, sf_dir, "loop_iterations")).where("val_bpb is not null")
    per = loops.groupBy("loop_id").agg(F.min("val_bpb").alias("selected"), F.max_by("incumbent_bpb", "iteration").alias("fresh"), F.max(F.array_join("reasons", ";")).alias("why"))
    return _rounded(reports.selection_bias(per, "loop_id", "selected", "fresh", "why"), "gap")


def paired_arms(spark, sf_dir):
    found = reports.paired_arms(read_table(spark, sf_dir, "runs"), "rung", "seed", "best_bpb", "v6_modern", "v5_rope")
    return _rounded(found, "first", "second", "difference")


def series_ends(spark, sf_dir):
    rows = read_table(spark, sf_dir, "metrics").where("key = 'induction_acc' and run_id is not null")
    return reports.series_ends(rows, "run_id", "step", "value")


def filter_summary(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    unique = docs.join(curate.exact_dedup(docs).select("doc_id"), "doc_id", "left_semi")
    judged = cut(unique.select("doc_id", curate.reject_reason(F.col("text")).alias("reason")))
    stages = curate.funnel([("input", docs), ("exact_duplicates", judged), ("quality", judged.where("reason is null"))])
    rejections = judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))
    found = reports.filter_summary(stages, rejections)
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return _rounded(found.withColumns({"by_stage": listed("by_stage"), "rejections": listed("rejections")}), "removed_fraction")


def _logits(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.pmod("label", F.size("embedding")).alias("target"))


def array_losses(spark, sf_dir):
    """Likeliest probability, cross entropy and squared error against the reversed vector."""
    rows = _logits(spark, sf_dir)
    found = rows.select(
        "vec_id", F.array_max(logits.softmax(F.col("embedding"))).alias("top"), logits.cross_entropy(F.col("embedding"), F.col("target")).alias("loss"),
        logits.mean_squared_error(F.col("embedding"), F.reverse("embedding")).alias("mse"),
    )
    return _rounded(found, "top", "loss", "mse")


def top_k_masked(spark, sf_dir):
    """How many logits a mask leaves and their sum, at a temperature."""
    kept = F.filter(logits.top_k_mask(F.col("embedding"), 10, 0.7), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return _rounded(_logits(spark, sf_dir).select("vec_id", F.size(kept).alias("kept"), total.alias("total")), "total")


def evaluated_bytes(spark, sf_dir):
    """Bits per byte of all stored predictions, with a made-up number of bytes for each."""
    predicted = logits.predictions(_logits(spark, sf_dir), "embedding", "target").withColumn("octets", F.pmod("vec_id", F.lit(5)) + 1)
    return _rounded(logits.bits_per_byte_of(predicted, F.col("octets")), "bits", "bits_per_byte")


def confident_and_wrong(spark, sf_dir):
    predicted = logits.predictions(_logits(spark, sf_dir), "embedding", "target")
    return predicted.where("confident_and_wrong").select("vec_id")


def array_math(spark, sf_dir):
    """Functions of each entry, summed up, so that one row stands for a vector."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    positive = F.transform(e, lambda x: F.abs(x) + 1)
    parts = {"exps": A.exp(e), "logs": A.log(positive), "roots": A.sqrt(positive), "tanhs": A.tanh(e), "relus": A.relu(e), "sigmoids": A.sigmoid(e),
             "products": A.multiply(e, F.reverse(e)), "quotients": A.divide(e, positive), "sums": A.add(e, A.scale(F.reverse(e), 2.0))}
    rows = _logits(spark, sf_dir).select("vec_id", *[A.total(c).alias(n) for n, c in parts.items()], A.variance(e).alias("var"), A.mean(e).alias("mean"))
    return _rounded(rows, *[c for c in rows.columns if c != "vec_id"])


def matrix_axes(spark, sf_dir):
    """A vector as a matrix of eight columns: sums of columns, largest of rows, and its product with its first row."""
    m = A.reshape(F.transform("embedding", lambda x: x.cast("double")), 8)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 4).cast("decimal(20,4)").cast("string")), ",")
    return _logits(spark, sf_dir).select(
        "vec_id", listed(A.along(m, 0, A.total)).alias("columns"), listed(A.along(m, 1, A.maximum)).alias("rows"),
        listed(A.matrix_vector(m, F.element_at(m, 1))).alias("product"),
    )


def top_entries(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("entry", "value"))
    return _rounded(reports.top_by_magnitude(rows, "vec_id", "entry", "value", 3).withColumn("value", F.col("value").cast("double")), "value")


def surprise_levels(spark, sf_dir):
    predicted = logits.predictions(_logits(spark, sf_dir), "embedding", "target")
    return predicted.groupBy(render.surprise_level(F.col("surprisal")).alias("level")).agg(F.count(F.lit(1)).alias("tokens"))


def heat_rows(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", render.shades(F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x))).alias("row"))


def run_dates(spark, sf_dir):
    r = read_table(spark, sf_dir, "runs").select("run_id", T.instant(F.col("started_at")).alias("at"))
    return r.select("run_id", T.stamp(F.col("at")).alias("stamp"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


QUERIES = {
    f.__name__: f
    for f in (
        run_index, run_metrics, latest_run, comparison_table, rung_parameters, embedding_costs, diversity_cells, sweep_regimes, selection_bias,
        paired_arms, series_ends, filter_summary, array_losses, top_k_masked, evaluated_bytes, confident_and_wrong,
        array_math, matrix_axes, top_entries, surprise_levels, heat_rows, run_dates,
    )
}

_METRICS = """
    SELECT run_id, step, key, max(value) AS value FROM metrics
    WHERE run_id IS NOT NULL AND key IS NOT NULL AND step IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e300 GROUP BY 1, 2, 3
"""
_ENDS = f"""
    SELECT l.run_id, arg_max(l.value, l.step) AS final_train_loss, arg_max(t.value, l.step) FILTER (t.value IS NOT NULL) AS tokens_per_sec,
        arg_max(e.value, l.step) FILTER (e.value IS NOT NULL) AS wall_clock
    FROM (SELECT * FROM ({_METRICS}) WHERE key = 'loss') l
    LEFT JOIN (SELECT * FROM ({_METRICS}) WHERE key = 'tokens_per_sec') t ON l.run_id = t.run_id AND l.step = t.step
    LEFT JOIN (SELECT * FROM ({_METRICS}) WHERE key = 'elapsed') e ON l.run_id = e.run_id AND l.step = e.step GROUP BY l.run_id
"""
_SWITCHES = "(VALUES " + ", ".join(f"('{k}', '{v['norm']}', '{v['position']}', '{v['mlp']}', {int(v['bias'])}, {v['tie_embeddings']})" for k, v in tasks.RUNGS.items()) + ") s(ladder, norm, position, mlp, b, tied)"
_SIZED = f"""
    SELECT run_id, ladder, tied, n_layer, vocab_size, CAST(d_model AS BIGINT) AS d, b, vocab_size * d_model + CASE WHEN position = 'learned' THEN seq_len * d_model ELSE 0 END AS embedding,
        CASE WHEN norm = 'rmsnorm' THEN d_model ELSE 2 * d_model END AS norms, mlp = 'swiglu' AS gated,
        CAST(floor(CASE WHEN mlp = 'swiglu' THEN 4.0::DOUBLE * 2 / 3 * d_model ELSE 4.0::DOUBLE * d_model END) AS BIGINT) AS h FROM runs, {_SWITCHES}
"""
_LAYERED = f"""
    SELECT *, 2 * norms + 4 * d * d + 4 * d * b + CASE WHEN gated THEN 3 * d * h + (2 * h + d) * b ELSE 2 * d * h + (h + d) * b END AS layer FROM ({_SIZED})
"""
_ONE = """
    SELECT loop_id, iteration, unnest(arg_max(struct_pack(val_bpb := val_bpb, incumbent_bpb := incumbent_bpb, reasons := reasons),
        (finished_at, -coalesce(val_bpb, 1e300)))) FROM loop_iterations GROUP BY loop_id, iteration
"""
_BIAS = f"""
    SELECT loop_id, arg_max(incumbent_bpb, iteration) - min(val_bpb) AS gap, coalesce(max(array_to_string(reasons, ';')) LIKE '%exhausted%', FALSE) AS truncated
    FROM ({_ONE}) WHERE val_bpb IS NOT NULL GROUP BY loop_id
"""
_SOFT = """
    SELECT vec_id, target, l, list_transform(l, lambda x: x - top - ln(list_sum(list_transform(l, lambda y: exp(y - top))))) AS p FROM (
        SELECT vec_id, label % len(embedding) AS target, list_transform(embedding, lambda x: x::DOUBLE) AS l, list_max(embedding)::DOUBLE AS top FROM embeddings)
"""

SQL = {
    "run_index": f"""
        SELECT r.run_id, coalesce(nullif(name, ''), regexp_replace(r.run_id, '^([^-]*-){{1,2}}', '')) AS name, 'runs/' || r.run_id AS path, started_at, git_sha,
            CASE WHEN git_dirty <> 0 THEN 1 ELSE 0 END AS git_dirty, nullif(rung, '') AS rung, seed, steps, batch_size, nullif(seq_len, 0) AS seq_len, d_model, n_layer, n_head, vocab_size, lr,
            params_total, params_non_embedding, tokenizer, best_step, best_bpb, best_loss, round(e.final_train_loss, 6) AS final_train_loss,
            round(e.tokens_per_sec, 6) AS tokens_per_sec, round(e.wall_clock, 6) AS wall_clock
        FROM runs r LEFT JOIN ({_ENDS}) e ON r.run_id = e.run_id""",
    "run_metrics": f"SELECT run_id, step, key, value FROM ({_METRICS}) WHERE key <> 'step'",
    "latest_run": "SELECT run_id, name, rung FROM runs ORDER BY run_id DESC LIMIT 1",
    "comparison_table": """
        SELECT regexp_replace(name, '-s[0-9]+$', '') AS label, round(avg(best_bpb), 6) AS mean, round(coalesce(stddev_samp(best_bpb), 0), 6) AS std,
            round(max(best_bpb) - min(best_bpb), 6) AS spread, count(*) AS n, count(*) = 1 AS single_seed
        FROM runs WHERE best_bpb IS NOT NULL AND name IS NOT NULL GROUP BY 1""",
    "rung_parameters": f"""
        SELECT run_id, ladder, embedding, layer AS per_layer, n_layer * layer + norms + CASE WHEN tied THEN 0 ELSE vocab_size * d END AS non_embedding,
            embedding + n_layer * layer + norms + CASE WHEN tied THEN 0 ELSE vocab_size * d END AS total FROM ({_LAYERED})""",
    "embedding_costs": """
        SELECT vocab_size, vocab_size * 256 AS embedding, (vocab_size - lag(vocab_size, 1, 0) OVER (ORDER BY vocab_size)) * 256 AS added
        FROM (SELECT DISTINCT vocab_size FROM runs WHERE vocab_size IS NOT NULL)""",
    "diversity_cells": """
        WITH t AS (SELECT user_id, event_id, concat_ws(':', event_type, floor(value)::BIGINT::VARCHAR) AS a FROM events),
        g AS (SELECT user_id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        d AS (SELECT user_id, count(DISTINCT a)::DOUBLE / count(a) AS d1, coalesce(count(DISTINCT CASE WHEN b IS NOT NULL THEN a || '|' || b END)::DOUBLE / nullif(count(b), 0), 0) AS d2,
            coalesce(count(DISTINCT CASE WHEN c IS NOT NULL THEN a || '|' || b || '|' || c END)::DOUBLE / nullif(count(c), 0), 0) AS d3, count(DISTINCT a) / 100.0::DOUBLE AS v FROM g GROUP BY user_id)
        SELECT user_id % 7 AS cell, round(avg(d1), 6) AS distinct_1, round(avg(d2), 6) AS distinct_2, round(avg(d3), 6) AS distinct_3, round(avg(v), 6) AS vocabulary_fraction, count(*) AS corpora
        FROM d GROUP BY 1""",
    "sweep_regimes": """
        SELECT CAST(row_number() OVER (ORDER BY temperature, regime) AS INTEGER) AS place, temperature, regime FROM (
            SELECT DISTINCT coalesce(proposal.temperature, 1.0::DOUBLE) AS temperature,
                'T' || printf('%g', coalesce(proposal.temperature, 1.0::DOUBLE)) || coalesce(',k' || proposal.top_k::VARCHAR, '') AS regime FROM loop_iterations)""",
    "selection_bias": f"""
        WITH b AS ({_BIAS}) SELECT loop_id AS seed, round(gap, 6) AS gap, truncated FROM b
        UNION ALL SELECT NULL, round(avg(gap), 6), coalesce(bool_or(truncated), FALSE) FROM b""",
    "paired_arms": """
        SELECT seed, round(first, 6) AS first, round(second, 6) AS second, round(first - second, 6) AS difference FROM (
            SELECT seed, avg(best_bpb) FILTER (rung = 'v6_modern') AS first, avg(best_bpb) FILTER (rung = 'v5_rope') AS second
            FROM runs WHERE seed IS NOT NULL GROUP BY seed) WHERE first IS NOT NULL AND second IS NOT NULL""",
    "series_ends": """
        SELECT run_id, arg_min(value, (step, -value)) AS first, arg_max(value, (step, value)) AS last, max(value) AS best
        FROM metrics WHERE key = 'induction_acc' AND run_id IS NOT NULL AND step IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY run_id""",
    "filter_summary": f"""
        WITH judged AS ({corpus._REASON}), first AS (SELECT min(doc_id) AS doc_id FROM judged GROUP BY text),
        u AS (SELECT reason FROM judged JOIN first USING (doc_id)),
        n AS (SELECT (SELECT count(*) FROM judged) AS a, (SELECT count(*) FROM u) AS b, (SELECT count(*) FROM u WHERE reason = 'kept') AS c)
        SELECT a AS input, c AS kept, a - c AS removed, round(coalesce((a - c) / nullif(a, 0)::DOUBLE, 0), 6) AS removed_fraction,
            'exact_duplicates=' || (a - b) || ',input=0,quality=' || (b - c) AS by_stage,
            (SELECT string_agg(reason || '=' || k, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS k FROM u WHERE reason <> 'kept' GROUP BY reason)) AS rejections FROM n""",
    "array_losses": f"""
        SELECT vec_id, round(exp(list_max(p)), 6) AS top, round(-p[target + 1], 6) AS loss,
            round(list_sum(list_transform(range(1, len(l) + 1), lambda i: (l[i] - l[len(l) + 1 - i]) * (l[i] - l[len(l) + 1 - i]))) / len(l), 6) AS mse FROM ({_SOFT})""",
    "top_k_masked": f"""
        SELECT vec_id, CAST(len(k) AS INTEGER) AS kept, round(list_sum(k), 6) AS total
        FROM (SELECT vec_id, list_filter(list_transform(l, lambda x: x / 0.7::DOUBLE), lambda x: x >= list_reverse_sort(list_transform(l, lambda y: y / 0.7::DOUBLE))[10]) AS k FROM ({_SOFT}))""",
    "evaluated_bytes": f"""
        SELECT round(sum(-p[target + 1] / ln(2)), 6) AS bits, CAST(sum(vec_id % 5 + 1) AS BIGINT) AS bytes, round(sum(-p[target + 1] / ln(2)) / sum(vec_id % 5 + 1), 6) AS bits_per_byte FROM ({_SOFT})""",
    "confident_and_wrong": f"""
        SELECT vec_id FROM ({_SOFT}) WHERE -list_sum(list_transform(p, lambda x: exp(x) * x)) / ln(2) < 2.0 AND -p[target + 1] / ln(2) > 4.0""",
    "array_math": """
        SELECT vec_id, round(list_sum(list_transform(e, lambda x: exp(x))), 6) AS exps, round(list_sum(list_transform(e, lambda x: ln(abs(x) + 1))), 6) AS logs,
            round(list_sum(list_transform(e, lambda x: sqrt(abs(x) + 1))), 6) AS roots, round(list_sum(list_transform(e, lambda x: tanh(x))), 6) AS tanhs,
            round(list_sum(list_transform(e, lambda x: greatest(x, 0.0::DOUBLE))), 6) AS relus, round(list_sum(list_transform(e, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoids,
            round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * e[len(e) + 1 - i])), 6) AS products,
            round(list_sum(list_transform(e, lambda x: x / (abs(x) + 1))), 6) AS quotients,
            round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] + 2 * e[len(e) + 1 - i])), 6) AS sums,
            round(list_var_pop(e), 6) AS var, round(list_avg(e), 6) AS mean
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""",
    "matrix_axes": """
        WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        d AS (SELECT vec_id, e, list_transform(range(8), lambda j: list_sum(list_transform(range(0, len(e) // 8), lambda i: e[i * 8 + j + 1]))) AS c,
            list_transform(range(0, len(e) // 8), lambda i: list_max(e[i * 8 + 1 : i * 8 + 8])) AS r,
            list_transform(range(0, len(e) // 8), lambda i: list_sum(list_transform(range(1, 9), lambda j: e[i * 8 + j] * e[j]))) AS p FROM m)
        SELECT vec_id, array_to_string(list_transform(c, lambda x: round(x, 4)::DECIMAL(20, 4)::VARCHAR), ',') AS columns,
            array_to_string(list_transform(r, lambda x: round(x, 4)::DECIMAL(20, 4)::VARCHAR), ',') AS rows,
            array_to_string(list_transform(p, lambda x: round(x, 4)::DECIMAL(20, 4)::VARCHAR), ',') AS product FROM d""",
    "top_entries": """
        SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(entry AS INTEGER) AS entry, round(value::DOUBLE, 6) AS value FROM (
            SELECT vec_id, entry, value, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, entry) AS place
            FROM (SELECT vec_id, unnest(range(len(embedding))) AS entry, unnest(embedding) AS value FROM embeddings)) WHERE place <= 3""",
    "surprise_levels": f"""
        SELECT CAST((b >= 1.0)::INTEGER + (b >= 2.5)::INTEGER + (b >= 4.0)::INTEGER + (b >= 6.0)::INTEGER + (b >= 9.0)::INTEGER AS INTEGER) AS level, count(*) AS tokens
        FROM (SELECT -p[target + 1] / ln(2) AS b FROM ({_SOFT})) GROUP BY 1""",
    "heat_rows": """
        SELECT vec_id, array_to_string(list_transform(embedding[1:16], lambda x: substr(' ░▒▓█', CAST(least(greatest(floor(abs(x) * 5), 0), 4) AS INTEGER) + 1, 1)), '') AS row FROM embeddings""",
    "run_dates": """
        SELECT run_id, strftime(t, '%Y%m%d-%H%M%S') AS stamp, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso
        FROM (SELECT run_id, TRY_CAST(started_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS t FROM runs)""",
}
