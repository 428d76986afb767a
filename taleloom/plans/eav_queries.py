"""Queries of the wide-table operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.operators import eav
from taleloom.session import read_table

#: The attributes of the test tables, needed where SQL must name its columns.
METRIC_COLUMNS = [
    ("clip_events", "bigint"), ("copy_acc", "double"), ("distinct_1", "double"), ("distinct_2", "double"),
    ("distinct_3", "double"), ("diverged", "boolean"), ("documents_seen", "bigint"), ("dyck_acc", "double"),
    ("elapsed", "double"), ("epoch", "bigint"), ("grad_norm", "double"), ("induction_acc", "double"),
    ("loss", "double"), ("lr", "double"), ("modular_acc", "double"), ("perplexity", "double"),
    ("resumed", "boolean"), ("sort_acc", "double"), ("tokens_per_sec", "double"), ("val_bits_per_token", "double"),
    ("val_bpb", "double"), ("val_loss", "double"), ("val_tokens", "bigint"), ("vocabulary_fraction", "double"),
    ("vocabulary_used", "bigint"),
]


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    columns = eav.attribute_columns(read_table(spark, sf_dir, "metric_keys"))
    return eav.widen(read_table(spark, sf_dir, "metrics"), columns), columns


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eav.contradictions(*_wide(spark, sf_dir))


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, columns = _wide(spark, sf_dir)
    return wide.select(
        "run_id", "step", *[n for n, _ in columns],
        F.size("conflicts").alias("n_conflicts"), F.size("rejected").alias("n_rejected"),
    )


_SPELLED = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_KEYED = f"""
    SELECT m.run_id, m.step, k.column_name, k.value_type, m.value, m.logged_at,
           m.value IS NOT NULL AND isfinite(m.value) AS finite
    FROM metrics m LEFT JOIN metric_keys k ON {_SPELLED.format("m.key")} = {_SPELLED.format("k.column_name")}
"""

P1_FOUND_SQL = f"""
WITH keyed AS ({_KEYED})
SELECT run_id, step, column_name FROM keyed
WHERE finite AND step IS NOT NULL AND run_id IS NOT NULL AND column_name IS NOT NULL
GROUP BY run_id, step, column_name HAVING min(value) <> max(value)
"""


def p1_wide_sql(columns: list[tuple[str, str]]) -> str:
    fits = {
        "double": "TRUE",
        "bigint": "isfinite(v) AND v = floor(v) AND v >= -9223372036854775808.0 AND v < 9223372036854775808.0",
        "boolean": "v IN (0.0, 1.0)",
    }
    cast = {"double": "v", "bigint": "TRY_CAST(v AS BIGINT)", "boolean": "v = 1.0"}
    cells = ",\n".join(
        f"max(CASE WHEN column_name = '{n}' AND {fits[k]} THEN {cast[k]} END) AS {n}" for n, k in columns
    )
    return f"""
WITH keyed AS ({_KEYED}),
cells AS (
    SELECT run_id, step, column_name, value_type,
           arg_max(value, (finite, coalesce(logged_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), value)) FILTER (value IS NOT NULL) AS v,
           coalesce(min(value) FILTER (finite) <> max(value) FILTER (finite), FALSE) AS differs
    FROM keyed GROUP BY run_id, step, column_name, value_type
)
SELECT run_id, step, {cells},
       CAST(count(*) FILTER (differs AND column_name IS NOT NULL) AS INTEGER) AS n_conflicts,
       CAST(count(*) FILTER (v IS NOT NULL AND column_name IS NOT NULL AND NOT CASE value_type
            WHEN 'bigint' THEN {fits["bigint"]} WHEN 'boolean' THEN {fits["boolean"]} ELSE TRUE END) AS INTEGER) AS n_rejected
FROM cells GROUP BY run_id, step
"""
