"""Synthetic tasks and the search grid, generated as rows of a range."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def copy_task(lot: np.random.Generator, length: int = 8, alphabet: int = 20) -> tuple[str, str]:
    """A sequence to be repeated behind a bar."""
    body = " ".join(map(str, lot.integers(0, alphabet, size=length)))
    return f"{body} | ", f"{body}\n"


def sort_task(lot: np.random.Generator, length: int = 6, maximum: int = 20) -> tuple[str, str]:
    """A list and the same in order."""
    drawn = lot.integers(0, maximum, size=length)
    return " ".join(map(str, drawn)) + " -> ", " ".join(map(str, np.sort(drawn))) + "\n"


def modular_task(lot: np.random.Generator, modulus: int = 13, operation: str = "+") -> tuple[str, str]:
    """A sum or product and its remainder."""
    if operation not in "+*" or len(operation) != 1:
        raise ValueError(f"no operation {operation!r}")
    a, b = map(int, lot.integers(0, modulus, size=2))
    return f"{a} {operation} {b} mod {modulus} = ", f"{(a * b if operation == '*' else a + b) % modulus}\n"


def dyck_task(lot: np.random.Generator, max_depth: int = 4, length: int = 12) -> tuple[str, str]:
    """A prefix of nested brackets and those that close it, the inner ones first."""
    closing = {"(": ")", "[": "]", "{": "}"}
    open_ones: list[str] = []
    prefix = ""
    for _ in range(length):
        opens = not open_ones or (len(open_ones) < max_depth and lot.random() < 0.6)
        if opens:
            open_ones.append("([{"[int(lot.integers(0, 3))])
            prefix += open_ones[-1]
        else:
            prefix += closing[open_ones.pop()]
    return prefix + " ", "".join(closing[c] for c in reversed(open_ones)) + "\n"


TASKS: dict[str, Callable[..., tuple[str, str]]] = {"copy": copy_task, "sort": sort_task, "modular_arithmetic": modular_task, "dyck": dyck_task}


def examples(spark: SparkSession, task: str, count: int, seed: int = 0, **settings) -> DataFrame:
    """``(example_id, prompt, answer)``; each example depends on seed and number alone."""
    make = partial(TASKS[task], **settings)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [make(np.random.default_rng([seed, int(i)])) for i in frame["id"]]
            yield pd.DataFrame({"example_id": frame["id"], "prompt": [p for p, _ in made], "answer": [a for _, a in made]})

    return spark.range(count).mapInPandas(run, "example_id bigint, prompt string, answer string")


def score(produced: DataFrame, answer: str = "answer", output: str = "output") -> DataFrame:
    """Exact match and the share of the answer's characters that agree from its start."""
    agree = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(answer))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct((s["n"] + F.when(s["on"] & (F.substring(F.col(answer), i, F.lit(1)) == F.substring(F.col(output), i, F.lit(1))) & (i <= F.length(answer)), 1).otherwise(0)).alias("n"), (s["on"] & (F.substring(F.col(answer), i, F.lit(1)) == F.substring(F.col(output), i, F.lit(1)))).alias("on")),
        lambda s: s["n"],
    )
    prefix = F.when(F.length(answer) > 0, agree / F.length(answer)).otherwise((F.length(output) == 0).cast("double"))
    return produced.select("*", (F.col(answer) == F.col(output)).alias("exact"), prefix.alias("prefix_agreement"))


#: The default search space.
GRID = {
    "synthetic_fraction": [0.0, 0.25, 0.5],
    "temperature": [0.9, 1.0, 1.1],
    "top_k": [None],
    "lr": [1e-3, 3e-3],
    "steps": [300.0],
}
TYPES = {"synthetic_fraction": "double", "temperature": "double", "top_k": "int", "lr": "double", "steps": "double"}


def search_grid(spark: SparkSession, grid: dict[str, list] = GRID, min_real_fraction: float = 0.25) -> DataFrame:
    """Every point of the grid; the short option lists are exploded one after the other.

    A synthetic fraction that leaves less real data than the least share is an error, as no proposal could have it.
    """
    if over := [f for f in grid["synthetic_fraction"] if 1 - f < min_real_fraction]:
        raise ValueError(f"synthetic fractions {over} leave less than {min_real_fraction} of real data")
    points = spark.range(1).drop("id")
    for name, options in grid.items():
        points = points.withColumn(name, F.explode(F.array(*[F.lit(o).cast(TYPES[name]) for o in options])))
    return points.withColumn("real_fraction", 1 - F.col("synthetic_fraction"))


def sample_proposals(spark: SparkSession, count: int, seed: int = 0, grid: dict[str, list] = GRID) -> DataFrame:
    """``(proposal_id, options)``: each option drawn evenly by a digest of seed, number and name."""
    drawn = spark.range(count).withColumnRenamed("id", "proposal_id")
    for name, options in grid.items():
        place = F.pmod(F.xxhash64(F.lit(seed), "proposal_id", F.lit(name)), F.lit(len(options))).cast("int")
        drawn = drawn.withColumn(name, F.element_at(F.array(*[F.lit(o).cast(TYPES[name]) for o in options]), place + 1))
    return drawn.withColumn("real_fraction", 1 - F.col("synthetic_fraction"))


def grid_size(grid: dict[str, list] = GRID) -> int:
    return math.prod(map(len, grid.values()))


def valid_proposals(proposals: DataFrame, grid: DataFrame) -> DataFrame:
    """Proposals that are a point of the grid; a null option equals null."""
    names = [c for c in grid.columns if c != "real_fraction"]
    same = reduce(lambda a, b: a & b, [F.col(f"p.{n}").eqNullSafe(F.col(f"g.{n}")) for n in names])
    return proposals.alias("p").join(grid.alias("g"), same, "left_semi")


#: The rungs of the ladder of models and what they switch.
RUNGS = {
    "v1_single_head": {"norm": "layernorm", "position": "learned", "mlp": "gelu", "bias": True, "tie_embeddings": False},
    "v2_gpt2": {"norm": "layernorm", "position": "learned", "mlp": "gelu", "bias": True, "tie_embeddings": False},
    "v3_rmsnorm": {"norm": "rmsnorm", "position": "learned", "mlp": "gelu", "bias": True, "tie_embeddings": False},
    "v4_rope": {"norm": "rmsnorm", "position": "rope", "mlp": "gelu", "bias": True, "tie_embeddings": False},
    "v5_swiglu": {"norm": "rmsnorm", "position": "rope", "mlp": "swiglu", "bias": True, "tie_embeddings": False},
    "v6_modern": {"norm": "rmsnorm", "position": "rope", "mlp": "swiglu", "bias": False, "tie_embeddings": True},
}


def with_rungs(models: DataFrame, rung: str = "rung") -> DataFrame:
    """Models with the switches of their rung; nulls where it is unknown."""
    known = F.create_map(*[
        x
        for name, switches in RUNGS.items()
        for x in (F.lit(name), F.struct(*[F.lit(v).alias(k) for k, v in switches.items()]))
    ])
    found = known[F.col(rung)]
    return models.withColumns({k: found[k] for k in RUNGS["v6_modern"]})


def parameter_counts(models: DataFrame, mlp_ratio: float = 4.0) -> DataFrame:
    """``models`` with ``embedding, per_layer, non_embedding, total`` weights.

    Models have ``d_model, n_layer, vocab_size, seq_len`` and the switches of RUNGS. Biases come with every matrix if they are on, a
    norm of layers has two vectors and one of roots of squares one, positions that are learned count as embeddings, a head that is not tied as none.
    """
    d, v = F.col("d_model"), F.col("vocab_size")
    gated = F.col("mlp") == "swiglu"
    biased = F.col("bias").cast("bigint")
    hidden = F.when(gated, F.lit(mlp_ratio) * 2 / 3 * d).otherwise(F.lit(mlp_ratio) * d).cast("bigint")
    norm = F.when(F.col("norm") == "rmsnorm", d).otherwise(2 * d)
    attention = 4 * d * d + 4 * d * biased
    feed = F.when(gated, 3 * d * hidden + (2 * hidden + d) * biased).otherwise(2 * d * hidden + (hidden + d) * biased)
    layer = 2 * norm + attention + feed
    embedding = v * d + F.when(F.col("position") == "learned", F.col("seq_len") * d).otherwise(0)
    rest = F.col("n_layer") * layer + norm + F.when(F.col("tie_embeddings"), 0).otherwise(v * d)
    return models.withColumns({"embedding": embedding, "per_layer": layer, "non_embedding": rest, "total": embedding + rest})


def embedding_costs(sizes: DataFrame, d_model: int, vocab: str = "vocab_size") -> DataFrame:
    """What each step of the vocabulary adds in embedding weights."""
    before = F.lag(vocab, 1, 0).over(Window.orderBy(vocab))
    return sizes.select("*", (F.col(vocab) * d_model).alias("embedding"), ((F.col(vocab) - before) * d_model).alias("added"))
