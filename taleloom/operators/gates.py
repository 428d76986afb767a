"""Promotion gates as columns; whatever is missing fails, but for a corpus that was not generated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_regression(candidate: Column, incumbent: Column, tolerance: float = 0.01) -> Column:
    """Passes without an incumbent; a missing candidate fails."""
    return F.when(candidate.isNull() | F.isnan(candidate), False).when(incumbent.isNull(), True).otherwise(candidate - incumbent <= tolerance)


def writes_confined(paths: Column, roots: list[str]) -> Column:
    """Every path under one of the roots when ``.``, ``..`` and doubled slashes are resolved; a relative path or one above the root is under none."""
    def canonical(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
        step = lambda s, x: F.when(x != "..", F.concat(s, F.array(x))).when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1)).otherwise(F.array(F.lit("..")))
        return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")))

    under = lambda p: reduce(lambda x, y: x | y, [p.startswith(r.rstrip("/") + "/") | (p == r.rstrip("/")) for r in roots])
    return F.coalesce(F.forall(paths, lambda p: F.coalesce(under(canonical(p)), F.lit(False))), F.lit(False))


def quarantined(shards: DataFrame, key: str) -> DataFrame:
    """Per key whether no synthetic shard lacks its tag."""
    untagged = F.coalesce("synthetic", F.lit(False)) & (F.coalesce(F.trim("quarantine_tag"), F.lit("")) == "")
    return shards.groupBy(key).agg((F.count_if(untagged) == 0).alias("passes"), F.count_if(untagged).alias("untagged"))


def diversity_floor(coverage: Column, distinct_3: Column, previous: Column, real_fraction: Column, present: Column, least_coverage: float = 0.5, least_distinct: float = 0.1, most_drop: float = 0.25, anchor: float = 0.2) -> Column:
    """A generated corpus must not be too narrow unless enough of the mix is real."""
    drop = F.when(previous > 0, (previous - coverage) / previous)
    narrow = (coverage < least_coverage) | (distinct_3 < least_distinct) | F.coalesce(drop > most_drop, F.lit(False))
    return (
        F.when(~present, True)
        .when(coverage.isNull() | distinct_3.isNull(), False)
        .when(narrow, F.coalesce(real_fraction >= anchor, F.lit(False)))
        .otherwise(True)
    )


def gate(results: dict[str, Column]) -> Column:
    """All gates passed and the names of those that did not; an empty suite is an error."""
    if not results:
        raise ValueError("a gate needs at least one check")
    passed = {n: F.coalesce(c, F.lit(False)) for n, c in results.items()}
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in passed.items()]), lambda n: n.isNotNull())
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def report(checks: dict[str, tuple[Column, Column]]) -> Column:
    """An array of ``name, passed, message`` of every check, in order; a null result is a failed one."""
    if not checks:
        raise ValueError("a gate needs at least one check")
    return F.array(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed"), F.coalesce(m, F.lit("no result")).alias("message"))
        for n, (c, m) in checks.items()
    ])


def default_suite(tolerance: float = 0.01, roots: tuple[str, ...] = ("/",), **columns: Column) -> dict[str, tuple[Column, Column]]:
    """The five standard checks with what they say.

    Columns are ``intact, candidate, incumbent, paths, untagged, coverage, distinct_3, previous, real_fraction, generated``;
    those that are not given are null, and what is null fails, but for a corpus that was not generated.
    """
    kinds = {"intact": "boolean", "paths": "array<string>", "untagged": "bigint", "generated": "boolean"}
    names = ("intact", "candidate", "incumbent", "paths", "untagged", "coverage", "distinct_3", "previous", "real_fraction", "generated")
    c = {n: columns.get(n, F.lit(None).cast(kinds.get(n, "double"))) for n in names}
    number = lambda x: F.coalesce(F.format_string("%.4f", x), F.lit("none"))
    generated = F.coalesce(c["generated"], F.lit(False))
    return {
        "lineage_intact": (c["intact"], F.when(c["intact"], "every entry follows the one before").otherwise("the chain is broken")),
        "no_regression": (
            no_regression(c["candidate"], c["incumbent"], tolerance),
            F.concat(F.lit("candidate "), number(c["candidate"]), F.lit(", incumbent "), number(c["incumbent"])),
        ),
        "writes_confined": (writes_confined(c["paths"], list(roots)), F.concat(F.lit("roots "), F.lit(", ".join(roots)))),
        "quarantined": (c["untagged"] == 0, F.concat(F.coalesce(c["untagged"].cast("string"), F.lit("unknown")), F.lit(" synthetic shards without a tag"))),
        "diversity": (
            diversity_floor(c["coverage"], c["distinct_3"], c["previous"], c["real_fraction"], generated),
            F.when(~generated, "no generated corpus").otherwise(F.concat(F.lit("vocabulary "), number(c["coverage"]), F.lit(", distinct_3 "), number(c["distinct_3"]))),
        ),
    }


def resolve_conflict(rows: DataFrame, key: str, axiom: str, precedence: str) -> DataFrame:
    """The axiom that goes first per key; ties by name."""
    return rows.groupBy(key).agg(F.min(F.struct(precedence, axiom))[axiom].alias(axiom))
