"""Attribute-value rows into wide tables.

Rows ``(entity keys, attribute, value)`` become one row per entity with typed columns. The
attribute's spelling is reduced to letters and digits and encoded as a column index; every task
combines the rows of a cell that it holds, so an entity or a cell with a great part of all rows is a few rows a task; then
cells are exchanged once, by entity, sorted, and streamed into columnar builders, which find what differs and
keep buffers only for the columns that a batch has: typed values with a validity mask each.

Defined results, per cell: rows that agree are one value; of rows that differ the one logged
last holds, of equally late ones the larger value. A finite value goes before NaN and the
infinities, null never holds. A bigint column takes whole values within its range, a boolean
column 1 and 0; any other value leaves the cell null and is listed in ``rejected``. Cells
with at least two different finite values are listed in ``conflicts``. Unknown attributes and
null attributes make no cell; an entity with none but such rows still has a row. A null in an
entity key is a key value of its own. Column names of the input may clash with attributes: only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are combined together before the exchange, and cells that are built together.
COMBINED_ROWS = 200_000
BUILDER_ROWS = 65_536

ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def spelled(column) -> F.Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]", "")


def attribute_columns(attributes: DataFrame, name: str = "column_name", kind: str = "value_type") -> list[tuple[str, str]]:
    """The wide table's columns in name order, from a table of settings; repeated rows are one, clashing spellings an error."""
    rows = attributes.where(F.col(name).isNotNull()).select(name, kind).distinct().orderBy(name, kind).collect()
    columns = [(r[0], r[1]) for r in rows]
    keys = {"".join(c for c in n.lower() if c.isalnum()) for n, _ in columns}
    if len(keys) < len(columns):
        raise ValueError("two attributes differ only in spelling")
    if unknown := {k for _, k in columns} - ARROW.keys():
        raise ValueError(f"unknown value types: {sorted(map(str, unknown))}")
    return columns


def cells(
    rows: DataFrame,
    columns: list[tuple[str, str]],
    entity: tuple[str, str],
    attribute: str,
    value: str,
    order: str,
) -> DataFrame:
    """``(e0, e1, at, v, o, low, high)``: what each task holds of a cell, in one row (attribute index -1: none known).

    ``v`` is the value that holds, ``o`` its place in order, ``low`` and ``high`` the least and greatest finite values.
    """
    at = F.lit(-1)
    if columns:
        pairs = [("".join(c for c in n.lower() if c.isalnum()), i) for i, (n, _) in enumerate(columns)]
        index = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        at = F.coalesce(index[spelled(F.col(attribute))], at)
    types = dict(rows.dtypes)
    # Micro-seconds since 1970 are exact in a double.
    place = {"timestamp": F.unix_micros(F.col(order)), "date": F.unix_date(F.col(order))}.get(types[order], F.col(order)).cast("double")
    keyed = rows.select(
        F.col(entity[0]).alias("e0"),
        F.col(entity[1]).alias("e1"),
        at.alias("at"),
        F.col(value).cast("double").alias("v"),
        place.alias("o"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= COMBINED_ROWS:
                yield from _combined(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from _combined(pa.Table.from_batches(held))

    schema = f"e0 {types[entity[0]]}, e1 {types[entity[1]]}, at int, v double, o double, low double, high double"
    return keyed.mapInArrow(run, schema)


def _combined(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Raw rows of a task as one row per cell."""
    v, o = (table[c].to_numpy(zero_copy_only=False) for c in ("v", "o"))
    known = ~table["v"].is_null().to_numpy(zero_copy_only=False)
    finite = known & np.isfinite(v)
    table = table.append_column("low", pa.array(v, mask=~finite)).append_column("high", pa.array(v, mask=~finite))
    codes = [_codes(table[c]) for c in ("e0", "e1")]
    order = np.lexsort((table["at"].to_numpy(), *codes[::-1]))
    first, best, low, high = resolved(order, [c[order] for c in codes], table)
    out = table.take(pa.array(best))
    none = ~np.isfinite(low)
    for name, column in (("low", low), ("high", high)):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(column, mask=none))
    yield from out.combine_chunks().to_batches()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values; nulls equal nulls."""
    return _one(column.dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)


def resolved(order: np.ndarray, keys: list[np.ndarray], table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of rows in the order of their cells: where cells begin, the row that holds, the least and greatest finite value (or infinities).

    A finite value goes before NaN and the infinities, then the later row, then the larger value; null never holds unless alone.
    """
    at = table["at"].to_numpy()[order]
    new = np.r_[True, at[1:] != at[:-1]]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    cell = np.cumsum(new) - 1
    v = table["v"].to_numpy(zero_copy_only=False)[order]
    known = ~table["v"].is_null().to_numpy(zero_copy_only=False)[order]
    rank = known.astype(np.int8) + (known & np.isfinite(np.where(known, v, np.nan)))
    late = table["o"].fill_null(-np.inf).to_numpy()[order]
    # NaN is the largest of the values that are not finite.
    by = np.lexsort((np.where(known, v, 0), late, rank, cell))
    best = order[by[np.r_[first[1:], len(order)] - 1]]
    low = np.minimum.reduceat(table["low"].fill_null(np.inf).to_numpy()[order], first)
    high = np.maximum.reduceat(table["high"].fill_null(-np.inf).to_numpy()[order], first)
    return first, best, low, high


def _typed(kind: str, values: np.ndarray, valid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The column and a mask of the values it rejects."""
    if kind == "double":
        return pa.array(values, mask=~valid), np.zeros(len(values), bool)
    if kind == "bigint":
        # 2**63 is the first double beyond the range; -2**63 lies within it.
        fits = valid & np.isfinite(values) & (values == np.floor(values)) & (values >= -(2.0**63)) & (values < 2.0**63)
    else:
        fits = valid & ((values == 0) | (values == 1))
    held = np.where(fits, values, 0).astype(np.int64 if kind == "bigint" else bool)
    return pa.array(held, mask=~fits), valid & ~fits


def _build(kinds: list[str], e0: pa.Array, e1: pa.Array, row: np.ndarray, at: np.ndarray, v: np.ndarray, ok: np.ndarray, differs: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Cells in the order of row and column into columns; those that no cell has are nulls without a buffer of values."""
    n = len(e0)
    known = at >= 0
    row, at, v, ok, differs = row[known], at[known], v[known], ok[known], differs[known]
    by = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by], np.arange(len(kinds) + 1))
    rejected = np.zeros(len(at), bool)
    arrays = []
    for i, kind in enumerate(kinds):
        mine = by[edges[i] : edges[i + 1]]
        if not ok[mine].any():
            arrays.append(pa.nulls(n, ARROW[kind]))
            continue
        values, valid = np.zeros(n), np.zeros(n, bool)
        values[row[mine]], valid[row[mine]] = v[mine], ok[mine]
        column, refused = _typed(kind, values, valid)
        rejected[mine] = refused[row[mine]]
        arrays.append(column)

    def listed(mask: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[mask], minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(at[mask].astype(np.int32)))

    return pa.RecordBatch.from_arrays([e0, e1, *arrays, listed(differs), listed(rejected)], names)


def widen(
    rows: DataFrame,
    columns: list[tuple[str, str]],
    entity: tuple[str, str] = ("run_id", "step"),
    attribute: str = "key",
    value: str = "value",
    order: str = "logged_at",
) -> DataFrame:
    """One row per entity: its two keys, one typed column per attribute, ``conflicts`` and ``rejected``.

    The last two list column indices in the order of ``columns``.
    """
    kinds = [kind for _, kind in columns]
    types = dict(rows.dtypes)
    tidy = cells(rows, columns, entity, attribute, value, order).repartition("e0", "e1").sortWithinPartitions("e0", "e1", "at")
    inner = [f"c{i}" for i in range(len(columns))]
    names = ["e0", "e1", *inner, "conflicts", "rejected"]
    schema = ", ".join(
        [f"e0 {types[entity[0]]}", f"e1 {types[entity[1]]}"]
        + [f"{c} {k}" for c, k in zip(inner, kinds, strict=True)]
        + ["conflicts array<int>", "rejected array<int>"]
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            block = pa.Table.from_batches([batch])
            held = block if held is None else pa.concat_tables([held, block]).combine_chunks()
            if held.num_rows < BUILDER_ROWS:
                continue
            starts = _starts(held)
            if len(starts) > 1:  # the last entity may go on in the next batch
                yield whole(held.slice(0, int(starts[-1])), starts[:-1])
                held = held.slice(int(starts[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield whole(held, _starts(held))

    def whole(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        owner = np.searchsorted(starts, np.arange(table.num_rows), side="right") - 1
        cell, best, low, high = resolved(np.arange(table.num_rows), [owner], table)
        entities = table.select(["e0", "e1"]).take(pa.array(starts)).combine_chunks()
        ok = ~table["v"].is_null().to_numpy()[best]
        v = np.where(ok, table["v"].to_numpy()[best], 0)
        return _build(kinds, _one(entities["e0"]), _one(entities["e1"]), owner[cell], table["at"].to_numpy()[cell], v, ok, low < high, names)

    wide = tidy.mapInArrow(stream, schema)
    out = [F.col("e0").alias(entity[0]), F.col("e1").alias(entity[1])]
    out += [F.col(c).alias(n) for c, (n, _) in zip(inner, columns, strict=True)]
    return wide.select(*out, "conflicts", "rejected")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which a new entity begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("e0", "e1"):
        codes = _codes(table[name])
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def contradictions(wide: DataFrame, columns: list[tuple[str, str]], entity: tuple[str, str] = ("run_id", "step")) -> DataFrame:
    """``(entity keys, column_name)`` of every cell with at least two different finite values."""
    names = F.array(*[F.lit(n) for n, _ in columns])
    return (
        wide.where(F.col(entity[0]).isNotNull() & F.col(entity[1]).isNotNull())
        .select(*entity, F.explode("conflicts").alias("at"))
        .select(*entity, F.element_at(names, F.col("at") + 1).alias("column_name"))
    )
