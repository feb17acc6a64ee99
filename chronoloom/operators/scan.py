"""Running totals along ordered groups of any length.

Rows are dealt over range partitions of (keys, order), so a group that holds a third of all rows is split over many tasks. Each task
streams its sorted rows once in Arrow batches and carries one group's totals. Only the first and the last group of a partition can
go on in another one: of these it also writes one row of totals, two a partition at most. From those the totals before each part of a split group are
found and joined to its rows. Rows that are equal in keys and order are told apart by a number of their own, so they are split too.

Edge cases: null keys form a group like any other; null values count as 0. Ties of the order are numbered in any order. Empty
tables give empty results. Columns of any other name are kept; names that begin with ``_scan`` are the scan's own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.tables import written

PART, TOTALS = "_scan_part", "_scan_totals"


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values of a batch are."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _before(column: pa.Array, begin: np.ndarray, goes_on: np.ndarray, held: int | None) -> pa.Array:
    """For each row the last value that isn't null before it in its group; ``held`` is that of the batches before."""
    n = len(column)
    known = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
    at = np.concatenate([[-1], np.maximum.accumulate(known)[:-1]])
    some = at >= begin
    value = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[np.maximum(at, 0)]
    if held is not None:
        value = np.where(~some & goes_on, held, value)
        some = some | goes_on
    return pa.array(value, mask=~some)


def _local(keys: list[str], names: list[str], values: list[tuple[str, str, str]], counts: bool):
    """Rows of one partition with totals up to each row; values: (column, 'sum' or 'xor', name of the result)."""
    added = [name for _, _, name in values]

    def run(batches):
        part = TaskContext.get().partitionId()
        first = open_ = kinds = None  # (key, totals) of the partition's first group once it has ended, and of the open one
        head = ["pos"] * counts + added

        def out(columns, n, totals):
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), totals], [*names, *head, PART, TOTALS])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = [f.type for f in batch.schema]
            at = [batch.schema.get_field_index(k) for k in keys]

            def key_of(i: int) -> tuple:
                return tuple(batch.column(j)[int(i)].as_py() for j in at)

            fresh = np.zeros(n, bool)
            for j in at:
                codes = _codes(batch.column(j))
                fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] = open_ is None or key_of(0) != open_[0]
            starts, group = np.flatnonzero(fresh), np.cumsum(fresh)
            begin = np.concatenate([[0], starts])[group]
            goes_on = group == 0  # rows of the group that the batch before has left open
            totals = [np.arange(n) - begin + 1]
            if goes_on.any():
                totals[0][goes_on] += open_[1][0]
            for j, (column, kind, _) in enumerate(values, 1):
                if kind == "last":
                    totals.append(_before(batch.column(batch.schema.get_field_index(column)), begin, goes_on, open_[1][j] if open_ else None))
                    continue
                v = batch.column(batch.schema.get_field_index(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.bitwise_xor.accumulate(v) if kind == "xor" else np.cumsum(v)
                before = np.concatenate([[0], upto])[begin]
                own = upto ^ before if kind == "xor" else upto - before
                if goes_on.any():
                    own[goes_on] = own[goes_on] ^ open_[1][j] if kind == "xor" else own[goes_on] + open_[1][j]
                totals.append(own)
            def upto(i: int) -> list:
                out = [int(totals[0][i])]
                for (column, kind, _), t in zip(values, totals[1:]):
                    own = batch.column(batch.schema.get_field_index(column))[int(i)].as_py() if kind == "last" else None
                    out.append(own if own is not None else t[int(i)].as_py() if kind == "last" else int(t[i]))
                return out

            if first is None and len(starts):
                if open_ is not None:
                    first = (open_[0], upto(starts[0] - 1) if starts[0] else open_[1])
                elif len(starts) > 1:
                    first = (key_of(starts[1] - 1), upto(starts[1] - 1))
            open_ = (key_of(n - 1), upto(n - 1))
            yield out([*batch.columns, *[t if isinstance(t, pa.Array) else pa.array(t) for t in (totals if counts else totals[1:])]], n, pa.nulls(n, pa.list_(pa.int64())))
        edges = [g for g in (first, open_) if g is not None]
        if edges:
            columns = [pa.array([k[keys.index(c)] for k, _ in edges], t) if c in keys else pa.nulls(len(edges), t) for c, t in zip(names, kinds)]
            yield out([*columns, *[pa.nulls(len(edges), pa.int64()) for _ in head]], len(edges), pa.array([t for _, t in edges], pa.list_(pa.int64())))

    return run


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, count: bool = False, lasts: dict[str, str] | None = None, write: Callable[[DataFrame, str], DataFrame] = written, name: str = "scan") -> DataFrame:
    """``df`` with totals of each key up to and with each row in an order.

    sums and xors: {name of the result: column of whole numbers}; count adds ``pos``, the row's number from 1; lasts: the last value
    that isn't null before each row, without its own. The result reads a table that ``write`` has put into the shared folder.
    """
    values = [(c, "sum", r) for r, c in (sums or {}).items()] + [(c, "xor", r) for r, c in (xors or {}).items()] + [(c, "last", r) for r, c in (lasts or {}).items()]
    row = "_scan_row"
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col(row).asc()]
    dealt = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop(row)
    added = ["pos"] * count + [r for _, _, r in values]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + [f"`{c}` long" for c in added] + [f"{PART} int", f"{TOTALS} array<long>"])
    held = write(dealt.mapInArrow(_local(keys, dealt.columns, values, count), schema), name)
    rows, edges = held.where(f"{TOTALS} is null").drop(TOTALS), held.where(f"{TOTALS} is not null")
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(F.col(TOTALS)[0]).over(earlier), F.lit(0)).alias("_scan_n")]
    for i, (_, kind, r) in enumerate(values, 1):
        one = F.col(TOTALS)[i]
        total = (F.last(one, ignorenulls=True) if kind == "last" else F.sum(one) if kind == "sum" else F.bit_xor(one)).over(earlier)
        before.append((total if kind == "last" else F.coalesce(total, F.lit(0))).alias(f"_scan_{r}"))
    # of all partitions, those parts that go on with a group: one row a partition at most
    offsets = edges.select(*[F.col(k).alias(f"_scan_key{i}") for i, k in enumerate(keys)], F.col(PART).alias("_scan_of"), *before).where("_scan_n > 0")
    on = F.col(PART) == F.col("_scan_of")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_scan_key{i}"))
    out = rows.join(F.broadcast(offsets), on, "left")
    full = {"pos": F.col("pos") + F.coalesce("_scan_n", F.lit(0))} if count else {}
    for _, kind, r in values:
        if kind == "last":
            full[r] = F.coalesce(r, f"_scan_{r}")
            continue
        more = F.coalesce(f"_scan_{r}", F.lit(0))
        full[r] = F.col(r).bitwiseXOR(more) if kind == "xor" else F.col(r) + more
    return out.select(*df.columns, *[c.alias(r) for r, c in full.items()])
