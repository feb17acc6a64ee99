"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Equal vectors form a class with one representative. In each table a vector falls into the bucket of the signs of its
products with random directions; the number of directions grows with the logarithm of the number of classes, so buckets
keep their size, and the number of tables follows from it so that a pair at the threshold shares a bucket with
probability RECALL. Members of a bucket are compared by their cosines in double precision. Buckets of more than SPLIT
members are dealt as squares of sub-blocks to several tasks. A linked pair counts only in the first table in which both
share a bucket, so link counts are sums and no list of pairs is kept; each square hands on a spanning forest of its links.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Vectors of
different lengths aren't compared. Copies link with each other, so ties need no order. Rows that repeat an id are vectors of their own, each
output row tells its own links; a row without an id isn't kept, as nothing can refer to it. Empty tables give empty results. Extra columns are ignored.
Vectors travel in the type they came in and are made unit vectors in double precision where they are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import connected_components, discard, materialize, tidy
from chronoloom.llm.words import mix

RECALL = 0.999
#: Members that share a bucket by chance, about; larger squares of a bucket's members go to tasks of their own.
BUCKET, SPLIT = 128, 1024


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values in double precision, a row each) of the vectors of each length; null and empty vectors and those with null components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    flat = column.flatten()  # values of null vectors are left out
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    whole = (size > 0) & (holes[at[1:]] == holes[at[:-1]])
    out = []
    for d in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == d))
        out.append((rows, values[at[rows][:, None] + np.arange(d)]))
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def class_digests(x: np.ndarray, salt: int) -> np.ndarray:
    """Equal vectors have equal digests; 0.0 and -0.0 are equal."""
    place = np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    return mix(mix((x + 0.0).view(np.uint64) ^ place).sum(axis=1, dtype=np.uint64) + np.uint64(x.shape[1]))


def _classify(batches):
    """Validity and digests of each vector."""
    for batch in batches:
        good, c, c2 = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        for rows, x in matrices(batch.column(1)):
            fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
            rows, x = rows[fine], np.ascontiguousarray(x[fine])
            good[rows], c[rows], c2[rows] = True, class_digests(x, 0), class_digests(x, 0x5851F42D4C957F2D)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good), pa.array(c.view(np.int64)), pa.array(c2.view(np.int64))], ["vec_id", "v", "valid", "c", "c2"])


class Planes:
    """Random directions of each table, for vectors of any length."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed, self.held = bits, tables, seed, {}

    def keys(self, units: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table; vectors of other lengths have other keys."""
        d = units.shape[1]
        if d not in self.held:
            self.held[d] = np.random.Generator(np.random.PCG64([self.seed, d])).standard_normal((d, self.bits * self.tables))
        signs = (units @ self.held[d] > 0).reshape(len(units), self.tables, self.bits)
        bucket = signs @ (1 << np.arange(self.bits, dtype=np.int64))
        return mix(bucket.astype(np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(d) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _keys(bits: int, tables: int, seed: int):
    planes = Planes(bits, tables, seed)

    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for rows, x in matrices(batch.column(1)):
                keys[rows] = planes.keys(unit_rows(x))
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))], ["c", "keys"])

    return run


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indexes of pairs that span the components of 0..n-1."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for p, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            kept.append(p)
    return kept


def _compare(least: float, bits: int, tables: int, seed: int):
    """Squares of buckets (t, key, square, s, c, size, v), sorted: link counts (b null) and forest edges."""
    planes = Planes(bits, tables, seed)

    def one(group: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(group)
        c, size, s, t = (rows.column(k).to_numpy() for k in ("c", "size", "s", "t"))
        sides = np.unique(s)
        own, x = matrices(rows.column("v"))[0]  # a bucket's vectors have one length, of 64-bit keys
        assert len(own) == len(c)
        unit = unit_rows(x)
        mine, other = (np.flatnonzero(s == sides[0]), np.flatnonzero(s == sides[-1]))
        xs, ys = [], []
        for i in range(0, len(mine), SPLIT):
            a = mine[i : i + SPLIT]
            for j in range(i if len(sides) == 1 else 0, len(other), SPLIT):
                b = other[j : j + SPLIT]
                x, y = np.nonzero(unit[a] @ unit[b].T >= least)
                x, y = a[x], b[y]
                if len(sides) == 1:
                    x, y = x[x < y], y[x < y]
                xs.append(x)
                ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        square = rows.column("square")[0].as_py()
        if len(sides) == 1 and square != f"{sides[0]}-{sides[0]}":
            x, y = x[:0], y[:0]  # one side of this square is empty; its own square compares the other
        table, fresh = int(t[0]), np.ones(len(x), bool)
        if len(x) and table:  # pairs that share a bucket in an earlier table were told there
            some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            keys = planes.keys(unit[some])[:, :table]
            fresh = ~(keys[where[: len(x)]] == keys[where[len(x) :]]).any(axis=1)
        links = np.bincount(x[fresh], weights=size[y[fresh]], minlength=len(c)) + np.bincount(y[fresh], weights=size[x[fresh]], minlength=len(c))
        have = np.flatnonzero(links)
        kept = _forest(len(c), x, y)
        a = np.concatenate([c[have], c[x[kept]]])
        b = pa.array(np.concatenate([np.zeros(len(have), np.int64), c[y[kept]]]), mask=np.concatenate([np.ones(len(have), bool), np.zeros(len(kept), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[have], np.zeros(len(kept))]).astype(np.int64))], ["a", "b", "links"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            names = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("t", "key", "square")]
            ids = list(zip(*names))
            lo = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[lo]:
                    if last is not None and ids[lo] != last:
                        yield one(held)
                        held = []
                    held.append(batch.slice(lo, i - lo))
                    last, lo = ids[lo], i
        if held:
            yield one(held)

    return run


@tidy
def embedding_components(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(_classify, f"vec_id long, v {kind}, valid boolean, c long, c2 long")
    # classes go by both digests, named by one number
    rows = materialize(rows.withColumn("c", F.xxhash64("c", "c2")).drop("c2"), "vectors")
    good = rows.where("valid")
    classes = good.groupBy("c").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    units = materialize(good.select("c", "v").dropDuplicates(["c"]).join(classes, "c"), "classes")
    n = units.count()
    bits = max(8, math.floor(math.log2(max(1, n / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))
    keyed = materialize(units.select("c", "v").mapInArrow(_keys(bits, tables, seed), "c long, keys array<long>"), "keys")

    light = keyed.select("c", F.posexplode("keys").alias("t", "key"))
    large = light.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    light = light.join(large.select("t", "key", parts.alias("m")), ["t", "key"]).withColumn("s", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
    square = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: F.concat_ws("-", F.least(x, F.col("s")), F.greatest(x, F.col("s")))))
    light = light.withColumn("square", square)
    full = light.join(units.select("c", "size", "v"), "c").select("t", "key", "square", "s", "c", "size", "v")
    found = materialize(full.repartition("t", "key", "square").sortWithinPartitions("t", "key", "square").mapInArrow(_compare(least, bits, tables, seed), "a long, b long, links long"), "links")
    discard(keyed)

    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "c")
    comp = connected_components(found.where("b is not null").select("a", "b"))
    by_class = units.select("c", "rep", "size").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(smallest, "component").join(links, "c", "left").select("c", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    bad = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "c").join(by_class, "c").select("vec_id", "n_links", "component_id").union(bad)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
