"""Helpers that several corpus operators share: durable tables, bit-table filters, connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of written tables, for ``discard``.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: The innermost list takes the folders that ``scratch_tables`` removes.
_SCOPES: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only on a local master that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-chronoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of an Arrow batch where the session sets no bound: 10,000 whole texts at once are too much for a task.

    The bound stays in the session, since results are computed when the caller asks for them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside go as soon as each table stands; the session is left as it was."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose first argument is a frame, run with ``tidy_shuffles``."""
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        with tidy_shuffles(df.sparkSession):
            return operator(df, *args, **kwargs)

    return run


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back, which cuts its lineage.

    Losing an executor then costs only the tasks it held: earlier steps are read from the table. With ``keep`` the table
    outlives the ``scratch_tables`` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return out


def _remove(spark: SparkSession, table: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame | None) -> None:
    """Remove tables of ``materialize`` that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = _WRITTEN.pop(df, None) if df is not None else None
        if path:
            _remove(df.sparkSession, path)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but those written with ``keep``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def free_name(taken: list[str], name: str) -> str:
    """A name that isn't among the taken ones; Spark doesn't tell upper case from lower case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def but_own(columns: list[str], *own: str) -> list[str]:
    """The columns whose names aren't an operator's own, in any case."""
    low = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in low]


def place_of(df: DataFrame, column: str) -> int:
    return [c.lower() for c in df.columns].index(column.lower())


def numbered_columns(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, .. whatever the caller calls them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _bit_table(ids: DataFrame, key: str, bits: int) -> DataFrame:
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    table = ids.select(slot.alias("slot")).select((F.col("slot") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    return table.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))


def _marked(df: DataFrame, ids: DataFrame, key: str, bits: int) -> tuple[DataFrame, str]:
    """(the rows with numbered columns and ``maybe``, the name of the key)."""
    own = f"c{place_of(df, key)}"
    marked = numbered_columns(df).withColumn("slot", F.pmod(F.xxhash64(F.col(own)), F.lit(bits))).withColumn("word", (F.col("slot") / 64).cast("long"))
    marked = marked.join(F.broadcast(_bit_table(ids, key, bits)), "word", "left")
    return marked.withColumn("maybe", F.expr("coalesce((shiftrightunsigned(bits, cast(slot % 64 as int)) & 1L) = 1L, false)")), own


def sift(df: DataFrame, ids: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids``: a bit table of fixed size in front of an exact join.

    The table has bits/64 rows at most (8 MB), so it is broadcast whatever the number of ids; with very many ids it
    only lets more rows through. Columns of any name are kept as they are.
    """
    marked, _ = _marked(df, ids, key, bits)
    return marked.where("maybe").select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """Rows of ``df`` whose key isn't among ``ids``: only rows that the bit table can't clear are shuffled to an exact join.

    Columns of any name are kept as they are.
    """
    marked, own = _marked(df, ids, key, bits)
    names = [f"c{i}" for i in range(len(df.columns))]
    clear, maybe = marked.where("not maybe").select(*names), marked.where("maybe").select(*names)
    gone = ids.select(F.col(key).alias(own))
    return clear.union(maybe.join(gone, own, "left_anti").select(*names)).toDF(*df.columns)


def _star(links: DataFrame) -> DataFrame:
    """(u, v, m) of links (u, v): m is the smallest of u and all its v.

    The minimum is found by partial aggregation; a node with very many links is one row on the other side of the join, so
    adaptive execution may split its links.
    """
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    return links.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge list; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) written as aggregations and joins. Each round is
    written to the shared folder and the one before removed. The number of rounds grows with the logarithm
    of the size of a component.
    """
    def tidied(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialize(tidied(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    while True:
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        large = tidied(_star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        up = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = up.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, materialize(tidied(small), "edges")
        discard(before)
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("own"), F.lit(0).alias("head")), F.struct(F.col("b").alias("u"), F.lit(0).alias("own"), F.lit(1).alias("head")))).alias("e"))
        ends = ends.groupBy("e.u").agg(F.sum("e.own").alias("own"), F.max("e.head").alias("head"))
        if ends.where("own > 1 or own = 1 and head = 1").isEmpty():
            break  # every node hangs on one that hangs on none
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
