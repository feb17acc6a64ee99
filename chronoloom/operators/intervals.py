"""Interval algebra by key: padding, islands, gaps, splitting, overlap joins, gap absorption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import overlap_ms


def pad(rows: DataFrame, by: int, least: Column, most: Column) -> DataFrame:
    """Intervals widened on both sides within [least, most]; empty ones go."""
    wide = rows.withColumns({"start_ms": F.greatest(least, F.col("start_ms") - by), "end_ms": F.least(most, F.col("end_ms") + by)})
    return wide.where("end_ms > start_ms")


def islands(rows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """(keys, island, start_ms, end_ms, n): unions of intervals at most ``gap`` apart, numbered from 1 within a key."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_ms") <= before + gap, 0).otherwise(1)
    marked = rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def gaps(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, gap_no, start_ms, end_ms): what no interval covers between the first and the last, from ``least`` on."""
    order = Window.partitionBy(*keys).orderBy("start_ms")
    found = islands(rows, keys).withColumn("_next", F.lead("start_ms").over(order)).where(F.col("_next") - F.col("end_ms") >= least)
    return found.select(*keys, F.row_number().over(order).alias("gap_no"), F.col("end_ms").alias("start_ms"), F.col("_next").alias("end_ms"))


def split_long(rows: DataFrame, most: int) -> DataFrame:
    """Pieces of at most ``most`` milliseconds, with their number."""
    last = F.greatest(F.ceil((F.col("end_ms") - F.col("start_ms")) / most) - 1, F.lit(0)).cast("int")
    out = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("start_ms") + F.col("piece").cast("long") * most
    return out.withColumns({"start_ms": first, "end_ms": F.least(F.col("end_ms"), first + most)})


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of the same key that overlap: columns of ``a`` as a_*, of ``b`` as b_*.

    Both sides are cut into time buckets for an equi join; a pair comes only from the bucket in which it begins, so
    no pair comes twice. Choose the bucket near the usual length. Cut rows outgrow what Spark estimates, so neither side is broadcast.
    """
    def cut(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
        first, last = F.floor(F.col(f"{side}_start_ms") / bucket), F.floor((F.col(f"{side}_end_ms") - 1) / bucket)
        return named.where(F.col(f"{side}_end_ms") > F.col(f"{side}_start_ms")).withColumn("_bucket", F.explode(F.sequence(first, last)))

    both = cut(a, "a").join(cut(b, "b").hint("merge"), [*keys, "_bucket"])
    begin = F.greatest("a_start_ms", "b_start_ms")
    return both.where((F.col("a_start_ms") < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("a_end_ms")) & (F.floor(begin / bucket) == F.col("_bucket"))).drop("_bucket")


def overlap_of(pairs: DataFrame) -> Column:
    return overlap_ms(F.col("a_start_ms"), F.col("a_end_ms"), F.col("b_start_ms"), F.col("b_end_ms"))


def shared_time(rows: DataFrame, reference: DataFrame, keys: list[str], kept: list[str], first: bool = False) -> DataFrame:
    """(keys, kept, ref_label, ms): time that rows share with the reference's intervals of each label, summed over both; none: no row.

    No pair is made. Of a label's ends and beginnings behind a time t, let H(t) be the sum of ends - t less that of beginnings - t: an interval shares
    H(start) - H(end) with all of them, and H is a running sum over both sides' points in descending order. There are two rows an interval and label of the
    other side's key; a key's labels must be few. ``first`` adds ``at`` (start_ms, end_ms, id): the first interval of the label that ends after the row begins, so the first
    of those that overlap it.
    """
    filled = "end_ms > start_ms"
    of = [F.col("start_ms"), F.col("end_ms"), *([F.col("id")] if first else [])]
    ref = reference.where(filled).select(*keys, F.col("label").alias("ref_label"), *of)
    labels = ref.groupBy(*keys).agg(F.collect_set(F.struct("ref_label")).alias("_labels"))  # in structs nulls are kept
    own = rows.where(filled).select(*keys, *[F.col(c).alias(f"_own_{c}") for c in kept], "start_ms", "end_ms").join(labels, keys).withColumn("_l", F.explode("_labels"))

    def points(begin: int, end: int, weigh: str, other: str) -> Column:
        def point(t: str, n: int) -> Column:
            return F.struct(F.col(t).cast("long").alias("_t"), F.lit(n).alias(weigh), F.lit(0).alias(other))

        return F.explode(F.array(point("start_ms", begin), point("end_ms", end))).alias("_p")

    own = own.select(*keys, "_l.ref_label", *[f"_own_{c}" for c in kept], points(1, -1, "_sign", "_weight")).select("*", "_p.*").drop("_p")
    ref = ref.select(*keys, "ref_label", *([F.struct(*of).alias("_of")] if first else []), points(-1, 1, "_weight", "_sign")).select("*", "_p.*").drop("_p")
    both = own.unionByName(ref, allowMissingColumns=True).repartition(*keys)
    label = Window.partitionBy(*keys, "ref_label")
    behind = label.orderBy(F.desc("_t"), F.desc(F.abs("_sign"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = [F.sum(F.col("_sign") * F.col("_h")).alias("ms")]
    if first:
        # of a label's intervals in order, those that end after all before: the first that ends after a time is one of them
        end = F.col("_weight") == 1
        before = F.max(F.when(end, F.col("_t"))).over(label.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn("_record", F.when(end & F.coalesce(F.col("_t") > before, F.lit(True)), F.col("_of")))
        both = both.withColumn("_at", F.last("_record", ignorenulls=True).over(behind))
        told.append(F.min(F.when(F.col("_sign") == 1, F.col("_at"))).alias("at"))
    both = both.withColumn("_h", F.sum(F.col("_weight") * F.col("_t")).over(behind) - F.col("_t") * F.sum("_weight").over(behind))
    names = [F.col(f"_own_{c}").alias(c) for c in kept]
    return both.where("_sign <> 0").groupBy(*keys, *names, "ref_label").agg(*told).where("ms > 0")


def meets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_ms, end_ms): what both sides cover; the intervals of a side don't overlap each other within a key.

    A sweep over the points of both: it is where two intervals are open.
    """
    point = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("n")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("n"))))
    points = a.select(*keys, "start_ms", "end_ms").unionByName(b.select(*keys, "start_ms", "end_ms")).where("end_ms > start_ms").select(*keys, point.alias("_p")).select(*keys, "_p.t", "_p.n")
    order = Window.partitionBy(*keys).orderBy("t", "n")
    open_ = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = points.select(*keys, F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), open_.alias("_open"))
    return found.where("_open = 2 and end_ms > start_ms").drop("_open")


def coverage(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with covered_ms: what the reference's union covers of it."""
    union = islands(reference.where("end_ms > start_ms"), keys).withColumn("label", F.lit("any"))
    covered = shared_time(rows, union, keys, ["id"]).select(*keys, "id", F.col("ms").alias("covered_ms"))
    return rows.join(covered, [*keys, "id"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0).cast("long")))
