"""References from facts to segments: checking, repairing, evidence tables, first claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_refs(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, owner, pos, ref, verdict): ok, missing, empty_text or duplicate, in this order, for each place of a list of refs."""
    flat = refs.select("meeting_id", "owner", F.posexplode("refs").alias("pos", "ref"))
    known = segments.select("meeting_id", F.col("segment_id").alias("ref"), "text")
    again = F.row_number().over(Window.partitionBy("meeting_id", "owner", "ref").orderBy("pos")) > 1
    verdict = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "empty_text").when(again, "duplicate").otherwise("ok")
    return flat.join(known, ["meeting_id", "ref"], "left").select("meeting_id", "owner", "pos", "ref", verdict.alias("verdict"))


def evidence(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, ref, place, start_ms, end_ms, speaker): distinct cited segments in order of their first citation."""
    ok = classify_refs(refs, segments).where("verdict in ('ok', 'duplicate')")
    first = ok.groupBy("meeting_id", "ref").agg(F.min(F.struct("owner", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("first"))
    cited = first.select("meeting_id", "ref", place.alias("place"))
    return cited.join(segments.select("meeting_id", F.col("segment_id").alias("ref"), "start_ms", "end_ms", "speaker"), ["meeting_id", "ref"])


def first_claims(refs: DataFrame) -> DataFrame:
    """(meeting_id, ref, owner): each ref belongs to the first owner that cites it."""
    return refs.select("meeting_id", "owner", F.explode("refs").alias("ref")).groupBy("meeting_id", "ref").agg(F.min("owner").alias("owner"))


def near_in_time(claims: DataFrame, segments: DataFrame, tolerance: int, bucket: int = 60_000) -> DataFrame:
    """The claims (meeting_id, speaker, start_ms, end_ms) that some segment of their speaker meets within the tolerance.

    Both sides are cut into time buckets for an equi join, so a long meeting isn't compared with itself.
    """
    keys, ends = ["meeting_id", "speaker"], ["start_ms", "end_ms"]

    def cut(df: DataFrame, side: str, by: int) -> DataFrame:
        first, last = F.floor((F.col("start_ms") - by) / bucket), F.floor((F.col("end_ms") + by) / bucket)
        return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ends], F.explode(F.sequence(first, F.greatest(first, last))).alias("bucket"))

    both = cut(claims.select(*keys, *ends).distinct(), "c", tolerance).join(cut(segments, "s", 0), [*keys, "bucket"])
    near = both.where((F.col("s_start_ms") - tolerance <= F.col("c_end_ms")) & (F.col("c_start_ms") <= F.col("s_end_ms") + tolerance))
    found = near.select(*keys, *[F.col(f"c_{c}").alias(c) for c in ends]).distinct()
    return claims.join(found, [*keys, *ends], "left_semi")
