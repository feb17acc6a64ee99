"""Library queries: lists, facets, pages, storage, searches, drafts over transcripts, as-of lookups, records by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a meeting that are being worked on, and the facets of a list.
PROCESSING = ("created", "recording", "uploading", "processing", "finalizing")
FACETS = ("processing", "failed", "review", "confirmed", "deleted")
# Kinds of stored files.
AUDIO_ENDINGS = (".wav", ".mp3", ".m4a", ".flac", ".aac", ".ogg")
RESULT_NAMES = ("result.json", "board_result.json", "diagnostics.json", "error_report.json")
EXPORT_NAMES = ("formal_minutes.html", "formal_minutes.txt", "formal_result.json", "manifest.json")


def facet_of(state: Column, audio_state: Column) -> Column:
    return (
        F.when(state == "failed", "failed").when(state.isin(*PROCESSING), "processing").when(state == "review_ready", "review")
        .when((state == "finalized") & F.coalesce(audio_state == "deleted", F.lit(False)), "deleted").when(state == "finalized", "confirmed").otherwise("all")
    )


def search(rows: DataFrame, text: str = "", facet: str = "all", sort: str = "updated_desc") -> DataFrame:
    """Rows whose title holds the text in any case, of a facet, with ``place`` in the order asked for."""
    text = text.strip().lower()
    found = rows.where(F.contains(F.lower("title"), F.lit(text))) if text else rows
    if facet != "all":
        found = found.where(facet_of(F.col("state"), F.col("audio_state")) == facet)
    order = {"title_asc": [F.lower("title")], "created_desc": [F.desc("created_at")]}.get(sort, [F.desc("updated_at")])
    return found.orderBy(*order, "meeting_id")


def facets(rows: DataFrame) -> DataFrame:
    """One row of counts, with zeros for facets that don't occur; rows of no facet count among all only."""
    kind = facet_of(F.col("state"), F.col("audio_state"))
    return rows.agg(F.count("*").alias("all_rows"), *[F.count_if(kind == f).alias(f) for f in FACETS])


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows in an order, with the total and whether more follow; the size is kept within 1 to 100."""
    size, number = min(100, max(1, size)), max(1, number)
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total).withColumn("has_more", F.col("total") > number * size)


def storage_items(rows: DataFrame, files: DataFrame, active: DataFrame) -> DataFrame:
    """Rows with the first audio file by name, its size, the state of the audio and whether it may be deleted."""
    name = F.element_at(F.split("path", "/"), -1)
    audio = files.where(name.startswith("source.") & ends_with(F.lower(name), AUDIO_ENDINGS)).groupBy("meeting_id").agg(F.min_by("size", name).alias("file_size"))
    state = F.when(F.col("audio_state") == "deleted", "deleted").when(F.col("file_size").isNotNull(), "available").otherwise(F.coalesce("audio_state", F.lit("pending")))
    out = rows.join(audio, "meeting_id", "left").join(active.select("meeting_id").distinct().withColumn("_active", F.lit(True)), "meeting_id", "left")
    return out.select(
        "meeting_id", "title", F.coalesce("state", F.lit("created")).alias("state"), state.alias("audio_state"), F.coalesce("file_size", "size").alias("audio_size"),
        ((F.col("state") == "finalized") & (state == "available") & F.col("_active").isNull()).alias("deletable"),
    )


def ends_with(text: Column, endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in endings:
        found = found | text.endswith(e)
    return found


def file_category(path: Column) -> Column:
    """Of a path below the root, in this order: exports, results, temporary files, audio, other."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    audio = ends_with(name, AUDIO_ENDINGS) & (name.startswith("source.") | (name == "processing.wav"))
    return (
        F.when(F.array_contains(F.split(low, "/"), "exports") | name.isin(*EXPORT_NAMES), "exports").when(name.isin(*RESULT_NAMES), "results")
        .when(ends_with(name, (".part", ".staging", ".tmp")), "temp").when(audio, "audio").otherwise("other")
    )


def storage_status(free: Column, warning: int, least: int) -> Column:
    return F.when(free < least, "insufficient").when(free < warning, "warning").otherwise("ok")


def overlay(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the text of a draft's edits (meeting_id, segment_id, new_text) where there are any."""
    out = segments.join(edits, ["meeting_id", "segment_id"], "left")
    return out.withColumn("edited", F.col("new_text").isNotNull()).withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def as_of(points: DataFrame, rows: DataFrame, forward: bool = False) -> DataFrame:
    """Points (meeting_id, at_ms) with the last segment that starts at or before each, or the next from it on (null if none).

    Both sides stand in one ordered stream per meeting, so no pairs are made.
    """
    held = F.struct("start_ms", "idx", "segment_id")
    seg = rows.select("meeting_id", F.col("start_ms").alias("at_ms"), F.lit(None).cast("long").alias("point"), held.alias("hit"))
    pts = points.select("meeting_id", "at_ms", "point", F.lit(None).cast(seg.schema["hit"].dataType).alias("hit"))
    both = seg.unionByName(pts).withColumn("_point", F.col("point").isNotNull().cast("int"))
    if forward:
        order = Window.partitionBy("meeting_id").orderBy(F.desc("at_ms"), "_point", F.desc("hit.idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        order = Window.partitionBy("meeting_id").orderBy("at_ms", "_point", "hit.idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("found", F.last("hit", ignorenulls=True).over(order)).where("_point = 1").select("meeting_id", "point", "at_ms", "found.segment_id")


def upsert_records(old: DataFrame, new: DataFrame, states: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(records after updates by meeting_id, refused updates with a reason); an update adds 1 to seq.

    Refused are updates of unknown ids, of states outside the domain, and several updates of one id.
    """
    n = new.withColumn("_n", F.count("*").over(Window.partitionBy("meeting_id"))).join(old.select("meeting_id", F.lit(True).alias("_known")), "meeting_id", "left")
    reason = F.when(F.col("_known").isNull(), "not_found").when(~F.col("new_state").isin(*states), "unknown_state").when(F.col("_n") > 1, "several_updates")
    n = n.withColumn("reason", reason)
    good = n.where("reason is null").select("meeting_id", "new_state")
    out = old.join(good, "meeting_id", "left").withColumn("seq", F.col("seq") + F.col("new_state").isNotNull().cast("long")).withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    return out, n.where("reason is not null").select("meeting_id", "new_state", "reason")


def save_drafts(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (meeting_id, expected_revision, expected_base) against drafts (meeting_id, revision, base): accepted with the next revision, or why not."""
    rows = requests.join(drafts, "meeting_id", "left")
    verdict = F.when(F.col("revision").isNull(), "not_found").when(F.col("expected_base") != F.col("base"), "base_conflict").when(F.col("expected_revision") != F.col("revision"), "draft_conflict").otherwise("saved")
    return rows.select("meeting_id", verdict.alias("verdict"), F.when(verdict == "saved", F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))
