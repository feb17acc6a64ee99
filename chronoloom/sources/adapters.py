"""Engine tables (segments, intervals, jobs, library, ...) from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, idx, segment_id, text, speaker, start_ms, end_ms) of conversations laid out on a time line."""
    text = F.coalesce("text", F.lit(""))
    speaker = F.when(F.col("role") == "user", "speaker_0").when(F.col("role") == "assistant", "speaker_1").otherwise("unknown")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").cast("long").alias("idx"), text.alias("text"), speaker.alias("speaker"),
        (F.length(text) * 60).cast("long").alias("dur"), (F.expr("(conv_id * 7 + turn * 13) % 5") * 700).cast("long").alias("gap"),
    )
    upto = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end_ms", F.sum(F.col("gap") + F.col("dur")).over(upto))
    segment_id = F.concat(F.lit("seg-"), F.lpad(F.col("idx").cast("string"), 6, "0"))
    return rows.select("meeting_id", "idx", segment_id.alias("segment_id"), "text", "speaker", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def intervals(spark: SparkSession, sf_dir: str, scale: int = 600) -> DataFrame:
    """(key, id, label, start_ms, end_ms) of events that last for their value."""
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), start.alias("start_ms"), "value")
    return rows.select("key", "id", "label", "start_ms", (F.col("start_ms") + F.rint(F.col("value") * 100).cast("long") * scale).alias("end_ms"))


def reference_intervals(spark: SparkSession, sf_dir: str, scale: int = 600) -> DataFrame:
    """Intervals moved by some minutes, as a ground truth to compare with."""
    shift = F.col("id") % 7 * 60000
    return intervals(spark, sf_dir, scale).select("key", "id", "label", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("audio"))


def results(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """(job_id, line, status, text_chars): results in order of arrival; without ``whole`` a third of the jobs has none."""
    rows = table(spark, sf_dir, "lineitem")
    if not whole:
        rows = rows.where("l_orderkey % 3 <> 0")
    status = F.when(F.col("l_returnflag") == "R", "failed").otherwise("success")
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), status.alias("status"), F.col("l_suppkey").alias("text_chars"))


STATES = ("created", "recording", "uploading", "processing", "review_ready", "finalizing", "finalized", "failed", "cancelled")
PATHS = ("exports/formal_minutes.html", "source.wav", "upload.part", "result.json", "processing.wav", "notes.txt", "source.MP3", "a/Exports/x.bin")


def pick(values: tuple, number: str) -> F.Column:
    """The value at a place from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({number} as int)") + 1)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, title, state, audio_state, size, created_at, updated_at): a library of recordings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("meeting_id"), F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string")).alias("title"), pick(STATES, "doc_id % 9").alias("state"),
        pick(("available", "deleted", None), "floor(doc_id / 9) % 3").alias("audio_state"), F.col("n_chars").cast("long").alias("size"), (F.col("doc_id") * 7919 % 100003).alias("created_at"), (F.col("doc_id") * 104729 % 100003).alias("updated_at"),
    )


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("meeting_id"), pick(PATHS, "doc_id % 8").alias("path"), F.col("n_chars").cast("long").alias("size"))


def segment_name(number: F.Column) -> F.Column:
    return F.concat(F.lit("seg-"), F.lpad(number.cast("string"), 6, "0"))


def summary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary's facts, one of five fields a segment, with faults: placeholders, unknown refs, owners and deadlines nobody gave."""
    i = F.col("idx")
    return segments(spark, sf_dir).select(
        "meeting_id", pick(("chapters", "speakers", "key_points", "decisions", "action_items"), "idx % 5").alias("field"), F.floor(i / 5).alias("pos"),
        F.when(i % 7 == 3, "none").otherwise(F.concat(F.lit("item "), (i % 4).cast("string"))).alias("text"), F.when(i % 11 != 5, F.concat(F.lit("about "), (i % 3).cast("string"))).alias("overview"),
        F.array(segment_name(i), segment_name(i + 1), segment_name(i), F.lit("seg-999999")).alias("refs"), "speaker", F.when(i % 2 == 0, "speaker_1").otherwise("somebody").alias("owner"),
        F.when(F.col("meeting_id") % 3 == 0, F.col("text")).otherwise("never said").alias("deadline"), F.when((F.col("meeting_id") % 13 == 0), "seg-999999").alias("start_ref"), F.lit(None).cast("string").alias("end_ref"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that say something, as turns numbered from 1."""
    return segments(spark, sf_dir).where("trim(text) <> ''").select("meeting_id", (F.col("idx") + 1).alias("turn_id"), "speaker", "start_ms", "end_ms", "text")


def map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of map outputs with the turns that they name, some empty, unclear or of no turn."""
    i = F.col("idx")
    ids = F.when(i % 5 == 4, F.array().cast("array<long>")).otherwise(F.array_compact(F.array(i + 1, i + 2, F.when(i % 3 == 0, F.lit(999).cast("long")))))
    return segments(spark, sf_dir).select(
        "meeting_id", pick(("decisions", "risks"), "idx % 2").alias("field"), i.alias("pos"), F.when(i % 5 == 2, "").otherwise("text").alias("text"), F.when(i % 4 == 1, "未明确").alias("owner"), F.lit(None).cast("string").alias("due"), ids.alias("turn_ids"),
    )
