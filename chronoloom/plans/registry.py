"""All queries of the library by name, with the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalars, text
from chronoloom.operators import intervals as iv
from chronoloom.operators import library as lib
from chronoloom.operators import lineage, mapreduce, metrics, packing, sequence, topics
from chronoloom.operators.tables import new_folder
from chronoloom.plans import deep, files, products, wide  # noqa: F401
from chronoloom.plans.oracle import SQL
from chronoloom.sources import adapters as src
from chronoloom.streaming import events as streams

HOUR = 3_600_000
KEY = ["key"]
#: Longer and more overlapping intervals, for overlap joins.
LONG = 6000


def interval_islands(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(src.intervals(spark, d), KEY)


def merge_same_label(spark, d):
    return iv.islands(src.intervals(spark, d, LONG), ["key", "label"], 60_000)


def coverage_gaps(spark, d):
    return iv.gaps(src.intervals(spark, d), KEY, 1000)


def pad_and_split(spark, d):
    wide = iv.pad(src.intervals(spark, d), 500, F.lit(1_704_067_200_000), F.lit(1_706_745_600_000))
    return iv.split_long(wide, 600_000).select("key", "id", "piece", "start_ms", "end_ms")


def overlap_matrix(spark, d):
    return metrics.overlap_matrix(src.intervals(spark, d, LONG), src.reference_intervals(spark, d, LONG), KEY)


def interval_coverage(spark, d):
    return iv.coverage(src.intervals(spark, d, LONG), src.reference_intervals(spark, d, LONG), KEY)


def duration_stats(spark, d):
    return metrics.duration_stats(src.intervals(spark, d, 6), (F.col("end_ms") - F.col("start_ms")) / 1000, "label")


def overlapping_groups(spark, d):
    rows = metrics.grouped_with_totals(src.segments(spark, d), "speaker", "unknown")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def canonical_transcript(spark, d):
    s = src.segments(spark, d)
    return s.select("meeting_id", "idx", "segment_id", scalars.normalize_speaker(F.regexp_replace("speaker", "^speaker_", "")).alias("speaker"), "start_ms", "end_ms", F.length("text").cast("long").alias("chars"))


def transcript_stats(spark, d):
    empty = F.trim("text") == ""
    return src.segments(spark, d).groupBy("meeting_id").agg(
        F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.length("text")).alias("chars"),
    )


def timeline_text(spark, d):
    from chronoloom.sources.formats import timeline_line

    line = timeline_line(F.col("segment_id"), scalars.format_ms(F.col("start_ms")), scalars.format_ms(F.col("end_ms")), F.col("speaker"), F.col("text"))
    return src.segments(spark, d).where(F.trim("text") != "").select("meeting_id", "idx", line.alias("line"))


def merge_turns(spark, d):
    return sequence.merge_turns(src.segments(spark, d), 2000)


def speaker_fill(spark, d):
    return sequence.fill_speakers(src.segments(spark, d)).select("meeting_id", "idx", "raw_speaker", "speaker")


def speaker_stats(spark, d):
    s = src.segments(spark, d)
    stats = s.groupBy("meeting_id", "speaker").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"))
    return stats.join(sequence.first_seen(s), ["meeting_id", "speaker"])


def speaker_documents(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    rows = src.segments(spark, d).where("speaker <> 'unknown'").groupBy("meeting_id", "speaker").agg(F.sum(F.length("text")).alias("chars"), F.min("idx").alias("first_idx"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return rows.where("chars >= 80")


def top2_evidence(spark, d):
    rank = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy(F.desc(F.length("text")), "idx"))
    return src.segments(spark, d).withColumn("place", rank).where("place <= 2").select("meeting_id", "speaker", "place", "segment_id")


def _refs(spark, d) -> DataFrame:
    s = src.segments(spark, d)

    def seg(n):
        return F.concat(F.lit("seg-"), F.lpad(n.cast("string"), 6, "0"))

    i = F.col("idx")
    return s.select("meeting_id", F.col("idx").alias("owner"), F.array(seg(i), seg(i + 2), seg(i), F.lit("seg-999999")).alias("refs"))


def ref_repairs(spark, d):
    return lineage.classify_refs(_refs(spark, d), src.segments(spark, d))


def evidence_table(spark, d):
    return lineage.evidence(_refs(spark, d), src.segments(spark, d))


def first_claim(spark, d):
    return lineage.first_claims(_refs(spark, d))


def evidence_tolerance(spark, d):
    s = src.segments(spark, d)
    claims = s.select("meeting_id", "idx", F.lit("speaker_0").alias("speaker"), (F.col("end_ms") + 200).alias("start_ms"), (F.col("end_ms") + 400).alias("end_ms"))
    return lineage.near_in_time(claims, s, 250)


def _chapters(spark, d) -> DataFrame:
    return src.segments(spark, d).where("idx % 3 = 1").select("meeting_id", F.floor(F.col("idx") / 3).alias("idx"), F.col("idx").alias("start_idx"))


def contiguous_ranges(spark, d):
    ends = src.segments(spark, d).groupBy("meeting_id").agg(F.max("idx").alias("last_idx"))
    return sequence.contiguous_ranges(_chapters(spark, d), ends)


def chapter_assign(spark, d):
    return sequence.in_ranges(src.segments(spark, d), contiguous_ranges(spark, d)).select("meeting_id", "segment_id", "chapter")


def job_join(spark, d):
    last = sequence.latest(src.results(spark, d, False), ["job_id"], "line", "status", "text_chars")
    return src.jobs(spark, d).join(last, "job_id", "left").select("job_id", "audio", F.coalesce("status", F.lit("missing_result")).alias("status"), "text_chars")


def latest_record(spark, d):
    return sequence.latest(src.results(spark, d), ["job_id"], "line", "status", "text_chars").where("status = 'success'")


def identity_diff(spark, d):
    a, b = src.jobs(spark, d).select("job_id"), src.results(spark, d, False).select("job_id")
    return a.subtract(b).withColumn("side", F.lit("missing")).union(b.subtract(a).withColumn("side", F.lit("extra")))


def library_list(spark, d):
    return lib.search(src.library(spark, d), " EN ", "processing", "title_asc").select("meeting_id", "title", "state", "updated_at")


def library_facets(spark, d):
    return lib.facets(src.library(spark, d))


def library_page(spark, d):
    return lib.page(src.library(spark, d), [F.desc_nulls_last("size"), F.asc("meeting_id")], 2, 50).select("meeting_id", "state", "size", "total", "has_more")


def storage_categories(spark, d):
    rows = src.stored_files(spark, d).groupBy(lib.file_category(F.col("path")).alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rows.withColumn("status", lib.storage_status(F.lit(20_000_000) - F.col("bytes"), 19_900_000, 19_500_000))


def transcript_search(spark, d):
    found = F.contains(F.lower("text"), F.lit("the")) | F.contains(F.lower("speaker"), F.lit("the"))
    return src.segments(spark, d).where(found).select("meeting_id", "segment_id", F.instr(F.lower("text"), "the").alias("at"))


def draft_overlay(spark, d):
    s = src.segments(spark, d)
    edits = s.where("(meeting_id + idx) % 4 = 0").select("meeting_id", "segment_id", F.concat(F.lit("* "), F.col("text")).alias("new_text"))
    return lib.overlay(s, edits).select("meeting_id", "segment_id", "edited", F.length("text").cast("long").alias("chars"))


def _points(spark, d) -> DataFrame:
    return src.segments(spark, d).select("meeting_id", (F.col("start_ms") + F.col("idx") * 1000 - 1500).alias("at_ms"), F.col("idx").alias("point"))


def asof_active(spark, d):
    return lib.as_of(_points(spark, d), src.segments(spark, d))


def asof_next(spark, d):
    return lib.as_of(_points(spark, d), src.segments(spark, d), forward=True)


def _edited(spark, d) -> DataFrame:
    """Whole texts of the benchmark and of the next item."""
    b = src.table(spark, d, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return b.select("item_id", F.col("text").alias("a")).join(after, "item_id")


def bigram_jaccard(spark, d):
    return _edited(spark, d).select("item_id", F.round(text.jaccard(F.array_distinct(text.grams(F.col("a"))), F.array_distinct(text.grams(F.col("b")))), 6).alias("similarity"))


def bigram_cosine(spark, d):
    b = _edited(spark, d)
    one = b.select("item_id", F.explode(text.grams(F.col("a"))).alias("g"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = b.select("item_id", F.explode(text.grams(F.col("b"))).alias("g"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    n = one.union(two).groupBy("item_id", "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    dot, norm = F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return n.groupBy("item_id").agg(F.round(F.when(norm > 0, dot / norm).otherwise(F.lit(0.0)), 6).alias("similarity"))


def cohesion_curve(spark, d):
    return topics.cohesion(src.segments(spark, d)).select("meeting_id", "idx", F.round("cohesion", 6).alias("cohesion"))


def topic_boundaries(spark, d):
    rows = topics.boundaries(src.segments(spark, d))
    return rows.select("meeting_id", "idx", F.round("depth", 6).alias("depth"), "score", F.array_join("reasons", ",").alias("reasons"))


def topic_blocks(spark, d):
    return topics.blocks(topics.placed(src.segments(spark, d)))


def topic_blocks_capped(spark, d):
    return topics.blocks(topics.split_large(topics.placed(src.segments(spark, d)), 300))


def boundary_reasons(spark, d):
    return topics.reason_counts(topic_blocks(spark, d))


def char_error_rate(spark, d):
    return _edited(spark, d).select("item_id", F.round(text.char_error_rate(F.col("b"), F.col("a"), None), 6).alias("cer"))


def token_error_rate(spark, d):
    return _edited(spark, d).select("item_id", F.round(text.token_error_rate(F.col("b"), F.col("a")), 6).alias("ter"))


def token_estimate(spark, d):
    docs = src.table(spark, d, "documents")
    return docs.select("doc_id", scalars.token_estimate(F.coalesce("text", F.lit("")), 1.25, 3).alias("tokens"))


def content_hash(spark, d):
    return src.segments(spark, d).select("meeting_id", "idx", text.content_hash("segment_id", "start_ms", "speaker").alias("sha256"))


def tumbling_context(spark, d):
    core, margin = 60_000, 15_000
    s = src.segments(spark, d).withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    # the last window is that of the meeting's end
    s = s.withColumn("last", F.greatest(F.ceil(F.max("end_ms").over(Window.partitionBy("meeting_id")) / core) - 1, F.lit(0)))
    first, last = F.greatest(F.floor((F.col("mid") - margin) / core), F.lit(0)), F.least(F.floor((F.col("mid") + margin) / core), F.col("last"))
    rows = s.withColumn("win", F.explode(F.sequence(F.least(first, last), last)))
    return rows.select("meeting_id", "win", "segment_id", (F.least(F.floor(F.col("mid") / core), F.col("last")) == F.col("win")).alias("is_core"))


def _samples(spark, d) -> DataFrame:
    return src.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("phase"), F.col("ts").alias("t"), F.col("event_id").alias("id"), "value")


def memory_peaks(spark, d):
    return metrics.memory_peaks(_samples(spark, d))


def leak_test(spark, d):
    idle = src.table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("t"), F.col("event_id").alias("id"), (F.col("value") * 1024).alias("available"), (F.col("event_id") % 97 * 100).cast("double").alias("cached"),
        (F.col("event_id") % 89 * 500).cast("double").alias("rss"), (F.col("value") * 300).alias("cma"),
    )
    return metrics.leak_test(idle, 10.0)


def run_flags(spark, d):
    r = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        F.count("*").alias("blocks"), F.sum("l_partkey").alias("p"), F.sum("l_suppkey").alias("s"), F.max("l_linenumber").alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("retries"),
    )
    return metrics.run_flags(r.select(
        "run", "blocks", (F.col("p") % 300).alias("block_chars"), (F.col("s") % 900).alias("overview_chars"), F.when(F.col("p") % 4 == 0, "chapter_summaries").otherwise("timeline").alias("overview_source"), (F.col("s") % 6).alias("chapters"),
        (F.col("p") % 5).alias("by_speaker"), (F.col("p") % 2).alias("thinking_block"), (F.col("p") % 3).alias("thinking_full"), (F.col("s") % 2).alias("thinking_speaker"), "retries", F.col("m").alias("requests"),
        (F.col("s") % 20 / 10).alias("chars_per_token"), F.lit(1.3).alias("configured"), (F.col("p") % 7 - 3).alias("empty_fields"),
    ))


def chunk_plan(spark, d):
    return packing.chunk_plan(src.segments(spark, d), 2000, 1)


def budget_prefix(spark, d):
    return packing.prefix_in_budget(src.segments(spark, d), 2000).select("meeting_id", "idx", "used")


def bin_packing(spark, d):
    s = src.segments(spark, d)
    return packing.best_fit(s.select("meeting_id", F.col("segment_id").alias("item"), F.col("idx").alias("first"), F.length("text").cast("long").alias("cost")), 1500)


def reduce_tree(spark, d):
    windows = src.segments(spark, d).select("meeting_id", F.col("idx").alias("window"), "text")
    mapped = mapreduce.map_windows(windows, lambda t: F.sha2(t.cast("binary"), 256))
    return mapreduce.reduce_tree(mapped, lambda parts: F.sha2(F.array_join(parts, "|"), 256), 2)


def stream_counts(spark, d):
    from pyspark.sql.functions import unix_timestamp

    base = new_folder(spark, "stream")
    out = streams.run_to_table(streams.tumbling_counts(streams.read_stream(spark, f"{d}/events.parquet"), "1 day", "3650 days"), f"{base}/out", f"{base}/checkpoint")
    return out.select(unix_timestamp("window_start").alias("window_s"), "event_type", "n", "total")


QUERIES = [
    interval_islands, merge_same_label, coverage_gaps, pad_and_split, overlap_matrix, interval_coverage, duration_stats, overlapping_groups, canonical_transcript, transcript_stats,
    timeline_text, merge_turns, speaker_fill, speaker_stats, speaker_documents, top2_evidence, ref_repairs, evidence_table, first_claim, evidence_tolerance, contiguous_ranges, chapter_assign,
    job_join, latest_record, identity_diff, library_list, library_facets, library_page, storage_categories, transcript_search, draft_overlay, asof_active, asof_next, bigram_jaccard, bigram_cosine,
    cohesion_curve, topic_boundaries, topic_blocks, topic_blocks_capped, boundary_reasons, char_error_rate, token_error_rate, token_estimate, content_hash, tumbling_context, memory_peaks, leak_test,
    run_flags, chunk_plan, budget_prefix, bin_packing, reduce_tree, stream_counts,
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_islands(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | deep.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | deep.SQL
