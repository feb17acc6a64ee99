"""Checks and repairs of model output against segments, turns and sources.

Documents are flat fact tables, one row an item; violations and repairs are tables (check or repair, where, detail), so
nothing is gathered and one broken item doesn't stop the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import clean_text

# Kinds of meetings, and the word that must be given as null.
MEETING_TYPES = ("discussion", "decision", "planning", "review", "training", "other")
UNCLEAR = "未明确"
# The states of a recognised segment.
STATUSES = ("ok", "transcript_empty")
ITEM = ["meeting_id", "field", "pos"]


def _why(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules]))


def check_segments(rows: DataFrame) -> DataFrame:
    """(meeting_id, idx, check) of recognised segments: negative or repeated numbers, empty ranges, unknown states."""
    again = F.count("*").over(Window.partitionBy("meeting_id", "idx")) > 1
    why = _why(("negative_index", F.col("idx") < 0), ("duplicate_index", again), ("end_before_start", F.col("end_ms") <= F.col("start_ms")), ("failed_status", ~F.coalesce(F.col("status"), F.lit("unknown")).isin(*STATUSES)))
    return rows.withColumn("_why", why).select("meeting_id", "idx", F.explode("_why").alias("check"))


def check_turns(rows: DataFrame) -> DataFrame:
    """(meeting_id, idx, check) of turns (meeting_id, idx, id, start_ms, end_ms, speaker, text, chunk_ids) in order of arrival."""
    again = F.row_number().over(Window.partitionBy("meeting_id", "id").orderBy("idx")) > 1
    blank = lambda c: F.coalesce(F.btrim(c) == "", F.lit(True))
    why = _why(
        ("id_not_positive", F.coalesce(F.col("id") < 1, F.lit(True))), ("duplicate_id", again), ("range_missing", F.col("start_ms").isNull() | F.col("end_ms").isNull()),
        ("invalid_range", (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms"))), ("blank_speaker", blank("speaker")), ("blank_text", blank("text")),
        ("bad_chunk_ids", F.coalesce(F.exists("chunk_ids", lambda x: F.coalesce(x < 1, F.lit(True))), F.lit(True))),
    )
    return rows.withColumn("_why", why).select("meeting_id", "idx", F.explode("_why").alias("check"))


def cited(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Each place of the facts' refs (meeting_id, field, pos, at, ref) with the segment it names and a verdict: ok, missing, empty_text or duplicate."""
    flat = facts.select(*ITEM, F.posexplode("refs").alias("at", "ref"))
    known = segments.select("meeting_id", F.col("segment_id").alias("ref"), F.col("idx").alias("seg_idx"), F.col("speaker").alias("seg_speaker"), F.col("text").alias("seg_text"), F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    again = F.row_number().over(Window.partitionBy(*ITEM, "ref").orderBy("at")) > 1
    verdict = F.when(F.col("seg_text").isNull(), "missing").when(F.col("seg_text") == "", "empty_text").when(again, "duplicate").otherwise("ok")
    return flat.join(known, ["meeting_id", "ref"], "left").withColumn("verdict", verdict)


def repair_summary(facts: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts that hold, repairs) of a summary's facts (meeting_id, field, pos, text, overview, refs, speaker, owner, deadline, start_ref, end_ref).

    Refs are checked; a speaker's refs are those to his own segments; items without a text or a ref go, as do chapters without an
    overview or with an impossible range; an owner must have spoken in a cited segment and a deadline must stand in a cited text, or
    else is cleared; of equal items of a field the first stays. Repairs are (meeting_id, field, pos, repair, n).
    """
    refs = cited(facts, segments)
    ok = F.col("verdict") == "ok"
    told = refs.groupBy(*ITEM).agg(
        F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("at", "ref", "seg_speaker", "seg_text", "seg_start", "seg_end")))), lambda x: x).alias("c"),
        F.count_if(F.col("verdict") == "missing").alias("n_missing"), F.count_if(F.col("verdict") == "empty_text").alias("n_empty"),
    )
    rows = facts.join(told, ITEM, "left").withColumn("c", F.coalesce("c", F.array().cast(told.schema["c"].dataType)))
    rows = rows.withColumns({"text": clean_text(F.col("text")), "overview": clean_text(F.col("overview")), "owner": clean_text(F.col("owner")), "deadline": clean_text(F.col("deadline"))})
    speaker, chapter, action = F.col("field") == "speakers", F.col("field") == "chapters", F.col("field") == "action_items"
    rows = rows.withColumn("own", F.when(speaker, F.filter("c", lambda x: x["seg_speaker"] == F.col("speaker"))).otherwise(F.col("c")))
    ends = segments.select("meeting_id", F.col("segment_id"), F.col("start_ms").alias("ms"), F.col("end_ms").alias("to_ms"))
    rows = rows.withColumns({"start_ref": F.when(chapter, F.coalesce("start_ref", F.try_element_at("own.ref", F.lit(1)))), "end_ref": F.when(chapter, F.coalesce("end_ref", F.try_element_at("own.ref", F.lit(-1))))})
    rows = rows.join(ends.withColumnsRenamed({"segment_id": "start_ref", "ms": "first_ms", "to_ms": "_a"}), ["meeting_id", "start_ref"], "left").join(ends.withColumnsRenamed({"segment_id": "end_ref", "ms": "last_ms", "to_ms": "last_end"}), ["meeting_id", "end_ref"], "left")
    unsupported = F.col("text").isNull() | (F.size("own") == 0) | (chapter & F.col("overview").isNull())
    bad_range = ~unsupported & chapter & F.coalesce(F.col("first_ms") > F.col("last_ms"), F.lit(True))
    spoke = F.exists("own", lambda x: x["seg_speaker"] == F.col("owner"))
    heard = F.contains(F.array_join(F.transform("own", lambda x: x["seg_text"]), " "), F.col("deadline"))
    kept = action & ~unsupported
    bad_owner, bad_deadline = kept & F.col("owner").isNotNull() & ~spoke, kept & F.col("deadline").isNotNull() & ~heard
    rows = rows.withColumns({
        "unsupported": unsupported, "bad_range": bad_range, "bad_owner": F.coalesce(bad_owner, F.lit(False)), "bad_deadline": F.coalesce(bad_deadline, F.lit(False)), "crossed": speaker & (F.size("own") != F.size("c")),
    }).withColumns({"owner": F.when(action & ~F.col("bad_owner"), F.col("owner")), "deadline": F.when(action & ~F.col("bad_deadline"), F.col("deadline")), "refs": F.transform("own", lambda x: x["ref"])})
    whole = F.sha2(F.to_json(F.struct("text", "overview", "speaker", "owner", "deadline", "start_ref", "end_ref", "refs")), 256)
    held = F.col("unsupported") | F.col("bad_range")
    rows = rows.withColumn("_again", ~held & (F.row_number().over(Window.partitionBy("meeting_id", "field", held, whole).orderBy("pos")) > 1))
    lists = F.array(
        *[F.struct(F.lit(name).alias("repair"), n.cast("long").alias("n")) for name, n in (
            ("drop_empty_text_ref", F.coalesce("n_empty", F.lit(0))), ("drop_invalid_refs", F.coalesce("n_missing", F.lit(0))), ("drop_cross_speaker_refs", F.col("crossed")), ("drop_unsupported_item", F.col("unsupported")),
            ("drop_invalid_chapter_range", F.col("bad_range")), ("clear_unsupported_owner", F.col("bad_owner")), ("clear_unsupported_deadline", F.col("bad_deadline")), ("drop_duplicate", F.col("_again")),
        )]
    )
    repairs = rows.select(*ITEM, F.explode(F.filter(lists, lambda x: x["n"] > 0)).alias("r")).select(*ITEM, "r.repair", "r.n")
    speakers = F.array_join(F.array_sort(F.array_distinct(F.transform("own", lambda x: x["seg_speaker"]))), ",")
    good = rows.where(~held & ~F.col("_again")).select(*ITEM, "text", "owner", "deadline", F.array_join("refs", ",").alias("refs"), speakers.alias("speakers"), F.when(chapter, F.col("first_ms")).alias("start_ms"), F.when(chapter, F.col("last_end")).alias("end_ms"))
    return good, repairs


def check_evidence(evidence: DataFrame, turns: DataFrame, tolerance: int, bucket: int = 60_000) -> DataFrame:
    """(meeting_id, field, pos, at, check) of evidence (.., speaker, start_ms, end_ms): missing values, impossible ranges, and those that no turn of the speaker meets."""
    keys = ["meeting_id", "speaker"]
    bad = evidence.withColumn("check", F.when(F.coalesce(F.col("speaker"), F.lit("")) == "", "speaker_missing").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "range_missing").when((F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")), "invalid_range"))
    # both sides touch within the tolerance: time buckets make it an equi join
    first, last = F.floor((F.col("start_ms") - tolerance) / bucket), F.floor((F.col("end_ms") + tolerance) / bucket)
    here = turns.select(*keys, F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    open_ = bad.where("check is null")
    met = open_.withColumn("_b", F.explode(F.sequence(first, last))).join(here, [*keys, "_b"]).where((F.col("end_ms") + tolerance >= F.col("t0")) & (F.col("start_ms") - tolerance <= F.col("t1"))).select(*ITEM, "at").distinct()
    unmet = open_.join(met, [*ITEM, "at"], "left_anti").withColumn("check", F.lit("no_such_turn"))
    return bad.where("check is not null").unionByName(unmet).select(*ITEM, "at", "check")


def check_items(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(meeting_id, field, pos, check) of a map output's items (.., text, owner, due, turn_ids): empty texts, owners given as unclear, no turns, turns that aren't in the window."""
    known = turns.select("meeting_id", "turn_id").distinct().withColumn("_known", F.lit(True))
    flat = facts.select(*ITEM, F.explode("turn_ids").alias("turn_id")).join(known, ["meeting_id", "turn_id"], "left")
    missing = flat.where("_known is null").select(*ITEM, F.lit("unknown_turn").alias("check"))
    why = _why(
        ("empty_text", F.coalesce(F.col("text"), F.lit("")) == ""), ("owner_must_be_null", F.col("owner") == UNCLEAR), ("due_must_be_null", F.col("due") == UNCLEAR), ("no_turn_ids", F.coalesce(F.size("turn_ids"), F.lit(0)) < 1),
    )
    return facts.select(*ITEM, F.explode(why).alias("check")).union(missing)


def materialize_evidence(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(meeting_id, field, pos, n, speakers, start_ms, end_ms): evidence of items by the turns they name, equal ones once."""
    known = turns.select("meeting_id", "turn_id", "speaker", "start_ms", "end_ms")
    flat = facts.select(*ITEM, F.explode("turn_ids").alias("turn_id")).join(known, ["meeting_id", "turn_id"])
    one = flat.select(*ITEM, "speaker", "start_ms", "end_ms").distinct()
    return one.groupBy(*ITEM).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def check_minutes(minutes: DataFrame) -> DataFrame:
    """(meeting_id, check) of minutes (meeting_id, schema_version, title, kind, summary, fields)."""
    why = _why(
        ("schema_version", F.coalesce(F.col("schema_version"), F.lit("")) != "meeting_minutes_v0"), ("title_missing", F.col("title").isNull()), ("summary_missing", F.col("summary").isNull()),
        ("meeting_type", ~F.coalesce(F.col("kind"), F.lit("")).isin(*MEETING_TYPES)),
    )
    expected = F.array(*[F.lit(x) for x in ("schema_version", "meeting_title", "meeting_type", "executive_summary", "participants", "topics", "decisions", "action_items", "risks", "open_questions", "warnings")])
    keys = F.concat(F.transform(F.array_except(expected, "fields"), lambda x: F.concat(F.lit("missing_key:"), x)), F.transform(F.array_except("fields", expected), lambda x: F.concat(F.lit("extra_key:"), x)))
    return minutes.select("meeting_id", F.explode(F.concat(why, keys)).alias("check"))


def check_windows(outputs: DataFrame, windows: DataFrame, slack: int) -> DataFrame:
    """(meeting_id, win, check) of map outputs (meeting_id, win, said_win, start_ms, end_ms) against their windows."""
    rows = outputs.join(windows.select("meeting_id", "win", F.col("start_ms").alias("w0"), F.col("end_ms").alias("w1")), ["meeting_id", "win"])
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms"))
    why = _why(("window_id", F.col("said_win") != F.col("win")), ("invalid_range", bad), ("outside_window", ~bad & ((F.col("end_ms") < F.col("w0") - slack) | (F.col("start_ms") > F.col("w1") + slack))))
    return rows.select("meeting_id", "win", F.explode(why).alias("check"))


def check_chapters(chapters: DataFrame, turns: DataFrame) -> DataFrame:
    """(meeting_id, no, check) of chapters (meeting_id, no, title, turn_ids, start_ms, end_ms): titles, turns that are known, unique, in source order and used once, times of their turns, time order."""
    known = turns.select("meeting_id", "turn_id", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "end_ms", "turn_id")).alias("rank"))
    flat = chapters.select("meeting_id", "no", F.posexplode("turn_ids").alias("at", "turn_id")).join(known, ["meeting_id", "turn_id"], "left")
    order = Window.partitionBy("meeting_id", "no").orderBy("at")
    flat = flat.withColumns({"_back": F.coalesce(F.col("rank") <= F.lag("rank").over(order), F.lit(False)), "_first": F.min("no").over(Window.partitionBy("meeting_id", "turn_id"))})
    told = flat.groupBy("meeting_id", "no").agg(F.count_if(F.col("rank").isNull()).alias("unknown"), F.bool_or("_back").alias("back"), F.bool_or(F.col("rank").isNotNull() & (F.col("_first") < F.col("no"))).alias("reused"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    by = Window.partitionBy("meeting_id").orderBy("no")
    rows = chapters.join(told, ["meeting_id", "no"], "left").withColumn("_before", F.lag(F.struct("start_ms", "end_ms")).over(by))
    why = _why(
        ("empty_title", F.coalesce(F.btrim("title"), F.lit("")) == ""), ("no_turn_ids", F.coalesce(F.size("turn_ids"), F.lit(0)) < 1), ("unknown_turn", F.col("unknown") > 0), ("turn_order", F.col("back")), ("reused_turn", F.col("reused")),
        ("times_of_turns", (F.col("start_ms") != F.col("t0")) | (F.col("end_ms") != F.col("t1"))), ("not_chronological", F.struct("start_ms", "end_ms") < F.col("_before")),
    )
    return rows.select("meeting_id", "no", F.explode(why).alias("check"))


def check_reduce(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """(meeting_id, no, check, source_id) of a reduction's chapters (meeting_id, no, source_ids) over sources (meeting_id, source_id, rank).

    Every source is used exactly once, and each chapter's sources are neighbours. Sources that no chapter uses have no chapter number.
    """
    flat = chapters.select("meeting_id", "no", F.posexplode("source_ids").alias("at", "source_id")).join(sources, ["meeting_id", "source_id"], "left")
    seen = F.row_number().over(Window.partitionBy("meeting_id", "no", "source_id").orderBy("at")) > 1
    flat = flat.withColumn("_again", seen).withColumn("_first", F.min("no").over(Window.partitionBy("meeting_id", "source_id")))
    check = F.when(F.col("_again"), "duplicate_source").when(F.col("rank").isNull(), "unknown_source").when(F.col("_first") < F.col("no"), "reused_source")
    items = flat.withColumn("check", check).where("check is not null").select("meeting_id", "no", "check", "source_id")
    spread = flat.where("rank is not null").groupBy("meeting_id", "no").agg((F.max("rank") - F.min("rank") + 1 != F.count_distinct("rank")).alias("gap")).where("gap")
    empty = chapters.where(F.coalesce(F.size("source_ids"), F.lit(0)) < 1)
    used = flat.select("meeting_id", "source_id").distinct()
    missing = sources.join(used, ["meeting_id", "source_id"], "left_anti").select("meeting_id", F.lit(None).cast("long").alias("no"), F.lit("missing_source").alias("check"), "source_id")
    none = F.lit(None).cast("string").alias("source_id")
    return items.union(spread.select("meeting_id", "no", F.lit("not_contiguous").alias("check"), none)).union(empty.select("meeting_id", "no", F.lit("no_source_ids").alias("check"), none)).union(missing)


def reduce_sources(items: DataFrame) -> DataFrame:
    """Items (meeting_id, value, field, pos, ..) of the values of a reduction with their ``source_id`` v{value}-{field}-{pos}, all counted from 1."""
    return items.withColumn("source_id", F.concat(F.lit("v"), F.col("value").cast("string"), F.lit("-"), F.col("field"), F.lit("-"), F.col("pos").cast("string")))


def reduce_evidence(outputs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence of a reduction's items, errors): the turns of the sources that an item names, each once in order of first mention.

    A source that is unknown or stands in another field is an error, as is an item that comes to no evidence.
    """
    flat = outputs.select(*ITEM, F.posexplode("source_ids").alias("at", "source_id"))
    flat = flat.join(sources.select("meeting_id", "source_id", F.col("field").alias("src_field"), F.col("turn_ids").alias("src_turns")), ["meeting_id", "source_id"], "left")
    bad = F.when(F.col("src_field").isNull(), "unknown_source").when(F.col("src_field") != F.col("field"), "wrong_field")
    flat = flat.withColumn("check", bad)
    turns = F.transform(F.array_sort(F.collect_list(F.when(F.col("check").isNull(), F.struct("at", "src_turns")))), lambda x: x["src_turns"])
    good = flat.groupBy(*ITEM).agg(F.array_distinct(F.flatten(turns)).alias("turn_ids"))
    errors = flat.where("check is not null").select(*ITEM, "check", "source_id")
    none = good.where(F.size("turn_ids") < 1).select(*ITEM, F.lit("no_evidence").alias("check"), F.lit(None).cast("string").alias("source_id"))
    return good.where(F.size("turn_ids") > 0), errors.union(none)


def is_failed_placeholder(n_facts: Column, warnings: Column) -> Column:
    """Whether a map output stands for a window that failed."""
    return (n_facts == 0) & F.exists(warnings, lambda w: w.startswith("MAP window ") & F.contains(w, F.lit(" failed ")))
