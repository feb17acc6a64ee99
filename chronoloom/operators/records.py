"""Records of a library as nested documents: made for what is asked, decoded again, projected to fields that may be told, and folders of requests that are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.documents import kind_of, nodes, whole_json

# Kinds of sources and how they are shown, the language where none is told, parts of a result, things that can be done, files of a record.
SOURCES = {"local_upload": "本地音频", "pc_record": "PC 录音", "board_record": "板端录音"}
LANGUAGE = "zh-CN"
PARTS = ("transcript", "speakers", "minutes", "chapters", "decisions", "action_items", "evidence", "formal_version")
ACTIONS = {"can_cancel": True, "can_retry_all": False, "can_retry_summary": False, "can_edit": False, "can_save_draft": False, "can_finalize": False, "can_play_audio": False, "can_delete_audio": False, "can_reveal_files": True, "can_remove_index": True}
FILES = ("source_audio", "result", "draft", "formal_html", "formal_txt", "formal_json")
#: Seconds that a new record is expected to take.
EXPECTED = 300


def _new(now: Column) -> Column:
    """The nested record of a row asked for."""
    lit, null = F.lit, F.lit(None)
    dot = F.regexp_extract("file_name", r"[^./\\]\.([^./\\]*)$", 1)
    extension = F.nullif(F.lower(dot), lit(""))
    seconds = F.struct(lit(0).alias("percent"), lit(True).alias("estimated"), lit(0).alias("elapsed_seconds"), lit(EXPECTED).alias("estimated_total_seconds"), lit(EXPECTED).alias("estimated_remaining_seconds"))
    review = F.struct(lit(0).alias("pending_count"), lit(0).alias("reviewed_count"), lit(False).alias("dirty"), lit(0).alias("draft_revision"))
    audio = F.struct(lit("pending").alias("state"), null.cast("long").alias("duration_ms"), F.col("size_bytes"), lit(False).alias("playable"), null.cast("string").alias("deleted_at"))
    source = F.struct(F.col("source_type").alias("type"), F.col("file_name").alias("original_name"), extension.alias("original_extension"), F.col("mime_type"), F.col("size_bytes"), null.cast("string").alias("sha256"), F.coalesce(extension != "wav", lit(False)).alias("requires_conversion"))
    label = F.create_map(*[lit(x) for pair in SOURCES.items() for x in pair])[F.col("source_type")]
    detail = F.struct(
        F.col("meeting_id"), F.col("title"), F.col("source_type"), label.alias("source_label"), lit("created").alias("state"), lit("awaiting_source").alias("phase"), seconds.alias("progress"), F.struct(*[lit(False).alias(p) for p in PARTS]).alias("availability"), review.alias("review"),
        audio.alias("audio"), now.alias("meeting_date"), now.alias("created_at"), now.alias("updated_at"), F.coalesce(F.nullif("language", lit("")), lit(LANGUAGE)).alias("language"), source.alias("source"), lit("awaiting_audio").alias("raw_stage"), lit(1).alias("seq"),
        F.struct(*[lit(v).alias(k) for k, v in ACTIONS.items()]).alias("capabilities"), F.struct(lit("available").alias("metadata"), *[lit("not_created").alias(f) for f in FILES]).alias("file_health"), null.cast("string").alias("error"),
    )
    return F.to_json(F.struct(detail.alias("detail"), F.concat(lit("meetings/"), F.col("meeting_id").cast("string")).alias("directory"), *[null.cast("string").alias(c) for c in ("board_task_id", "board_task_kind", "board_task")]), {"ignoreNullFields": "false"})


def create_records(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(meeting_id, place, outcome, json): what becomes of each row asked (meeting_id, place, title, source_type, language, file_name, mime_type, size_bytes, now).

    outcome: unsupported_source, exists (the id is in ``known`` or an earlier good row asked for it, by ``place``, which is unique for an id) or created, with the new record. A file without a name or ending counts as one that needs no conversion.
    """
    good = F.coalesce(F.col("source_type").isin(*SOURCES), F.lit(False))
    first = asked.where(good).groupBy("meeting_id").agg(F.min("place").alias("first"))
    rows = asked.join(known.select("meeting_id", F.lit(True).alias("known")).distinct(), "meeting_id", "left").join(first, "meeting_id", "left")
    outcome = F.when(~good, "unsupported_source").when(F.col("known").isNotNull() | (F.col("place") != F.col("first")), "exists").otherwise("created")
    return rows.withColumn("outcome", outcome).select("meeting_id", "place", "outcome", F.when(F.col("outcome") == "created", _new(F.col("now"))).alias("json"))


def decode_records(rows: DataFrame) -> DataFrame:
    """(meeting_id, fault, title, state, updated_at) of stored records (meeting_id, json); fault: not_json, or wrong_shape for what is no object with an object ``detail``."""
    v = F.col("value")
    detail = F.try_variant_get(v, "$.detail", "variant")
    shaped = (kind_of(v) == "object") & detail.isNotNull() & (kind_of(detail) == "object")
    fault = F.when(v.isNull(), "not_json").when(~F.coalesce(shaped, F.lit(False)), "wrong_shape")
    return rows.select("meeting_id", whole_json(F.col("json")).alias("value")).select("meeting_id", fault.alias("fault"), *[F.when(fault.isNull(), F.try_variant_get(v, f"$.detail.{c}", "string")).alias(c) for c in ("title", "state", "updated_at")])


def allowed_fields(docs: DataFrame, allowed: tuple[str, ...], chars: int = 600) -> DataFrame:
    """(doc, path, kind, value): the scalars of documents (doc, json) whose patterns (``$.error.code``, ``$.errors[].code``) are allowed, texts cut to a length; all else is left out."""
    depth = max(len(p.replace("[]", ".[]").split(".")) - 1 for p in allowed)
    found, _ = nodes(docs, depth)
    text = F.expr("try_variant_get(value, '$', 'string')")
    return found.where(F.col("pattern").isin(*allowed) & ~F.col("kind").isin("object", "array")).select("doc", "path", "kind", F.substring(text, 1, chars).alias("value"))


def complete_requests(files: DataFrame) -> DataFrame:
    """(folder): folders of files (path) that hold both a request's status and its final text."""
    rows = files.select(F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return rows.where("name = 'status.json'").select("folder").distinct().join(rows.where("name = 'final_json.txt'").select("folder"), "folder", "left_semi")
