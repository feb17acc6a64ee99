"""Drafts that people edit: made of results, loaded beside saved ones, checked, and the exports that follow them.

Results come as flat tables, one row an item; a draft is a nested document put together at the end, so only one draft's items are gathered at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.documents import kind_of, whole_json

# States of a review, the kinds of items that carry marks in the order in which they are marked, formats and files of exports, and what a draft must hold.
REVIEW = ("pending", "reviewed", "edited")
MARKED = ("decisions", "action_items", "outline")
FORMATS = {"html": "formal_minutes.html", "txt": "formal_minutes.txt", "json": "formal_result.json"}
CONTENT = {"title": "string", "speaker_names": "object", "transcript_edits": "array", "chapters": "array", "decisions": "array", "action_items": "array", "review_marks": "object"}


def _status(finalized: Column) -> Column:
    told = F.when(F.col("review_status").isin(*REVIEW), F.col("review_status")).otherwise("pending")
    return F.when(finalized, "reviewed").otherwise(told)


def review_marks(items: DataFrame) -> DataFrame:
    """(meeting_id, item_id, mark) of items (meeting_id, kind, pos, item_id, review_status, finalized); of those with one id the last counts: by kind, then by place."""
    order = F.array_position(F.array(*map(F.lit, MARKED)), F.col("kind"))
    rows = items.where(F.col("kind").isin(*MARKED) & F.col("item_id").isNotNull())
    return rows.groupBy("meeting_id", "item_id").agg(F.max_by(_status(F.coalesce("finalized", F.lit(False))), F.struct(order, "pos")).alias("mark"))


def speaker_names(speakers: DataFrame) -> DataFrame:
    """(meeting_id, speaker_id, name) of speakers (meeting_id, pos, speaker_id, display_name); of those with one id the last counts, a blank name is the id."""
    name = F.coalesce(F.nullif(F.btrim("display_name"), F.lit("")), F.col("speaker_id"))
    return speakers.where("speaker_id is not null").groupBy("meeting_id", "speaker_id").agg(F.max_by(name, "pos").alias("name"))


def _map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def contents(meetings: DataFrame, items: DataFrame, speakers: DataFrame, overviews: DataFrame) -> DataFrame:
    """(meeting_id, json): the content of a new draft of each meeting (meeting_id, title, finalized).

    items: (meeting_id, kind: decisions, action_items, chapters or outline, pos, item_id, text, review_status); overviews (meeting_id, overview) are there for meetings with minutes.
    """
    rows = items.join(meetings.select("meeting_id", "finalized"), "meeting_id")
    item = F.struct("item_id", "text", _status(F.col("finalized")).alias("review_status"))
    listed = rows.groupBy("meeting_id").pivot("kind", ["decisions", "action_items", "chapters", "outline"]).agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("v")))))
    out = meetings.join(listed, "meeting_id", "left").join(overviews, "meeting_id", "left")
    out = out.join(_map(speaker_names(speakers), "speaker_id", "name", "names"), "meeting_id", "left").join(_map(review_marks(rows), "item_id", "mark", "marks"), "meeting_id", "left")

    def of(kind: str) -> Column:
        return F.coalesce(F.transform(kind, lambda x: x["v"]), F.array().cast("array<struct<item_id: string, text: string, review_status: string>>"))

    def mapped(c: str) -> Column:
        return F.coalesce(c, F.create_map().cast("map<string, string>"))

    minutes = F.when(F.col("overview").isNotNull(), F.struct("overview", of("outline").alias("outline")))
    fields = [F.col("title"), mapped("names").alias("speaker_names"), F.array().cast("array<string>").alias("transcript_edits"), minutes.alias("minutes"), *[of(k).alias(k) for k in ("chapters", "decisions", "action_items")], mapped("marks").alias("review_marks")]
    return out.select("meeting_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def load_drafts(meetings: DataFrame, saved: DataFrame, results: DataFrame, fresh: DataFrame) -> DataFrame:
    """(meeting_id, origin, revision, base_result_revision, json) of every meeting.

    origin: saved (a draft of ``saved`` (meeting_id, revision, base_result_revision, json)), new (revision 0, the content of ``fresh`` over the result's revision, 1 if it tells none) or
    not_ready (neither a draft nor a result (meeting_id, result_revision); the rest is null).
    """
    old = saved.select("meeting_id", F.lit(True).alias("old"), "revision", "base_result_revision", F.col("json").alias("old_json"))
    base = results.select("meeting_id", F.lit(True).alias("made"), F.coalesce("result_revision", F.lit(1)).alias("result_revision"))
    rows = meetings.select("meeting_id").join(old, "meeting_id", "left").join(base, "meeting_id", "left").join(fresh, "meeting_id", "left")
    is_old, is_new = F.col("old").isNotNull(), F.col("made").isNotNull()

    def choose(a, b) -> Column:
        return F.when(is_old, a).when(is_new, b)

    return rows.select("meeting_id", F.coalesce(choose(F.lit("saved"), F.lit("new")), F.lit("not_ready")).alias("origin"), choose(F.col("revision"), F.lit(0)).alias("revision"), choose(F.col("base_result_revision"), F.col("result_revision")).alias("base_result_revision"), choose(F.col("old_json"), F.col("json")).alias("json"))


def draft_faults(drafts: DataFrame) -> DataFrame:
    """(meeting_id, fault): of contents (meeting_id, json), ``content`` if it is no object, else the keys that lack or are of a wrong kind; ``minutes`` may lack or be null, and other keys may be there."""
    rows = drafts.select("meeting_id", whole_json(F.col("json")).alias("value"))

    def kind(key: str) -> Column:
        return kind_of(F.try_variant_get("value", f"$.{key}", "variant"))

    wrong = [F.when(F.coalesce(kind(k) != t, F.lit(True)), k) for k, t in CONTENT.items()] + [F.when(F.try_variant_get("value", "$.minutes", "variant").isNotNull() & ~kind("minutes").isin("object", "null"), "minutes")]
    whole = F.coalesce(kind_of(F.col("value")) == "object", F.lit(False))
    return rows.select("meeting_id", F.explode(F.when(whole, F.array_compact(F.array(*wrong))).otherwise(F.array(F.lit("content")))).alias("fault"))


def export_items(meetings: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(meeting_id, format, state, file_name, size_bytes, created_at): each format of each meeting, ready if its file (meeting_id, name, size) is there, else queued."""
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(n).alias("name")) for f, n in FORMATS.items()])).alias("x")
    rows = meetings.select("meeting_id", wanted).select("meeting_id", "x.*")
    there = files.groupBy("meeting_id", "name").agg(F.max("size").alias("size_bytes"), F.lit(True).alias("there"))
    rows = rows.join(there, ["meeting_id", "name"], "left").join(manifests.select("meeting_id", "finalized_at"), "meeting_id", "left")
    ready = F.col("there").isNotNull()
    return rows.select("meeting_id", "format", F.when(ready, "ready").otherwise("queued").alias("state"), F.when(ready, F.col("name")).alias("file_name"), "size_bytes", F.when(ready, F.col("finalized_at")).alias("created_at"))
