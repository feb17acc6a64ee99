"""Units of recognition from labelled segments, and chapters from blocks: folds along a meeting, written as scans.

What joins a segment to the unit before it depends only on the last wanted main segment before it, on the fragments since, and on whether
anything else came between. All of these are last values before a row, so a meeting is never worked through by one task: the
scan splits it over range partitions and carries last values across.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoloom.functions.scalars import speaker_kind, wanted_for_asr
from chronoloom.operators.scan import running


def mark_units(segments: DataFrame, merge_gap: int = 500, bridge: int = 300, least: int = 500, least_boundary: int = 1500, least_fragment: int = 700, boundary: bool = True, fragments: bool = False, unknown: bool = False, merge: bool = True) -> DataFrame:
    """Segments (meeting_id, idx, segment_id, speaker, start_ms, end_ms) in order with ``unit``, from 1 (null: in none), and ``bridged``.

    Neighbouring wanted segments of one main speaker form a unit if at most ``merge_gap`` lies between them. Short fragments (up to ``bridge``)
    may lie between: each must begin at most ``merge_gap`` after the unit's last segment, the last one of them is part of the unit and the gap counts from its end. Anything
    else ends a unit, a segment that isn't wanted too. Wanted segments of other kinds are units of their own.
    """
    kind = speaker_kind(F.col("speaker"))
    length = F.col("end_ms") - F.col("start_ms")
    wanted = wanted_for_asr(F.col("speaker"), length, least, least_boundary, least_fragment, boundary, fragments, unknown)
    rows = segments.select("meeting_id", "idx", "segment_id", "speaker", "start_ms", "end_ms", kind.alias("kind"), wanted.alias("wanted"))
    main, fragment = F.col("wanted") & (F.col("kind") == "main"), (F.col("kind") == "fragment") & F.lit(not fragments)
    if not merge:
        rows = rows.withColumn("fresh", F.col("wanted").cast("long"))
        out = running(rows, ["meeting_id"], [F.col("idx").asc()], {"unit": "fresh"}, name="units")
        return out.select(*rows.columns, F.when(F.col("wanted"), F.col("unit")).alias("unit"), F.lit(False).alias("bridged")).drop("fresh")
    rows = rows.withColumns({"is_main": main, "is_fragment": fragment})
    # speakers are carried as 64-bit hashes
    held = rows.withColumns({"at_main": F.when(main, F.col("idx")), "main_end": F.when(main, F.col("end_ms")), "main_speaker": F.when(main, F.xxhash64("speaker"))})
    held = running(held, ["meeting_id"], [F.col("idx").asc()], lasts={"last_main": "at_main", "last_end": "main_end", "last_speaker": "main_speaker"}, name="mains").drop("at_main", "main_end", "main_speaker")
    may_bridge = F.coalesce((F.col("end_ms") - F.col("start_ms") <= bridge) & (F.col("start_ms") - F.col("last_end") <= merge_gap), F.lit(False))
    ends = ~F.col("is_main") & ~(F.col("is_fragment") & may_bridge)
    held = held.withColumns({"at_end": F.when(ends, F.col("idx")), "at_fragment": F.when(F.col("is_fragment"), F.col("idx")), "fragment_end": F.when(F.col("is_fragment"), F.col("end_ms"))})
    held = running(held, ["meeting_id"], [F.col("idx").asc()], lasts={"last_stop": "at_end", "last_fragment": "at_fragment", "last_fragment_end": "fragment_end"}, name="stops")
    since = F.coalesce(F.col("last_fragment") > F.col("last_main"), F.lit(False))
    from_ = F.when(since, F.col("last_fragment_end")).otherwise(F.col("last_end"))
    goes_on = F.col("is_main") & F.coalesce((F.col("last_speaker") == F.xxhash64("speaker")) & (F.col("start_ms") - from_ <= merge_gap) & (F.coalesce("last_stop", F.lit(-1)) < F.col("last_main")), F.lit(False))
    held = held.withColumns({"fresh": F.when(F.col("wanted") & ~goes_on, 1).otherwise(0).cast("long"), "over": F.when(goes_on & since, F.col("last_fragment"))})
    done = running(held, ["meeting_id"], [F.col("idx").asc()], {"unit": "fresh"}, name="units")
    over = done.where("over is not null").select("meeting_id", F.col("over").alias("idx"), F.col("unit").alias("over_unit"))
    out = done.drop("over").join(over, ["meeting_id", "idx"], "left")
    return out.select(*rows.drop("is_main", "is_fragment").columns, F.when(F.col("wanted"), F.col("unit")).otherwise(F.col("over_unit")).alias("unit"), F.col("over_unit").isNotNull().alias("bridged"))


def unit_rows(marked: DataFrame) -> DataFrame:
    """(meeting_id, unit, speaker, kind, start_ms, end_ms, source_ids, bridged_ids, n) of marked segments; n counts source segments."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "segment_id", "bridged")))
    own = ~F.col("bridged")
    rows = marked.where("unit is not null").groupBy("meeting_id", "unit").agg(
        F.min_by("speaker", F.when(own, F.col("idx"))).alias("speaker"), F.min_by("kind", F.when(own, F.col("idx"))).alias("kind"), F.min_by("start_ms", F.when(own, F.col("idx"))).alias("start_ms"),
        F.max_by("end_ms", F.when(own, F.col("idx"))).alias("end_ms"), listed.alias("listed"),
    )
    ids = F.array_distinct(F.transform("listed", lambda x: x["segment_id"]))
    bridged = F.array_distinct(F.transform(F.filter("listed", lambda x: x["bridged"]), lambda x: x["segment_id"]))
    return rows.select("meeting_id", "unit", "speaker", "kind", "start_ms", "end_ms", F.array_join(ids, ",").alias("source_ids"), F.array_join(bridged, ",").alias("bridged_ids"), F.size(ids).cast("long").alias("n"))


def fold_texts(texts: list[str | None], clean: list[str | None], alike: float) -> str | None:
    """Texts joined by a semicolon, without those whose bigrams are nearly the same set as those of all before; ``clean`` are the texts without white space.

    A text below two characters has no bigrams; a null makes the whole null. Bigrams of what is joined are added, not made anew.
    """
    if any(t is None for t in texts):
        return None
    kept, last, have = [texts[0]], clean[0][-1:], _pairs(clean[0])
    for text, own in zip(texts[1:], clean[1:]):
        more = _pairs(own)
        both = len(have & more)
        if (both / (len(have) + len(more) - both) if have and more else 0.0) >= alike:
            continue
        kept.append(text)
        have |= more | _pairs(f"{last}；{own[:1]}")
        last = own[-1:] or "；"
    return "；".join(kept)


def _pairs(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


@F.pandas_udf(StringType())
def _folded(texts: pd.Series, clean: pd.Series, alike: pd.Series) -> pd.Series:
    return pd.Series([fold_texts(list(t), list(c), x) for t, c, x in zip(texts, clean, alike)], dtype=object)


def fold_chapters(blocks: DataFrame, segments: DataFrame, alike: float = 0.8) -> DataFrame:
    """Chapters of blocks (meeting_id, block, title, summary, key_points, anchors, start_ref, end_ref, refs, continues_previous).

    A block that continues the one before is part of its chapter. Summaries are joined by a semicolon; one nearly the same as what
    the chapter says so far is left out. Points, anchors and refs are kept once, in order. Speakers are those of cited segments; times are those of the first and
    the last ref's segments, 0 where there is none.
    """
    rows = blocks.withColumn("fresh", F.when(F.coalesce("continues_previous", F.lit(False)), 0).otherwise(1).cast("long"))
    numbered = running(rows, ["meeting_id"], [F.col("block").asc()], {"chapter": "fresh"}, name="chapters")
    told = F.array_sort(F.collect_list(F.struct("block", "title", "summary", "key_points", "anchors", "start_ref", "end_ref", "refs")))
    rows = numbered.groupBy("meeting_id", "chapter").agg(told.alias("b"))
    # the first block opens a chapter even if it claims to go on, so numbers may begin with 0
    least = numbered.groupBy("meeting_id").agg(F.min("chapter").alias("least"))
    rows = rows.join(least, "meeting_id").select("meeting_id", (F.col("chapter") - F.col("least") + 1).alias("chapter"), "b")

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("b", lambda x: F.coalesce(x[name], F.array().cast("array<string>")))))

    first = F.col("b")[0]
    summaries = F.transform("b", lambda x: x["summary"])
    overview = _folded(summaries, F.transform(summaries, lambda t: F.regexp_replace(t, r"(?U)\s+", "")), F.lit(float(alike)))
    rows = rows.select(
        "meeting_id", "chapter", F.size("b").cast("long").alias("blocks"), first["title"].alias("title"), overview.alias("overview"), united("key_points").alias("key_points"), united("anchors").alias("anchors"),
        first["start_ref"].alias("start_ref"), F.element_at("b", -1)["end_ref"].alias("end_ref"), united("refs").alias("refs"),
    )
    known = segments.select("meeting_id", F.col("segment_id").alias("ref"), "speaker", "start_ms", "end_ms")
    cited = rows.select("meeting_id", "chapter", F.explode("refs").alias("ref")).join(known, ["meeting_id", "ref"]).groupBy("meeting_id", "chapter").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    begin = known.select("meeting_id", F.col("ref").alias("start_ref"), "start_ms")
    end = known.select("meeting_id", F.col("ref").alias("end_ref"), "end_ms")
    out = rows.join(cited, ["meeting_id", "chapter"], "left").join(begin, ["meeting_id", "start_ref"], "left").join(end, ["meeting_id", "end_ref"], "left")
    return out.select(*rows.columns, F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), F.coalesce("start_ms", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", F.lit(0)).alias("end_ms"))
