"""Windows of a meeting that depend on one another: what a window leaves open is carried into the next one.

Rounds are a wavefront: each takes one window of every meeting that isn't at its end. A window is as long as the budget allows; what comes of
it (chapters, and from which segment on the next window reads again) is checked over flat rows, so a fault ends its meeting and no other. Every
round is a folder of tables in the shared folder; a killed run goes on after the last whole round.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import clean_text
from chronoloom.operators.scan import running
from chronoloom.operators.sequence import clip_ranges, expand_ranges
from chronoloom.operators.tables import exists, new_folder

# Words that stand for no carryover.
NO_CARRYOVER = ("", "null", "none", "无")
Model = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def lay_out(segments: DataFrame, overhead: int) -> DataFrame:
    """Segments that say something with their place ``pos`` from 0, and the characters up to and with each (``overhead`` more a segment)."""
    rows = segments.where(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != "").withColumn("cost", (F.length("text") + overhead).cast("long"))
    return running(rows, ["meeting_id"], [F.col("idx").asc()], {"upto": "cost"}, count=True, name="laid_out").withColumn("pos", F.col("pos") - 1)


def fit(laid: DataFrame, starts: DataFrame, budget: int, room: int) -> DataFrame:
    """Segments of the window of each meeting that begins at ``start`` (meeting_id, start, base, last; base: the characters before it): as far as they fit into the budget less ``room``.

    Adds window_pos, window_n and final (the meeting's last segment is in it). A first segment that doesn't fit makes no window.
    """
    rows = laid.join(starts, "meeting_id").where((F.col("pos") >= F.col("start")) & (F.col("upto") - F.col("base") <= budget - room))
    whole = Window.partitionBy("meeting_id")  # of rows that fit: one window a meeting
    rows = rows.withColumns({"window_n": F.count("*").over(whole), "end": F.max("pos").over(whole)})
    return rows.select(*laid.columns, (F.col("pos") - F.col("start")).alias("window_pos"), "window_n", (F.col("end") == F.col("last")).alias("final"))


def _judged(window: DataFrame, chapters: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(told: chapters with their places and what is wrong with them, clipped ranges, verdicts with ``merged``) of one window a meeting."""
    places = window.select("meeting_id", F.col("segment_id").alias("ref"), F.col("window_pos").alias("place"))
    begin, end = places.select("meeting_id", F.col("ref").alias("start_ref"), F.col("place").alias("start_idx")), places.select("meeting_id", F.col("ref").alias("end_ref"), F.col("place").alias("end_idx"))
    told = chapters.withColumns({"title": clean_text(F.col("title")), "summary": clean_text(F.col("summary"))}).join(begin, ["meeting_id", "start_ref"], "left").join(end, ["meeting_id", "end_ref"], "left")
    fault = F.when(F.col("title").isNull() | F.col("summary").isNull(), "drop_empty_chapter").when(F.col("start_idx").isNull() | F.col("end_idx").isNull(), "drop_invalid_chapter_range").when(F.col("end_idx") < F.col("start_idx"), "drop_reversed_chapter_range")
    told = told.withColumn("repair", fault)
    clipped = clip_ranges(told.where("repair is null").select("meeting_id", "no", "start_idx", "end_idx"))
    sizes = window.groupBy("meeting_id").agg(F.max("window_n").alias("n"), F.max("final").alias("final"))
    carried = answers.join(sizes, "meeting_id").withColumn("asked", F.when(~F.lower(F.btrim("carryover_ref")).isin(*NO_CARRYOVER), F.col("carryover_ref")))
    carried = carried.join(places.select("meeting_id", F.col("ref").alias("asked"), "place"), ["meeting_id", "asked"], "left")
    done = clipped.groupBy("meeting_id").agg(F.max("end_idx").alias("done"))
    carried = carried.join(done, "meeting_id", "left")
    kept = F.when(~F.col("final"), F.col("place"))
    error = (
        F.when(~F.col("finish_reason").eqNullSafe(F.lit("stop")), "finish_reason").when(F.col("asked").isNotNull() & F.col("place").isNull(), "carryover_outside_window")
        .when(kept <= F.coalesce("done", F.lit(-1)), "carryover_overlaps_chapter").when(kept <= 0, "carryover_without_progress")
    )
    return told, clipped, carried.select("meeting_id", error.alias("error"), kept.alias("carryover"), F.coalesce(kept, "n").alias("next_pos"), (F.col("final") & F.col("place").isNotNull()).alias("merged"))


def check_window(window: DataFrame, chapters: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges, verdicts, repairs) of one window a meeting.

    chapters: (meeting_id, no, title, summary, start_ref, end_ref). answers: (meeting_id, finish_reason, carryover_ref). ranges: (meeting_id, no, title,
    summary, start_idx, end_idx, full_start, full_end) by places in the window, without gaps up to what is carried over. verdicts: (meeting_id, error, carryover, next_pos); a
    meeting with an error has no ranges. repairs: (meeting_id, no, repair).
    """
    told, clipped, verdicts = _judged(window, chapters, answers)
    # of chapters that begin together, titles and summaries are joined where they differ
    same = F.array_sort(F.collect_list(F.struct("end_idx", "no", "title", "summary")))
    words = told.where("repair is null").groupBy("meeting_id", "start_idx").agg(same.alias("same"))

    def joined(name: str):
        return F.aggregate(F.slice("same", 2, F.greatest(F.size("same") - 1, F.lit(1))), F.col("same")[0][name], lambda acc, x: F.when(x[name] == acc, acc).otherwise(F.concat(acc, F.lit("；"), x[name])))

    words = words.select("meeting_id", "start_idx", joined("title").alias("title"), joined("summary").alias("summary"), F.transform(F.slice("same", 2, F.greatest(F.size("same") - 1, F.lit(1))), lambda x: x["no"]).alias("merged_no"))
    fine = verdicts.where("error is null")
    ranges = expand_ranges(clipped.join(fine.select("meeting_id"), "meeting_id", "left_semi"), fine.select("meeting_id", (F.col("next_pos") - 1).alias("last_idx")))
    ranges = ranges.join(words, ["meeting_id", "start_idx"]).select("meeting_id", "no", "title", "summary", "start_idx", "end_idx", "full_start", "full_end", "expanded")
    none = F.lit(None).cast("long")
    repairs = [
        told.where("repair is not null").select("meeting_id", "no", "repair"), words.select("meeting_id", F.explode("merged_no").alias("no"), F.lit("merge_same_start_core_chapters").alias("repair")),
        fine.where("merged").select("meeting_id", none.alias("no"), F.lit("merge_final_carryover_into_last_chapter").alias("repair")),
        ranges.where("expanded").select("meeting_id", "no", F.lit("expand_chapter_range").alias("repair")),
    ]
    return ranges.drop("expanded"), verdicts.drop("merged"), functools.reduce(DataFrame.unionByName, repairs)


def wavefront(segments: DataFrame, model: Model, budget: int, overhead: int = 0, room: int = 0, most_rounds: int = 10_000, folder: str | None = None) -> dict[str, DataFrame]:
    """Tables ``windows`` (meeting_id, round, start, n, carryover, error), ``chapters`` (.., start_pos, end_pos, full_start, full_end) and ``repairs``.

    ``model`` turns a round's windows into (chapters, answers) for ``check_window``. With a ``folder`` that an earlier call has used, whole rounds are taken from there.
    A round writes its windows, the model's answers and the verdicts; chapters and repairs of all rounds are made from these at once when they are read. Segments that lie behind are left out of what rounds read
    whenever less than half is ahead.
    """
    spark = segments.sparkSession
    folder = folder or new_folder(spark, "wavefront")

    def table(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        made = make()
        if not exists(spark, f"{folder}/{name}/_SUCCESS"):
            made.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(made.schema).parquet(f"{folder}/{name}")

    laid = ahead = table("laid", lambda: lay_out(segments, overhead))
    zero = F.lit(0).cast("long")
    starts = table("starts_0", lambda: laid.groupBy("meeting_id").agg(zero.alias("start"), zero.alias("base"), F.max("pos").alias("last")))
    held = None
    for number in range(most_rounds):
        left = starts.agg(F.sum(F.col("last") - F.col("start") + 1)).first()[0]
        if not left:
            return _gathered(spark, folder, kinds) if number else _nothing(spark)
        if held is None:
            held = left
        elif 2 * left < held:
            ahead, held = table(f"ahead_{number}", lambda: ahead.join(starts.select("meeting_id", "start"), "meeting_id").where("pos >= start").select(*laid.columns)), left
        at = F.lit(number).alias("round")
        window = table(f"window_{number}", lambda: fit(ahead, starts, budget, room).select("*", at))
        chapters, answers = model(window.drop("round"))
        chapters, answers = table(f"told_{number}", lambda: chapters.select("*", at)), table(f"answers_{number}", lambda: answers.select("*", at))
        verdicts = _judged(window, chapters.drop("round"), answers.drop("round"))[2]
        sizes = window.where("window_pos = 0").select("meeting_id", F.col("window_n").alias("n"))
        upto = window.select("meeting_id", (F.col("window_pos") + 1).alias("next_pos"), F.col("upto").alias("next_base"))
        told = starts.join(sizes, "meeting_id", "left").join(verdicts.join(upto, ["meeting_id", "next_pos"], "left"), "meeting_id", "left")
        lost = F.when(F.col("n").isNull(), "segment_exceeds_budget").when(F.col("next_pos").isNull(), "no_answer")
        told = table(f"windows_{number}", lambda: told.select("meeting_id", at, "start", "last", F.coalesce("n", F.lit(0)).alias("n"), "carryover", F.coalesce("error", lost).alias("error"), "next_pos", "next_base"))
        kinds = {"window": (number, window.schema), "told": (number, chapters.schema), "answers": (number, answers.schema), "windows": (number, told.schema)}
        starts = told.where("error is null").select("meeting_id", (F.col("start") + F.col("next_pos")).alias("start"), F.col("next_base").alias("base"), "last").where("start <= last")
    raise ValueError(f"more than {most_rounds} rounds of windows")


def _gathered(spark, folder: str, kinds: dict) -> dict[str, DataFrame]:
    """The tables of all rounds; a meeting's window of a round is checked under the key (meeting_id, round)."""
    key, parts = F.struct("meeting_id", "round"), {}
    for name, (last, schema) in kinds.items():
        parts[name] = spark.read.schema(schema).parquet(*[f"{folder}/{name}_{n}" for n in range(last + 1)])
    ranges, _, repairs = check_window(*[parts[name].withColumn("meeting_id", key).drop("round") for name in ("window", "told", "answers")])
    front = parts["windows"].select("meeting_id", "round", "start")
    own = [F.col("meeting_id.meeting_id").alias("meeting_id"), F.col("meeting_id.round").alias("round")]
    at = [(F.col(c) + F.col("start")).alias(new) for c, new in (("start_idx", "start_pos"), ("end_idx", "end_pos"), ("full_start", "full_start"), ("full_end", "full_end"))]
    return {
        "windows": parts["windows"].select("meeting_id", "round", "start", "n", "carryover", "error"),
        "chapters": ranges.select(*own, *[c for c in ranges.columns if c != "meeting_id"]).join(front, ["meeting_id", "round"]).select("meeting_id", "round", "no", "title", "summary", *at),
        "repairs": repairs.select(*own, "no", "repair"),
    }


def _nothing(spark) -> dict[str, DataFrame]:
    kinds = {
        "windows": "meeting_id long, round int, start long, n long, carryover long, error string", "repairs": "meeting_id long, round int, no long, repair string",
        "chapters": "meeting_id long, round int, no long, title string, summary string, start_pos long, end_pos long, full_start long, full_end long",
    }
    return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}
