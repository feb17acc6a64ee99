"""Evaluation of labelled intervals against a reference, by key: label mapping, coverage, purity, grid samples, texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.intervals import islands, meets, overlap_join, overlap_of, shared_time
from chronoloom.operators.tables import written


def label_overlaps(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label, ref_label, ms): the time that each known interval shares with the reference's labels, written once for all that reads it."""
    return written(shared_time(rows.where("label <> 'unknown'"), reference, keys, ["id", "label"]), "label_overlaps")


def by_labels(rows: DataFrame, reference: DataFrame, keys: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """(keys, label, ref_label, ms): shared time of each pair of labels, zeros filled in; unknown labels are left out."""
    known = rows.where("label <> 'unknown'")
    shared = shared_time(known, reference, keys, ["label"]) if overlaps is None else overlaps.groupBy(*keys, "label", "ref_label").agg(F.sum("ms").alias("ms"))
    # labels of one key only, a few each
    grid = known.select(*keys, "label").distinct().join(reference.select(*keys, F.col("label").alias("ref_label")).distinct(), keys)
    return grid.join(shared, [*keys, "label", "ref_label"], "left").withColumn("ms", F.coalesce("ms", F.lit(0).cast("long")))


def assign(rows: list[str], columns: list[str], value: dict[tuple[str, str], int]) -> list[str]:
    """A column for each row (there are at least as many), no column twice, with the largest sum; of several, the first in order.

    Hungarian method with potentials. Costs are whole numbers of any size: the value comes first, then the place of the first row's
    column, then of the second's, so the smallest cost is also the first in order.
    """
    n, m = len(rows), len(columns)
    base = m + 1
    cost = [[-value[r, c] * base**n + j * base ** (n - 1 - i) for j, c in enumerate(columns)] for i, r in enumerate(rows)]
    potential, price, owner = [0] * n, [0] * m, [-1] * m
    for row in range(n):
        slack: list[int | None] = [None] * m
        before, done, at, i = [-1] * m, [False] * m, -1, row
        while True:  # grow a tree of tight edges until it meets a free column
            least, nearest = None, -1
            for j in range(m):
                if done[j]:
                    continue
                d = cost[i][j] - potential[i] - price[j]
                if slack[j] is None or d < slack[j]:
                    slack[j], before[j] = d, at
                if least is None or slack[j] < least:
                    least, nearest = slack[j], j
            potential[row] += least
            for j in range(m):
                if done[j]:
                    potential[owner[j]] += least
                    price[j] -= least
                else:
                    slack[j] -= least
            at = nearest
            if owner[at] < 0:
                break
            done[at] = True
            i = owner[at]
        while at >= 0:
            owner[at], at = (owner[before[at]] if before[at] >= 0 else row), before[at]
    taken = {i: j for j, i in enumerate(owner) if i >= 0}
    return [columns[taken[i]] for i in range(n)]


def label_mapping(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, ref_label, ms): the one-to-one mapping of labels that shares most time, of a matrix of ``by_labels``.

    A key's matrix, labels by labels, is one group; its assignment takes time with the cube of the number of labels.
    """
    kinds = ", ".join(f"{k} {matrix.schema[k].dataType.simpleString()}" for k in keys)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        value = {(a, b): int(ms) for a, b, ms in zip(part["label"], part["ref_label"], part["ms"])}
        own, ref = sorted(set(part["label"])), sorted(set(part["ref_label"]))
        if len(own) <= len(ref):
            pairs = list(zip(own, assign(own, ref, value)))
        else:
            pairs = [(a, b) for b, a in zip(ref, assign(ref, own, {(b, a): v for (a, b), v in value.items()}))]
        out = pd.DataFrame([(*[part[k].iloc[0] for k in keys], a, b, value[a, b]) for a, b in pairs], columns=[*keys, "label", "ref_label", "ms"])
        return out

    return matrix.groupBy(*keys).applyInPandas(choose, f"{kinds}, label string, ref_label string, ms long")


def segment_quality(rows: DataFrame, reference: DataFrame, mapping: DataFrame, keys: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """(keys, id, label, mapped, duration_ms, correct_ms, other_ms, silence_ms, purity, leak) of known intervals."""
    mapped = mapping.select(*keys, "label", F.col("ref_label").alias("mapped"))
    known = rows.where("label <> 'unknown'").join(mapped, [*keys, "label"], "left")
    if overlaps is None:
        overlaps = label_overlaps(rows, reference, keys)
    own = F.coalesce(F.col("ref_label") == F.col("mapped"), F.lit(False))
    shared = overlaps.join(mapped, [*keys, "label"], "left").groupBy(*keys, "id").agg(F.sum(F.when(own, F.col("ms")).otherwise(0)).alias("correct_ms"), F.sum(F.when(own, 0).otherwise(F.col("ms"))).alias("other_ms"))
    out = known.join(shared, [*keys, "id"], "left").na.fill(0, ["correct_ms", "other_ms"])
    heard, length = F.col("correct_ms") + F.col("other_ms"), F.col("end_ms") - F.col("start_ms")
    return out.select(
        *keys, "id", "label", "mapped", length.alias("duration_ms"), "correct_ms", "other_ms", F.greatest(F.lit(0).cast("long"), length - heard).alias("silence_ms"),
        F.round(F.try_divide("correct_ms", heard), 6).alias("purity"), F.round(F.try_divide("other_ms", heard), 6).alias("leak"),
    )


def quality_totals(quality: DataFrame, keys: list[str]) -> DataFrame:
    correct, other, silence, total = (F.sum(c) for c in ("correct_ms", "other_ms", "silence_ms", "duration_ms"))
    return quality.groupBy(*keys).agg(
        correct.alias("correct_ms"), other.alias("other_ms"), silence.alias("silence_ms"), total.alias("duration_ms"), F.round(F.try_divide(correct, correct + other), 6).alias("purity"),
        F.round(F.try_divide(other, correct + other), 6).alias("leak"), F.round(F.try_divide(silence, total), 6).alias("silence_ratio"),
    )


def coverage_rows(rows: DataFrame, reference: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Reference intervals with the time that known and unknown intervals cover, and the label that covers most (of several, the one that begins first)."""
    labels, unknown = shared_time(reference, rows, keys, ["id"], first=True), F.col("ref_label") == "unknown"
    place = F.struct("ms", (-F.col("at.start_ms")).alias("s"), (-F.col("at.end_ms")).alias("e"), (-F.col("at.id")).alias("i"))
    best = F.max_by(F.struct(F.col("ref_label").alias("label"), "ms"), F.when(~unknown, place))
    sums = labels.groupBy(*keys, "id").agg(F.sum(F.when(unknown, 0).otherwise(F.col("ms"))).alias("known"), F.sum(F.when(unknown, F.col("ms")).otherwise(0)).alias("unknown"), best.alias("best"))
    out = reference.join(sums, [*keys, "id"], "left").na.fill(0, ["known", "unknown"])
    length = F.col("end_ms") - F.col("start_ms")
    both = F.least(length, F.col("known") + F.col("unknown"))
    out = out.select(
        *keys, "id", F.col("label").alias("ref_label"), length.alias("duration_ms"), F.least(length, F.col("known")).alias("known_ms"), F.least(length, F.col("unknown")).alias("unknown_ms"), both.alias("all_ms"),
        F.round(F.try_divide(F.least(length, F.col("known")), length), 6).alias("known_coverage"), F.round(F.try_divide(both, length), 6).alias("all_coverage"), F.col("best.label").alias("label"), F.coalesce("best.ms", F.lit(0).cast("long")).alias("best_ms"),
    )
    return out.join(mapping.select(*keys, "label", F.col("ref_label").alias("mapped")), [*keys, "label"], "left").withColumnRenamed("label", "best_label")


def interval_metrics(coverage: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Mean coverage, and numbers and time of reference intervals covered below 0.95 and below ``least``."""
    part, under, missed = F.col("known_ms") / F.col("duration_ms"), F.col("known_ms") / F.col("duration_ms") < 0.95, F.col("known_ms") / F.col("duration_ms") < least
    length = F.col("duration_ms")
    return coverage.where("duration_ms > 0").groupBy(*keys).agg(
        F.round(F.avg(part), 6).alias("avg_coverage"), F.count_if(under).alias("under_95"), F.sum(F.when(under, length).otherwise(0)).alias("under_95_ms"), F.count_if(missed).alias("missed"),
        F.sum(F.when(missed, length).otherwise(0)).alias("missed_ms"), F.sum(length).alias("total_ms"),
    )


def _points(start: Column, end: Column, step: int) -> Column:
    """How many multiples of ``step`` lie in [start, end)."""
    return F.ceil(end / step) - F.ceil(start / step)


def sample_metrics(rows: DataFrame, reference: DataFrame, mapping: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Recall, precision and accuracy over a grid of times, counted per stretch of time instead of per point."""
    known, ref, everything = (islands(x, keys).select(*keys, F.col("island").alias("id"), "start_ms", "end_ms") for x in (rows.where("label <> 'unknown'"), reference, rows))
    mapped = rows.join(mapping.select(*keys, "label", F.col("ref_label").alias("mapped")), [*keys, "label"])
    # where a label's union meets that of the label that it is mapped to; labels may overlap one another
    own, other = (islands(x.where("end_ms > start_ms").select(*keys, F.col(c).alias("mapped"), "start_ms", "end_ms"), [*keys, "mapped"]) for x, c in ((mapped.where("mapped is not null"), "mapped"), (reference.where("label is not null"), "label")))
    hits = islands(meets(own, other, [*keys, "mapped"]), keys)
    parts = {"ref": ref, "known": known, "everything": everything, "known_ref": meets(known, ref, keys), "all_ref": meets(everything, ref, keys), "hit": hits}
    counted = None
    for name, frame in parts.items():
        part = frame.select(*keys, F.lit(name).alias("what"), _points(F.col("start_ms"), F.col("end_ms"), step).alias("n"))
        counted = part if counted is None else counted.union(part)
    n = {name: F.sum(F.when(F.col("what") == name, F.col("n")).otherwise(0)) for name in parts}
    ratio = lambda a, b: F.round(F.try_divide(n[a], n[b]), 6)
    return counted.groupBy(*keys).agg(
        *[n[x].alias(f"n_{x}") for x in parts], ratio("known_ref", "ref").alias("known_recall"), ratio("all_ref", "ref").alias("all_recall"), ratio("known_ref", "known").alias("known_precision"),
        ratio("all_ref", "everything").alias("all_precision"), ratio("hit", "known_ref").alias("accuracy"),
    )


def text_rows(segments: DataFrame, reference: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Segments (keys, id, start_ms, end_ms, text) with the texts of the reference that they overlap, in its order, joined by spaces."""
    pairs = overlap_join(segments, reference, keys, bucket)
    told = F.array_sort(F.collect_list(F.struct("b_start_ms", "b_id", "b_text")))
    found = pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.count("*").alias("n_ref"), F.sum(overlap_of(pairs)).alias("ref_ms"), told.alias("told"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("told", lambda x: x["b_text"]), " "), r"\s+", " "))
    return segments.join(found.select(*keys, "id", "n_ref", "ref_ms", text.alias("ref_text")), [*keys, "id"], "left").na.fill({"n_ref": 0, "ref_ms": 0, "ref_text": ""})
