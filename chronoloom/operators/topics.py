"""Topic segmentation: cohesion of neighbouring windows, valley depth, boundary signals, blocks of a least and a largest size.

Texts are cleaned once a segment; the bigrams of both windows of a position are counted by a small function of the two texts, so a task
holds the bigrams of one position at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Segments of a window and of the neighbourhood of a valley; the least characters of a window.
WINDOW, SPAN, LEAST_CHARS = 3, 4, 12
LONG_GAP, DEPTH, SHORT_BLOCK = 1500, 0.30, 400
#: Weights of a long gap, a change of speaker and a valley, and the score of a boundary.
GAP_WEIGHT, SPEAKER_WEIGHT, VALLEY_WEIGHT, SCORE = 1.0, 0.25, 1.0, 1.0


def _order():
    return Window.partitionBy("meeting_id").orderBy("idx")


def spoken(segments: DataFrame) -> DataFrame:
    """Segments that say something."""
    return segments.where(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != "")


def _codes(text: str) -> np.ndarray:
    """A number for each character bigram of a text without white space; a single character is one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-1] << 21 | c[1:] if len(c) > 1 else -1 - c


def bigram_cosine(before: str, after: str) -> float:
    """Cosine of the bigram counts of two texts; 0 if either has none."""
    (x, n), (y, m) = (np.unique(_codes(t), return_counts=True) for t in (before, after))
    norm = math.sqrt(float((n * n).sum())) * math.sqrt(float((m * m).sum()))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float((n[i] * m[j]).sum()) / norm if norm > 0 else 0.0


@F.pandas_udf(DoubleType())
def _cosine(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else bigram_cosine(a, b) for a, b in zip(before, after)], dtype="float64")


def cohesion(segments: DataFrame, window: int = WINDOW, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Segments that say something, with ``cohesion``: cosine of the bigram counts of the window before and the one from here.

    Null where there is no window before or either is short.
    """
    rows = spoken(segments).withColumn("_clean", F.regexp_replace("text", r"(?U)\s+", ""))
    back, here = _order().rowsBetween(-window, -1), _order().rowsBetween(0, window - 1)
    rows = rows.withColumns({
        "_before": F.array_join(F.collect_list("_clean").over(back), ""), "_after": F.array_join(F.collect_list("_clean").over(here), ""),
        "_told": (F.sum(F.length("text")).over(back) >= least_chars) & (F.sum(F.length("text")).over(here) >= least_chars),
    })
    # texts of windows that are told go to the function, others don't
    texts = [F.when(F.col("_told"), F.col(c)) for c in ("_before", "_after")]
    return rows.withColumn("cohesion", _cosine(*texts)).drop("_clean", "_before", "_after", "_told")


def boundaries(segments: DataFrame) -> DataFrame:
    """Segments that say something, with cohesion, depth, score and reasons of a boundary before each.

    A valley is a cohesion that no neighbour with one falls below; its depth is how far the peaks on both sides rise above it.
    A change from or to an unknown speaker is none.
    """
    rows = cohesion(segments)
    before = Window.unboundedPreceding, -1
    back = Window.partitionBy("meeting_id").orderBy(F.desc("idx"))
    c = F.col("cohesion")
    rows = rows.withColumns({
        "_left": F.last("cohesion", ignorenulls=True).over(_order().rowsBetween(*before)), "_right": F.last("cohesion", ignorenulls=True).over(back.rowsBetween(*before)),
        "_peak": F.coalesce(F.max("cohesion").over(_order().rowsBetween(-SPAN, -1)), c), "_next_peak": F.coalesce(F.max("cohesion").over(_order().rowsBetween(1, SPAN)), c),
        "_speaker": F.lag("speaker").over(_order()), "_end": F.lag("end_ms").over(_order()),
    })
    slope = c.isNull() | F.coalesce(F.col("_left") < c, F.lit(False)) | F.coalesce(F.col("_right") < c, F.lit(False))
    rows = rows.withColumn("depth", F.when(slope, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("_peak") - c) + F.greatest(F.lit(0.0), F.col("_next_peak") - c)))
    gap = F.coalesce(F.col("start_ms") - F.col("_end") >= LONG_GAP, F.lit(False))
    change = F.coalesce((F.col("_speaker") != F.col("speaker")) & (F.col("_speaker") != "unknown") & (F.col("speaker") != "unknown"), F.lit(False))
    valley = F.col("_end").isNotNull() & (F.col("depth") >= DEPTH)
    score = gap.cast("double") * GAP_WEIGHT + change.cast("double") * SPEAKER_WEIGHT + valley.cast("double") * VALLEY_WEIGHT
    reasons = F.array_compact(F.array(F.when(gap, "gap"), F.when(change, "speaker"), F.when(valley, "cohesion")))
    return rows.withColumns({"score": score, "reasons": reasons}).drop("_left", "_right", "_peak", "_next_peak", "_speaker", "_end")


def placed(segments: DataFrame, short: int = SHORT_BLOCK) -> DataFrame:
    """Segments that say something, with the number of their ``block`` and why it was opened.

    A short block joins the one on its left; a first block that is still short joins the next one.
    """
    upto = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(_order()) == 1
    rows = boundaries(segments).withColumn("_cut", F.sum(F.when(first | (F.col("score") >= SCORE), 1).otherwise(0)).over(upto))
    raw = rows.groupBy("meeting_id", "_cut").agg(F.sum(F.length("text")).alias("chars"), F.min_by("reasons", "idx").alias("opened"))
    by = Window.partitionBy("meeting_id").orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = raw.withColumn("_group", F.sum(F.when((F.col("chars") >= short) | (F.col("_cut") == 1), 1).otherwise(0)).over(by))
    raw = raw.withColumn("_lead", F.sum(F.when(F.col("_group") == 1, F.col("chars")).otherwise(0)).over(Window.partitionBy("meeting_id")))
    raw = raw.withColumn("block", F.greatest(F.col("_group") - F.when(F.col("_lead") < short, 1).otherwise(0), F.lit(1)))
    opened = F.first("opened").over(Window.partitionBy("meeting_id", "block").orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raw = raw.withColumn("opened_by", F.when(F.col("block") == 1, F.array(F.lit("start"))).otherwise(opened))
    return rows.join(raw.select("meeting_id", "_cut", "block", "opened_by"), ["meeting_id", "_cut"]).drop("_cut")


def blocks(rows: DataFrame) -> DataFrame:
    """(meeting_id, block, first_idx, last_idx, start_ms, end_ms, speakers, chars, n, opened_by) of placed segments."""
    return rows.groupBy("meeting_id", "block").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"),
        F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"), F.array_join(F.min_by("opened_by", "idx"), ",").alias("opened_by"),
    )


def _counts(texts: list[str]) -> Counter:
    t = "".join("".join(texts).split())
    return Counter(t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 1 else Counter([t] if t else [])


def _alike(x: Counter, y: Counter) -> float:
    dot = sum(n * y[g] for g, n in x.items())
    return dot / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))) if dot else 0.0


def split_large(rows: DataFrame, most_tokens: int, chars_per_token: float = 1.3, overhead: int = 0) -> DataFrame:
    """Placed segments whose blocks of more than ``most_tokens`` are cut at their weakest cohesion until none is left.

    Only large blocks are gathered, each by itself; where to cut next depends on the cuts before.
    """
    cost = F.ceil(F.sum(F.length("text")).over(Window.partitionBy("meeting_id", "block")) / chars_per_token) + overhead
    rows = rows.withColumn("_large", cost > most_tokens)

    def cut(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        texts, number = block["text"].tolist(), [0] * len(block)
        todo, n = [(0, len(texts))], 0
        while todo:  # left parts first, so numbers follow the order of segments
            lo, hi = todo.pop()
            if hi - lo > 1 and math.ceil(sum(map(len, texts[lo:hi])) / chars_per_token) + overhead > most_tokens:
                at = min(range(lo + 1, hi), key=lambda i: (_alike(_counts(texts[max(lo, i - WINDOW) : i]), _counts(texts[i : min(hi, i + WINDOW)])), i))
                todo += [(at, hi), (lo, at)]
                continue
            number[lo:hi] = [n] * (hi - lo)
            n += 1
        return pd.DataFrame({"meeting_id": block["meeting_id"], "idx": block["idx"], "part": number})

    parts = rows.where("_large").select("meeting_id", "block", "idx", "text").groupBy("meeting_id", "block").applyInPandas(cut, "meeting_id long, idx long, part long")
    rows = rows.join(parts, ["meeting_id", "idx"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    number = F.dense_rank().over(Window.partitionBy("meeting_id").orderBy("block", "part"))
    opened = F.when(F.col("part") > 0, F.array(F.lit("size_split"))).otherwise(F.col("opened_by"))
    return rows.withColumn("opened_by", opened).withColumn("block", number).drop("_large", "part")


def reason_counts(found: DataFrame) -> DataFrame:
    """(reason, n): why blocks were opened."""
    return found.select(F.explode(F.split("opened_by", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
