"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every document is described by statistics of its whole text (lengths, shares of kinds of characters, repetition of
words and lines), transformed to be roughly normal. Class means and covariances come from sums over all labelled rows
outside the held-out fold, added up by Spark, so nothing that grows is gathered. Covariances are shrunk towards
the pooled covariance and its diagonal. A score is the logistic of the difference of the two log densities (Mahalanobis
distances by cached Cholesky factors, log determinants) plus the log prior odds.

Labels, language, source and id are never inputs of a score.

Edge cases: null, empty and blank texts have the statistics of an empty text. A document labelled several times counts by
its mean label, 0.5 upwards as good; null labels don't count. With labels of one class only, or none, every score is 0.5.
Repeated rows are each answered. Empty tables give empty results. Extra columns are kept by ``score_quality`` where
they don't clash with its own, in upper or lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import but_own, discard, free_name, materialize, sift, small_batches, tidy
from chronoloom.llm.words import SPACED, Words, sum_by, text_blocks

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper", "digit", "symbol", "space", "beyond_ascii", "distinct_words",
    "top_word", "line_length", "repeated_lines", "repeated_pairs", "symbol_words", "end_stops", "short_words",
)
#: Share of the pooled covariance, and of its diagonal, in each class's.
POOL, DIAGONAL = 0.3, 0.1

_KIND = np.zeros((6, 256), dtype=bool)
_KIND[0, 65:91] = True  # upper case
_KIND[1, 48:58] = True  # digits
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # symbols
_KIND[3, [9, 10, 11, 12, 13, 32]] = True  # white space
_KIND[4, 128:] = True
_KIND[5, [46, 33, 63]] = True  # stops


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range: how many distinct values, and how often its most frequent one occurs."""
    values = values.copy()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > 1:
            values[lo:hi].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(values)))
    n = sum_by(new.astype(np.int64), at)
    off = np.concatenate([[0], np.cumsum(n)])
    top = np.zeros(len(n), np.int64)
    have = n > 0
    if have.any():
        top[have] = np.maximum.reduceat(run, off[:-1][have])
    return n, top


def document_statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Transformed statistics of a block of texts, a row each."""
    words = Words(raw, at, SPACED)
    n = np.diff(words.at)
    size = np.maximum(np.diff(at), 1).astype(float)
    few = np.maximum(n, 1).astype(float)
    length = (words.end - words.start).astype(float)
    share = [sum_by(kind[raw].astype(np.int64), at) / size for kind in _KIND]
    mean = sum_by(length, words.at) / few
    spread = np.sqrt(np.maximum(sum_by(length * length, words.at) / few - mean**2, 0))
    distinct, top = _distinct(words.hash, words.at)
    inner = np.ones(len(words), bool)
    inner[words.at[1:][n > 0] - 1] = False  # the last word of a text begins no pair
    begin = np.flatnonzero(inner)
    pairs = words.hash[begin] * np.uint64(0x9E3779B97F4A7C15) + words.hash[begin + 1] if len(begin) else np.zeros(0, np.uint64)
    pair_n = np.maximum(n - 1, 0)
    distinct_pairs, _ = _distinct(pairs, np.concatenate([[0], np.cumsum(pair_n)]))
    pair_n = np.maximum(pair_n, 1)
    distinct_pairs = np.where(n < 2, 1, distinct_pairs)
    break_ = raw == 10
    line_at = np.flatnonzero(break_)
    n_lines = sum_by(break_.astype(np.int64), at) + 1
    symbol = _KIND[2][raw].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(symbol)])
    symbolic = (total[words.end] - total[words.start]) * 2 >= length
    marked = total[words.end] - total[np.maximum(words.start, words.end - 2)] >= 2
    # lines by the hashes of their words: a line that occurs again in its text is repeated
    line_of = np.searchsorted(line_at, words.start)
    first = np.ones(len(words), bool)
    first[1:] = line_of[1:] != line_of[:-1]
    first[words.at[:-1][n > 0]] = True
    begin = np.flatnonzero(first)
    lines = np.add.reduceat(words.hash * (np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words)))) + 1).astype(np.uint64), begin) if len(begin) else np.zeros(0, np.uint64)
    lines_at = np.searchsorted(begin, words.at)
    distinct_lines, _ = _distinct(lines, lines_at)
    real_lines = np.maximum(np.diff(lines_at), 1)
    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.sqrt(share[0]), np.sqrt(share[1]), np.sqrt(share[2]), share[3], np.sqrt(share[4]),
        (distinct / few) ** 2, np.log(np.maximum(top, 1) / few + 0.01), np.log1p(n / n_lines), np.sqrt(1 - distinct_lines / real_lines * (np.diff(lines_at) > 0) - 1.0 * (np.diff(lines_at) == 0)),
        np.sqrt(1 - np.minimum(1, distinct_pairs / pair_n)), np.sqrt(sum_by((symbolic | marked).astype(np.int64), words.at) / few), np.sqrt(share[5]), sum_by((length <= 3).astype(np.int64), words.at) / few,
    ], axis=1).astype(float)


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``stats`` in place of the text."""
    small_batches(docs.sparkSession)
    keep = but_own(docs.columns, text_col, "stats")
    held = free_name(keep, "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", stats array<double>"

    def run(batches):
        for batch, raw, at in text_blocks(batches, held):
            x = np.nan_to_num(document_statistics(raw, at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "stats"])

    return docs.select(*keep, F.col(text_col).cast("string").alias(held)).mapInArrow(run, schema)


class Discriminant:
    """Two shrunk Gaussians from sums: for each class its number of rows, sum and sum of outer products."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        width = len(FEATURES)
        self.classes = {c: s for c, s in sums.items() if s[0] > 0}
        self.usable = len(self.classes) == 2
        if not self.usable:
            return
        scatter = {c: s2 - np.outer(s1, s1) / n for c, (n, s1, s2) in self.classes.items()}
        total = sum(n for n, _, _ in self.classes.values())
        pooled = sum(scatter.values()) / total
        floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.parts = {}
        for c, (n, s1, _) in self.classes.items():
            cov = (1 - POOL) * scatter[c] / n + POOL * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * floor
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(width))
            self.parts[c] = (s1 / n, np.linalg.inv(factor).T, 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), 0.5)
        density = {}
        for c, (mean, white, log_det, prior) in self.parts.items():
            z = (x - mean) @ white
            density[c] = prior - 0.5 * ((z * z).sum(axis=1) + log_det)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _sums(batches):
    width, n, s1, s2 = len(FEATURES), np.zeros(2), np.zeros((2, len(FEATURES))), np.zeros((2, len(FEATURES), len(FEATURES)))
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            mine = x[y == c]
            n[c] += len(mine)
            s1[c] += mine.sum(axis=0)
            s2[c] += mine.T @ mine
    parts = [np.concatenate([[n[c]], s1[c], s2[c].ravel()]) for c in (0, 1)]
    i = np.arange(len(parts[0]))
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(i))), pa.array(np.tile(i, 2)), pa.array(np.concatenate(parts))], ["c", "i", "v"])


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """From described documents and labels (those of held-out rows already left out)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    rows = described.select(id_col, "stats").join(known, id_col).select("y", "stats").mapInArrow(_sums, "c long, i long, v double")
    width = len(FEATURES)
    total = np.zeros((2, 1 + width + width * width))
    for r in rows.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + width + width squared) numbers
        total[r["c"], r["i"]] = r["v"]
    return Discriminant({c: (total[c, 0], total[c, 1 : 1 + width], total[c, 1 + width :].reshape(width, width)) for c in (0, 1)})


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@tidy
def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """``docs`` without their texts, with held_out, score and predicted."""
    own = ("held_out", "score", "predicted", "stats")
    keep = but_own(docs.columns, text_col, *own)
    described = materialize(describe(docs.select(*keep, text_col), text_col), "quality_stats")
    model = fit(described, labels.where(F.coalesce(fold(id_col, folds) != held_out_fold, F.lit(True))), id_col, label_col)
    schema = ", ".join(f"`{c}` {described.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*keep, "score"])

    out = described.mapInArrow(run, schema)
    return out.select(*keep, F.coalesce(fold(id_col, folds) == held_out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@tidy
def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, unchanged.

    Only documents that may be labelled are described for the fit; all are then described and judged in one pass. Null, empty and
    blank texts are judged by the statistics of an empty text; repeated rows are each judged; all columns are kept. Without labels
    of both classes every score is 0.5 and everything stays. Empty tables give empty results.
    """
    labelled = sift(docs.select(id_col, text_col), labels.where(F.col(label_col).isNotNull()), id_col)
    described = materialize(describe(labelled, text_col), "quality_stats")
    model = fit(described, labels, id_col, label_col)
    discard(described)

    def run(batches):
        for batch, raw, ends in text_blocks(batches, text_col):
            good = model.score(np.nan_to_num(document_statistics(raw, ends))) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
