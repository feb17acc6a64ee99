"""Toxicity: a classifier chain over hashed words and beginnings of words.

The labels know one category, toxic. The chain's links, in order: threat, contempt, insult, toxic. The first three are weakly
labelled, whatever the label says: a document holds a word of the category's list below (fixed values), or two terms that the category has
learned, at most GROWN whose documents hold a word of the list far more often than others do (by the log odds). The last link, whose probability is
the score, is that of the labels. Each is a ridge logistic model over a document's counts of selected terms and its
length; later models also see the probabilities of earlier links. In training, these come from out-of-fold predictions, so
a link learns from the probabilities that it will meet.

Training uses at most SAMPLE labelled rows outside the held-out fold (those with the smallest hash of their id), a bound
that is broadcast safely; TERMS terms (words, or their first bytes) are selected by the log odds of how many documents
hold them, or hold them more than once, whichever tells toxic documents better. Every whole document is scored.

Edge cases: null, empty and blank texts have no terms. A document labelled several times counts by its mean label, 0.5
upwards as toxic; null labels don't count. Without toxic and other labels every score is 0. Repeated rows are each
answered. Ties of terms go by their hash. Very long texts are read whole, as a block of their own. Empty tables give empty results. Extra columns of documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize, small_batches, tidy
from chronoloom.llm.words import PLAIN, Words, hash_of, sum_by, word_blocks

SAMPLE, TERMS, FOLDS = 12_000, 384, 5
#: Terms that a category learns at most, and the least log odds over their standard error that they need.
GROWN, LEAST_Z = 12, 6.0
#: Beginnings of words, in bytes, that are terms too.
BEGINNINGS = (4, 5, 6, 7, 8)
# Words that tell a category of toxic documents.
CATEGORIES = {
    "threat": "kill hurt destroy die burn beat murder shoot".split(),
    "contempt": "worthless pathetic disgusting useless stupid dumb filthy vile hate".split(),
    "insult": "idiot moron clown scum fool loser jerk trash bastard".split(),
}
LINKS = (*CATEGORIES, "toxic")


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of all words and beginnings of words."""
    text = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    hashes, texts = [words.hash], [text]
    for n in BEGINNINGS:
        long, h = words.prefix_hash(n)
        hashes.append(h)
        texts.append(text[long])
    return np.concatenate(hashes), np.concatenate(texts)


def _holds(words: Words, lists: list[np.ndarray]) -> np.ndarray:
    """For each text and list whether it holds a word of it."""
    return np.stack([sum_by(np.isin(words.hash, some).astype(np.int64), words.at) > 0 for some in lists], axis=1).astype(np.int64)


def _documents(lists: list[np.ndarray]):
    """(term, repeated, n, n_0, ..): how many sampled texts hold a term, or hold it more than once, and how many of these are of each link, by block."""
    def run(batches):
        for batch, words in word_blocks(batches, PLAIN):
            of = np.column_stack([_holds(words, lists), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)])
            h, text = _terms(words)
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(first)
            times = np.diff(np.append(first, len(h)))
            for repeated, at in ((False, first), (True, first[times > 1])):
                term, which = np.unique(h[at], return_inverse=True)
                n = np.bincount(which, minlength=len(term))
                each = [np.bincount(which, weights=of[text[at], k], minlength=len(term)).astype(np.int64) for k in range(of.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.full(len(term), repeated)), pa.array(n), *map(pa.array, each)], ["term", "repeated", "n", *[f"n_{k}" for k in range(of.shape[1])]])

    return run


def _sizes(lists: list[np.ndarray]):
    """How many sampled texts are of each link, by block."""
    def run(batches):
        for batch, words in word_blocks(batches, PLAIN):
            of = np.column_stack([_holds(words, lists), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in of], [f"n_{k}" for k in range(len(of))])

    return run


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Newton steps; the first column of x is 1 and isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _design(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(counts)), np.log1p(n_words) / 8, np.log1p(counts)])


class Chain:
    def __init__(self, counts: np.ndarray, n_words: np.ndarray, labels: list[np.ndarray]):
        x = _design(counts, n_words)
        fold = np.arange(len(x)) % FOLDS
        self.weights = []
        for y in labels:
            apart = np.empty(len(x))
            for f in range(FOLDS):
                here = fold == f
                apart[here] = _logistic(x[here], ridge_logistic(x[~here], y[~here])) if here.any() and (~here).any() else y.mean() if len(y) else 0.5
            self.weights.append(ridge_logistic(x, y))
            x = np.column_stack([x, apart])

    def probabilities(self, counts: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
        x, out = _design(counts, n_words), []
        for w in self.weights:
            out.append(_logistic(x, w))
            x = np.column_stack([x, out[-1]])
        return out


class _Selected:
    """Places of selected terms by hash."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def counts(self, words: Words) -> np.ndarray:
        """A row of term counts for each text."""
        n, k = len(words.at) - 1, len(self.sorted)
        h, text = _terms(words)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        where = np.searchsorted(self.sorted, h[maybe])
        where[where == k] = 0
        hit = self.sorted[where] == h[maybe]
        return np.bincount(text[maybe[hit]] * k + self.order[where[hit]], minlength=n * k).reshape(n, k).astype(float)


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 1, folds: int = 3) -> tuple[_Selected, Chain] | None:
    """Terms and chain from documents (doc_id, text) and labels (doc_id, toxic); None if there is nothing to tell apart."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    if held_out_fold is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out_fold)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # SAMPLE rows at most
    texts = materialize(texts, "sample")
    total, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return None
    lists = [np.sort(hash_of([w.encode() for w in words])) for words in CATEGORIES.values()]
    kinds = [f"n_{k}" for k in range(len(LINKS))]
    df = texts.mapInArrow(_documents(lists), "term long, repeated boolean, n long, " + ", ".join(f"{c} long" for c in kinds))
    df = materialize(df.groupBy("term", "repeated").agg(*[F.sum(c).alias(c) for c in ("n", *kinds)]), "terms")
    sizes = texts.mapInArrow(_sizes(lists), ", ".join(f"{c} long" for c in kinds)).agg(*[F.sum(c) for c in kinds]).first()

    def told(k: int) -> Column:
        """How far the log odds of a term among the texts of a link stand from those among the others, over its standard error."""
        n1, n0 = F.col(f"n_{k}") + 0.5, F.col("n") - F.col(f"n_{k}") + 0.5
        odds = F.log(n1 / (F.lit(sizes[k] + 1.0) - n1)) - F.log(n0 / (F.lit(total - sizes[k] + 1.0) - n0))
        return odds / F.sqrt(1 / n1 + 1 / n0)

    picked = df.select("term", told(len(LINKS) - 1).alias("z")).groupBy("term").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    if not picked:
        return None
    terms = _Selected(np.array([r["term"] for r in picked], np.int64).view(np.uint64))
    grown = []
    for k, own in enumerate(lists):
        best = df.where(~F.col("repeated")).select("term", told(k).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(GROWN + len(own)).collect()
        learned = np.array([r["term"] for r in best], np.int64).view(np.uint64)
        grown.append(_Selected(learned[~np.isin(learned, own)][:GROWN]))
    discard(df)

    def count(batches):
        for batch, words in word_blocks(batches, PLAIN):
            seen = terms.counts(words).astype(np.int64)
            at = np.arange(len(seen) + 1, dtype=np.int32) * seen.shape[1]
            weak = _holds(words, lists)
            for k, some in enumerate(grown):
                if len(some.sorted):
                    weak[:, k] |= (some.counts(words) > 0).sum(axis=1) >= 2
            weak_at = np.arange(len(weak) + 1, dtype=np.int32) * len(lists)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(words.at)), pa.ListArray.from_arrays(pa.array(at), pa.array(seen.ravel())), pa.ListArray.from_arrays(pa.array(weak_at), pa.array(weak.ravel()))],
                ["toxic", "n_words", "seen", "weak"],
            )

    got = texts.mapInArrow(count, "toxic int, n_words long, seen array<long>, weak array<long>").toArrow().combine_chunks()  # SAMPLE * TERMS numbers at most
    discard(texts)
    counts, weak = (got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1).astype(float) for c in ("seen", "weak"))
    n_words, toxic_y = (got.column(c).to_numpy().astype(float) for c in ("n_words", "toxic"))
    order = np.lexsort([toxic_y, *weak.T, counts.sum(axis=1), n_words])  # the same folds whatever the order of rows
    return terms, Chain(counts[order], n_words[order], [*weak[order].T, toxic_y[order]])


@tidy
def score_toxicity(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, threat, contempt, insult): probabilities; score is that of toxic."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), held_out_fold, folds)

    def run(batches):
        for batch, words in word_blocks(batches, PLAIN):
            n = np.diff(words.at)
            links = [np.zeros(len(n)) for _ in LINKS] if model is None else model[1].probabilities(model[0].counts(words), n.astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, links)], ["doc_id", *LINKS])

    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in LINKS))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).cast("int").alias("predicted"), *CATEGORIES)
