"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Classes are the leaves of a tree of LEVELS levels, WIDTH branches each. A token's probability is the product of the probabilities of
the branches that lead to its class, each given the branch before and the context, and of P(token | class). The branches
are maximum-entropy models over hashed features of the context: the word before, the pair of words before, and the word
two before (a skip). Each feature and value points into a table of weight rows, one weight a branch. The last factor
depends on the class only, and its maximum-entropy solution is the smoothed share of the token in its class.

The OWN_CLASSES most frequent words have classes of their own; for them the last factor is but for unknown words 1, so all their
probability comes from features. The others share the rest of the classes by hash. Every class has one place for words that
training did not hold, so each factor sums to 1.

Training: word counts come from the whole training part. Then every task makes gradient updates over all its
texts, in batches, scaled by how often a weight row was met; the tasks' rows are averaged by those counts in a
shuffle. ROUNDS passes are made. The number of weight rows grows with the number of training tokens (``row_bits``). Scoring reads
whole texts in numpy batches. Counts of the FREQUENT most frequent words (a
fixed number, 16 bytes each) are broadcast; the counts of other words are joined.

Because log P(token | class) and the base score hold the same smoothed count, the model's score is the base score plus,
for each token, the gain of its class in context over the class's share.

Edge cases: a null text is an empty text, of one token (the end). A null id belongs to the training part. Very long texts are read whole, as a block
of their own. Ties of counts go by the word's hash. Repeated rows are each answered and each count. With an empty training part all words are unknown and N and V are 0. Empty tables
give empty results. Extra columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize, small_batches, tidy
from chronoloom.llm.words import SPACED, Words, long_lists, sum_by, word_blocks

ROUNDS = 1
#: Words whose counts are broadcast.
FREQUENT = 1 << 19
#: Branches of a node and levels of the tree of classes; so many words have classes of their own.
WIDTH, LEVELS, OWN_CLASSES = 32, 3, 24_576
N_CLASSES = WIDTH**LEVELS
FEATURES = 3
#: Weight rows of each feature at each level, as powers of two, for up to 2**FULL_BITS training tokens; a bit more for each
#: factor of 4 beyond, and from FAST_BITS more on for each factor of 64: rows always grow with the corpus, slower than its tokens.
ROW_BITS, FULL_BITS, FAST_BITS = (14, 15, 15), 23, 2
#: Training tokens of a task, at least, where there are many: what tasks hand on stays below the size of the texts.
TASK_TOKENS = 8_000_000
#: Weights stay within this range.
LIMIT = 8.0
#: Tokens of a gradient step, few enough that its arrays stay in the processor's cache.
BATCH_BITS = 12
BATCH = 1 << BATCH_BITS
CHUNK = 128
#: A row of weights as one item, which numpy writes faster than a row of items.
ROW = np.dtype((np.void, 4 * WIDTH))
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Hashes of the end of a text and of the place before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class WordTable:
    """Numbers of words by hash, in open addressing."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.n = len(hashes)
        self.bits = max(10, int(2 * len(hashes) - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int64)
        at, todo = self._slot(hashes), np.arange(len(hashes))
        while len(todo):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            here = np.flatnonzero(free)[first]
            self.keys[at[here]], self.values[at[here]] = hashes[todo[here]], values[todo[here]]
            rest = np.ones(len(todo), bool)
            rest[here] = False
            todo, at = todo[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, h: np.ndarray, other: int) -> np.ndarray:
        out = np.full(len(h), other, np.int64)
        at, open_ = self._slot(h), None
        while True:
            keys, want = self.keys[at], h if open_ is None else h[open_]
            same = keys == want
            if open_ is None:
                out[same] = self.values[at[same]]
                open_ = np.flatnonzero(~same & (keys != 0))
                at = at[open_]
            else:
                out[open_[same]] = self.values[at[same]]
                more = ~same & (keys != 0)
                open_, at = open_[more], at[more]
            if not len(open_):
                return out
            at = (at + 1) & (len(self.keys) - 1)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, word before, word two before, where each text's tokens begin); every text ends with END."""
    n_texts = len(words.at) - 1
    at = words.at + np.arange(n_texts + 1)
    h = np.empty(int(at[-1]), np.uint64)
    end = np.zeros(len(h), bool)
    end[at[1:] - 1] = True
    h[end], h[~end] = END, words.hash
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[at[:-1]] = BEGIN
    two[at[:-1]] = BEGIN
    second = at[:-1] + 1
    two[second[second < at[1:]]] = BEGIN
    return h, one, two, at


def classes(h: np.ndarray, own: WordTable) -> np.ndarray:
    """Class of each token: words with classes of their own, then shared ones by hash."""
    shared = (own.n + (h >> np.uint64(40)) % np.uint64(N_CLASSES - own.n)).astype(np.int64)
    found = own(h, -1)
    return np.where(found >= 0, found, shared)


def row_bits(n_tokens: int) -> tuple[int, ...]:
    beyond = max(0, int(n_tokens).bit_length() - FULL_BITS)
    more = min(FAST_BITS, beyond // 2) + max(0, beyond - 2 * FAST_BITS) // 6
    return tuple(b + more for b in ROW_BITS)


def _mixed(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    features = (one * _MULT[0], one * _MULT[1] + two * _MULT[2], two * _MULT[2] + _MULT[0])
    return [x ^ (x >> np.uint64(29)) for x in features]


def _rows(mixed: list[np.ndarray], node: np.ndarray | None, bits: int) -> list[np.ndarray]:
    """Weight rows of each feature at a node of the tree (None: its root)."""
    if node is None:
        keys = [x * _MULT[1] for x in mixed]
    else:
        salt = (node + 1).astype(np.uint64) * _MULT[2]
        keys = [(x + salt) * _MULT[0] for x in mixed]
    return [(x >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i, x in enumerate(keys)]


def _sum_rows(p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, their first places, how often each occurs, sums of p)."""
    key = (r << BATCH_BITS) | np.arange(len(r))  # one plain sort, faster than an argsort
    key.sort()
    order, r = key & (BATCH - 1), key >> BATCH_BITS
    at = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
    n = np.diff(np.append(at, len(r)))
    sums = p.take(order[at], axis=0)
    several = n > 1
    if several.any():  # most rows occur once
        part = p.take(order[np.repeat(several, n)], axis=0)
        begin = np.cumsum(n[several]) - n[several]
        sums[several] = np.add.reduceat(part, begin, axis=0)
    return r[at], order[at], n, sums


class Model:
    """Weights and shares of branches. The digits of a class's number to the base WIDTH, lowest first, are its branches from the root on."""

    def __init__(self, own: WordTable, mass: np.ndarray, n_tokens: int = 0):
        self.own, self.bits = own, row_bits(n_tokens)
        self.share = []
        for k in range(LEVELS):
            below = mass.reshape(-1, WIDTH ** (k + 1)).sum(axis=0).reshape(WIDTH, -1)  # [branch, node]
            self.share.append((below / below.sum(axis=0)).T.astype(np.float32).copy())
        self.bias = [np.log(x) for x in self.share]
        self.log_mass = np.log10(mass)
        self.weights = [np.zeros((FEATURES << b, WIDTH), np.float32) for b in self.bits]

    def _batches(self, h: np.ndarray, one: np.ndarray, two: np.ndarray):
        """For each batch its place and, at each level: rows, node, branch, exp of the logits and their sum."""
        leaf = classes(h, self.own)
        for lo in range(0, len(h), BATCH):
            cut = slice(lo, lo + BATCH)
            mixed = _mixed(one[cut], two[cut])
            for k in range(LEVELS):
                node = leaf[cut] % WIDTH**k
                rows, y = _rows(mixed, node if k else None, self.bits[k]), leaf[cut] // WIDTH**k % WIDTH
                x = self.bias[k].take(node, axis=0)
                for r in rows:
                    x += self.weights[k].take(r, axis=0)
                np.exp(x, out=x)
                yield cut, k, rows, node, y, x, x @ np.ones(WIDTH, np.float32)

    def gains(self, h: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of P(class | context) over the smoothed total of the class, for each token."""
        out = np.zeros(len(h))
        for cut, _, _, _, y, x, total in self._batches(h, one, two):
            out[cut] += np.log10(x[np.arange(len(y)), y] / total)
        return out - self.log_mass[classes(h, self.own)]

    def update(self, h: np.ndarray, one: np.ndarray, two: np.ndarray, seen: list[np.ndarray]) -> None:
        """One gradient step for each batch. seen counts how often each row was met."""
        whole = [w.view(ROW)[:, 0] for w in self.weights]
        for _, k, rows, group, y, p, total in self._batches(h, one, two):
            p *= (1 / total)[:, None]
            p[np.arange(len(y)), y] -= 1
            for r in rows:
                row, place, n, step = _sum_rows(p, r)
                met = seen[k][row] + n
                seen[k][row] = met
                scale = self.share[k].take(group[place], axis=0)
                scale *= (FEATURES * met)[:, None]
                scale += 0.5 * FEATURES
                step /= scale
                now = self.weights[k].take(row, axis=0)
                now -= step
                np.clip(now, -LIMIT, LIMIT, out=now)
                whole[k].put(row, now.view(ROW)[:, 0])


def _count(batches):
    """Counts of words (h, c), merged as far as memory for a few million goes."""
    held, n = [], 0

    def merged():
        h, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(which, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def out(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    for batch, words in word_blocks(batches, SPACED):
        h, c = np.unique(np.append(words.hash, END), return_counts=True)
        c[h == END] += batch.num_rows - 1
        held.append((h, c))
        n += len(h)
        if n > 3_000_000:
            held = [merged()]
            n = len(held[0][0])
            if n > 1_500_000:
                yield out(*held[0])
                held, n = [], 0
    if held:
        yield out(*merged())


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each word, and the end, stands in the texts."""
    return materialize(texts.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word_counts")


def _long(x) -> np.ndarray:
    return x.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if len(x) else np.zeros(0, np.int64)


def class_mass(counts: DataFrame, own: WordTable) -> np.ndarray:
    """For each class the smoothed total N_c + 0.1 * (V_c + 1)."""
    def run(batches):
        total, n = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
        for b in batches:
            leaf = classes(b.column(0).to_numpy().view(np.uint64), own)
            total += np.bincount(leaf, weights=b.column(1).to_numpy(), minlength=len(total))
            n += np.bincount(leaf, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(total), pa.array(n)], ["k", "total", "n"])

    mass = np.full(N_CLASSES, 0.1)
    for r in counts.select("h", "c").mapInArrow(run, "k long, total double, n double").groupBy("k").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect():  # a row for each class
        mass[r["k"]] += r["t"] + 0.1 * r["n"]
    return mass


def _trainer(held):
    def run(batches):
        model = copy.copy(held.value)  # the task's own; the broadcast one stays as it is
        model.weights = [w.copy() for w in model.weights]
        seen = [np.zeros(len(w), np.float32) for w in model.weights]
        for _, words in word_blocks(batches, SPACED):
            h, one, two, _ = tokens(words)
            model.update(h, one, two, seen)
        for k in range(LEVELS):
            met = seen[k].reshape(-1, CHUNK)
            weights = model.weights[k].reshape(len(met), -1)
            some = np.flatnonzero(met.any(axis=1))
            for lo in range(0, len(some), 64):
                cut = some[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cut * LEVELS + k), pa.array([x.tobytes() for x in met[cut]], pa.binary()), pa.array([x.astype(np.float16).tobytes() for x in weights[cut]], pa.binary())],
                    ["chunk", "seen", "weights"],
                )

    return run


def _average(batches):
    """Averages of each chunk's rows, weighted by how often a task met them."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for k, s, w in zip(*(c.to_pylist() for c in b.columns)):
            seen = np.frombuffer(s, np.float32)
            part = np.frombuffer(w, np.float16).reshape(CHUNK, -1).astype(np.float32) * seen[:, None]
            if k in sums:
                sums[k][0][:] += seen
                sums[k][1][:] += part
            else:
                sums[k] = (seen.copy(), part)
    if sums:
        mean = [(w / np.maximum(s, 1)[:, None]).astype(np.float16).tobytes() for s, w in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(mean, pa.binary())], ["chunk", "weights"])


def train(texts: DataFrame, counts: DataFrame, own: WordTable, n_tokens: int, rounds: int = ROUNDS) -> Model:
    model = Model(own, class_mass(counts, own), n_tokens)
    context = texts.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, n_tokens // TASK_TOKENS)
    chunks = sum(len(w) for w in model.weights) // CHUNK
    for _ in range(rounds):
        held = context.broadcast(model)
        parts = texts.select("text").coalesce(tasks).mapInArrow(_trainer(held), "chunk long, seen binary, weights binary")
        averages = materialize(parts.repartition(max(1, chunks // 64), "chunk").mapInArrow(_average, "chunk long, weights binary"), "weights")
        for r in averages.toLocalIterator():  # the rows of weights, one part of them at a time
            at, k = divmod(r["chunk"], LEVELS)
            model.weights[k][at * CHUNK : (at + 1) * CHUNK] = np.frombuffer(r["weights"], np.float16).reshape(CHUNK, -1)
        held.destroy()
        discard(averages)
    return model


def _scorer(held):
    """(log10 sum over tokens of frequent words, gain of the model, rare words with their numbers) of each text."""
    def run(batches):
        model, frequent = held.value
        for batch, words in word_blocks(batches, SPACED):
            h, one, two, at = tokens(words)
            c = frequent(h, 0)
            known = sum_by((c > 0).astype(np.int64), at)
            log = sum_by(np.where(c > 0, np.log10(c + 0.1), 0.0), at)
            gain = sum_by(model.gains(h, one, two), at)
            rare = np.flatnonzero(c == 0)
            text = np.searchsorted(at, rare, side="right") - 1
            order = np.lexsort((h[rare], text))
            r, t = h[rare][order], text[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(r)))
            off = np.searchsorted(t[first], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(known), pa.array(log), pa.array(gain), long_lists(r[first], off), long_lists(times, off)],
                ["row", "doc_id", "n_tokens", "n_known", "log", "gain", "rare", "times"],
            )

    return run


@tidy
def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    all_texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = all_texts.where(~held_out("doc_id", folds, fold))
    counts = word_counts(texts)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    h, c = _long(top.column("h")).view(np.uint64), _long(top.column("c"))
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    own = WordTable(h[:OWN_CLASSES], np.arange(min(len(h), OWN_CLASSES)))
    model = train(texts, counts, own, int(n))
    held = spark.sparkContext.broadcast((model, WordTable(h, c)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = all_texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _scorer(held), f"row long, doc_id {kind}, n_tokens long, n_known long, log double, gain double, rare array<long>, times array<long>"
    )
    rows = materialize(rows, "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    smooth = float(np.log10(n + 0.1 * (v + 1)))
    base = F.col("log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(smooth)
    out = rows.join(rare, "row", "left")
    return out.select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain") + F.col("n_tokens") * F.lit(smooth)).alias("score"),
    )
