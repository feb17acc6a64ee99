"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Documents are sets of hashed word shingles; those with equal sets form one class. Two sets with a Jaccard similarity
of at least ``t`` share one of the first ``n - ceil(t * n) + 1`` shingles under any global order, so a class is put
into one *tile* per prefix shingle. Inside a tile, classes are ordered by size and only those within the size band
``n_small >= t * n_large`` are partners. Partners get parity bitmaps whose width follows their size band; the bits in
which two bitmaps differ are a lower bound of the symmetric difference and so bound the overlap from above. What
passes is verified by intersecting the sorted shingle arrays of the texts.

Order of shingles: frequent ones last, rarer before more frequent ones (counted per block of documents over the whole
corpus), all others by hash. The order only decides how large tiles get, never which links are found. A tile whose
shingle is in more than TILE texts is dealt as parts by class, so no task sorts a whole hot tile.

Only components are asked for, so links that can't change them are left out. Tiles of up to ALL_PAIRS classes give all
their partners. Of a larger one, or a part of one, a star of partners is verified first; while it then still holds several components, its
members of different components are compared by bitmaps, in squares dealt over tasks: first the likeliest pairs that
would join them are verified, then every pair that the bitmaps allow, until a round adds nothing. No tile is capped.

Edge cases: null, empty or blank texts have an empty set, are linked with nothing and are components of their own.
Texts with fewer words than a shingle are one shingle, the whole sequence. Repeated ids keep one output row per input
row; null ids are answered with null. Empty tables give empty results. Other columns of the input are ignored, whatever they are called. Very long texts
are read whole, as a block of their own. Texts need not be valid UTF-8. Ties of size go by the digest of the set.
Shingles are compared by 64-bit hashes, sets by two digests of 64 bits: sets that share one digest but not the other get another name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import connected_components, discard, materialize, numbered_columns, place_of, sift, small_batches, tidy, without
from chronoloom.llm.words import SPACED, Words, long_lists, mix, sum_by, text_blocks

_Q = 0xD6E8FEB86659FD93
NO_ID = 2**63 - 1
#: A block of so many shingles reports those that several of its texts hold; HOT_FROM such texts in all make a shingle
#: frequent, and at most HOT_MOST shingles are put last (12 bytes each).
HOT_BLOCK, HOT_FROM, HOT_MOST = 4_000_000, 16, 1_000_000
#: A tile whose shingle is in more texts is dealt as parts of about so many classes.
TILE = 16_384
#: Larger tiles give a star of pairs first.
ALL_PAIRS = 48
#: Members of a large tile are compared in squares: of blocks of about PART members by tasks, of SIDE by steps in a task.
PART, SIDE = 2048, 512
#: Parts over which the members of a tile are dealt when its components are looked up.
SALTS = 32


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text its sorted distinct shingle hashes."""
    h, at = words.hash, words.at
    n_words = np.diff(at)
    out = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k if len(out) else 0):
        out += h[i : i + len(out)] * np.uint64(pow(_Q, i, 2**64))
    owner = np.repeat(np.arange(len(n_words)), n_words)
    valid = owner[: len(out)] == owner[k - 1 :] if len(out) else np.zeros(0, bool)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    n = np.where(n_words >= k, n_words - k + 1, n_words > 0)
    off = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(off[-1], dtype=np.uint64)
    long = np.ones(off[-1], dtype=bool)
    long[off[short]] = False
    flat[long] = out[valid]
    for d in short:
        w = h[at[d] : at[d + 1]]
        flat[off[d]] = np.concatenate([w * np.array([pow(_Q, i, 2**64) for i in range(len(w))], dtype=np.uint64), [np.uint64(len(w) * 0x632BE59BD9B4E019 % 2**64)]]).sum(dtype=np.uint64)
    flat = mix(flat)
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        if hi - lo > 1:
            flat[lo:hi].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[off[:-1][n > 0]] = True
    sizes = sum_by(new.astype(np.int64), off)
    return flat[new], np.concatenate([[0], np.cumsum(sizes)])


def set_digests(sets: np.ndarray, at: np.ndarray, salt: int = 0xA5A5A5A55A5A5A5A) -> np.ndarray:
    return mix(sum_by(mix(sets ^ np.uint64(salt)), at) + np.diff(at).astype(np.uint64))


def second_digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return set_digests(sets, at, 0x3C6EF372FE94F82B)


def bitmap_bits(n: int) -> int:
    """Width of the bitmap of a set of n: a power of two from 4n to 8n, 256 at least."""
    return max(256, 4 << (max(1, n) - 1).bit_length())


def parity_bitmap(values: np.ndarray) -> bytes:
    bits = bitmap_bits(len(values))
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, to: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) in a narrower width."""
    while bitmap.shape[-1] > to:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def most_difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of sizes a and b."""
    least = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * least


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, raw, at in text_blocks(batches):
        sets, off = shingle_sets(Words(raw, at, SPACED), k)
        yield batch, sets, off


def _hot_counter(k: int):
    def run(batches):
        held, seen, n = [], set(), 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = c >= 2
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["h", "c"])

        for _, sets, off in _blocks(batches, k):
            for i, d in enumerate(set_digests(sets, off).tolist()):
                if d not in seen:
                    seen.add(d)
                    held.append(sets[off[i] : off[i + 1]])
            n += len(sets)
            if n >= HOT_BLOCK:
                yield flush()
                held, seen, n = [], set(), 0
        yield flush()

    return run


def hot_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, rank by count, parts of the tile) of frequent shingles, HOT_MOST at most: they only steer the order of prefixes and how tiles are dealt."""
    counts = texts.select("text").mapInArrow(_hot_counter(k), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_FROM)
    rows = counts.orderBy(F.desc("c"), "h").limit(HOT_MOST).toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
    h, c = (rows.column(x).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("h", "c"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - 1 - order).astype(np.uint32), -(-c[order] // TILE).astype(np.int32)


class _Hot:
    """(rank + 1 of a frequent shingle, 0 of any other; parts of its tile); with a bit table in front."""

    def __init__(self, values: np.ndarray, rank: np.ndarray, parts: np.ndarray):
        self.values, self.rank, self.parts = values, rank, parts
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[(values >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, parts = np.zeros(len(h), dtype=np.uint32), np.ones(len(h), dtype=np.int32)
        if len(self.values):
            maybe = np.flatnonzero(self.table[(h >> np.uint64(42)).astype(np.int64)])
            at = np.searchsorted(self.values, h[maybe])
            at[at == len(self.values)] = 0
            same = self.values[at] == h[maybe]
            rank[maybe] = np.where(same, self.rank[at] + 1, 0)
            parts[maybe] = np.where(same, self.parts[at], 1)
        return rank, parts


def _features(k: int, percent: int, hot_values):
    def run(batches):
        hot, seen = _Hot(*hot_values.value), set()
        for batch, sets, off in _blocks(batches, k):
            n = np.diff(off)
            digest, second = set_digests(sets, off), second_digests(sets, off)
            prefix_n = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            rank, parts = hot(sets)
            some_hot = sum_by((rank > 0).astype(np.int64), off) > 0
            prefixes, part, dealt = [], [], []
            for i, d in enumerate(zip(digest.tolist(), second.tolist())):
                if n[i] == 0 or d in seen:  # a class is described once per task
                    prefix_n[i] = 0
                    continue
                seen.add(d)
                own = slice(off[i], off[i + 1])
                if some_hot[i]:
                    own = off[i] + np.argsort(rank[own], kind="stable")[: prefix_n[i]]
                else:
                    own = slice(off[i], off[i] + prefix_n[i])
                prefixes.append(sets[own])
                part.append(parts[own])
                dealt.append(np.full(prefix_n[i], d[1], np.uint64))
            flat, part, dealt = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((prefixes, np.uint64), (part, np.int32), (dealt, np.uint64)))
            part = np.where(part > 1, (dealt % part.astype(np.uint64)).astype(np.int32), np.int32(-1))
            at = np.concatenate([[0], np.cumsum(prefix_n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(digest.view(np.int64)), pa.array(second.view(np.int64)), long_lists(flat, at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(part))],
                ["doc_id", "n", "d", "d2", "prefix", "part"],
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal values of the first column from sorted batches, many runs at a time: arrays of the columns."""
    held: list[list[np.ndarray]] = []  # pieces of the run that is still open

    def joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*pieces)] if len(pieces) > 1 else pieces[0]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held and cols[0][0] != held[-1][0][-1]:
            yield joined(held)
            held = []
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield joined([*held, [c[:cut] for c in cols]])
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield joined(held)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _tile_pairs(percent: int):
    """From tiles or their parts (h, part, n, d), sorted: pairs of partners (h null), and the rows of tiles that gave a star only."""
    def run(batches):
        held: list[np.ndarray] = []

        def pairs(stack):
            p = np.unique(np.concatenate(stack, axis=1), axis=1) if stack else np.zeros((2, 0), np.int64)
            none = pa.nulls(p.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(p[0]), pa.array(p[1])], ["h", "n", "a", "b"])

        for h, part, n, d in _runs(batches):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1])
            h, part, n, d = h[new], part[new], n[new], d[new]
            at = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1, [len(h)]])
            size = np.diff(at)
            end = np.repeat(at[1:], size)
            small = np.repeat((size <= ALL_PAIRS) & (part[at[:-1]] < 0), size)
            first = np.repeat(at[:-1], size)
            i = np.arange(len(h))
            found = [(first[~small], i[~small]), (np.maximum(i - 1, first)[~small], i[~small])]
            for step in range(1, min(ALL_PAIRS, int(size.max(initial=1)))):
                x = i[small & (i + step < end)]
                if not len(x):
                    break
                found.append((x, x + step))
            x, y = (np.concatenate(z) for z in zip(*found))
            ok = (d[x] != d[y]) & (100 * n[x] >= percent * n[y])
            x, y = d[x[ok]], d[y[ok]]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            if sum(p.shape[1] for p in held) > 1_000_000:
                yield pairs(held)
                held = []
            big = ~small
            if big.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[big]), pa.array(n[big]), pa.array(d[big]), pa.nulls(int(big.sum()), pa.int64())], ["h", "n", "a", "b"])
        yield pairs(held)

    return run


def _words64(bitmap: bytes) -> np.ndarray:
    return np.frombuffer(bitmap, dtype=np.uint64)


def _bitmap_rows(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps at these places, all of ``width`` words of 64 bits, as rows."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column)].astype(np.int64)[at]
    raw = np.frombuffer(data, np.uint8)
    return raw[first[:, None] + np.arange(8 * width)].view(np.uint64)


def _bitmap_filter(percent: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            width = [np.array([bitmap_bits(x) // 64 for x in n.tolist()], np.int64) for n in (na, nb)]
            most = most_difference(na, nb, percent)
            keep = np.zeros(len(a), dtype=bool)
            for wa, wb in np.unique(np.stack(width), axis=1).T.tolist():
                at = np.flatnonzero((width[0] == wa) & (width[1] == wb))
                for lo in range(0, len(at), 4096):
                    cut = at[lo : lo + 4096]
                    x, y = (fold(_bitmap_rows(batch.column(i), cut, w), min(wa, wb)) for i, w in ((4, wa), (5, wb)))
                    keep[cut] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[cut]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _joining(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[int]:
    """Places of the pairs of components that join what earlier ones haven't; parent is kept from call to call."""
    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def _cross_pairs(percent: int, joining: bool):
    """In each square of a tile, pairs of classes of different components whose sizes and bitmaps allow a link.

    With ``joining`` the likeliest pairs that would join all components; else all pairs.
    """
    def square(s, p, q, n, d, c, bitmap):
        order = np.argsort(n, kind="stable")
        sides = [order[s[order] == p[0]]] if p[0] == q[0] else [order[s[order] == p[0]], order[s[order] == q[0]]]
        blocks = [[x[i : i + SIDE] for i in range(0, len(x), SIDE)] for x in sides]
        maps: dict[tuple[int, int], np.ndarray] = {}

        def folded(block, w):
            key = (int(block[0]), w)
            if key not in maps:
                maps[key] = np.stack([fold(_words64(bitmap[x]), w) for x in block.tolist()])
            return maps[key]

        parent: dict[int, int] = {}
        for i, x in enumerate(blocks[0]):
            for y in blocks[-1][i if len(sides) == 1 else 0 :]:
                if 100 * min(n[x[-1]], n[y[-1]]) < percent * max(n[x[0]], n[y[0]]):
                    continue  # the largest of one block is too small for all of the other
                small, large = np.minimum(n[x][:, None], n[y][None]), np.maximum(n[x][:, None], n[y][None])
                ok = (c[x][:, None] != c[y][None]) & (100 * small >= percent * large)
                if x[0] == y[0]:
                    ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None]
                if not ok.any():
                    continue
                w = min(len(bitmap[x[0]]), len(bitmap[y[0]])) // 8
                mx, my = folded(x, w), folded(y, w)
                slack = most_difference(small, large, percent)
                for k in range(w):
                    slack = slack - np.bitwise_count(mx[:, k][:, None] ^ my[:, k][None])
                u, v = np.nonzero(ok & (slack >= 0))
                if joining and len(u):
                    best = np.argsort(-slack[u, v], kind="stable")
                    u, v = u[best], v[best]
                    kept = _joining(c[x[u]], c[y[v]], parent)
                    u, v = u[kept], v[kept]
                if len(u):
                    yield d[x[u]], d[y[v]]

    def run(batches):
        for key, *columns in _runs(batches):
            at = _starts(key)
            found = [pair for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()) for pair in square(*(x[lo:hi] for x in columns))]
            if found:
                a, b = (np.concatenate(z) for z in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _salted(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Members of tiles (h, .., d) joined with a table that has one row a tile; a tile's members are dealt over SALTS parts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(few.select("*", salts), ["h", "salt"]).drop("salt")


def _squares(tiles: DataFrame, shape: DataFrame) -> DataFrame:
    """Members of tiles (h, m, n, d, c), dealt as squares of blocks of about PART members, m blocks a tile, each square to one task."""
    rows = tiles.withColumn("s", F.pmod(F.xxhash64("d", F.lit(1)), F.col("m")).cast("int"))
    rows = rows.select("h", "n", "d", "c", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    rows = rows.select(F.xxhash64("h", F.least("s", "x"), F.greatest("s", "x")).alias("key"), "s", F.least("s", "x").alias("p"), F.greatest("s", "x").alias("q"), "n", "d", "c")
    return rows.join(shape, "d").select("key", "s", "p", "q", "n", "d", "c", "bitmap").repartition("key").sortWithinPartitions("key")


def _verify(k: int, percent: int):
    """Rows (a, b, text) sorted by a, then b: first the text of a (b null), then its partners', which are intersected with it."""
    def run(batches):
        mine, held = np.zeros(0, np.uint64), None
        for batch, sets, off in _blocks(batches, k):
            a, own = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            b = batch.column(1).fill_null(0).to_numpy()
            n, keep = np.diff(off), np.zeros(len(a), dtype=bool)
            at = _starts(a)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if own[lo]:
                    mine, held, lo = sets[off[lo] : off[lo + 1]], a[lo], lo + 1
                if lo == hi or held != a[lo] or not len(mine):
                    continue
                theirs = sets[off[lo] : off[hi]]
                place = np.searchsorted(mine, theirs)
                place[place == len(mine)] = 0
                both = sum_by((mine[place] == theirs).astype(np.int64), off[lo : hi + 1] - off[lo])
                keep[lo:hi] = 100 * both >= percent * (len(mine) + n[lo:hi] - both)
            mine = mine.copy()  # the block's own array may go
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _describe(texts: DataFrame, classes: DataFrame, pairs: DataFrame | None, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """(d, n, text, bitmap) of the classes that pairs or nodes name, from one of the documents of each."""
    if nodes is None:
        nodes = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d")))
    reps = materialize(classes.join(nodes.select("d").distinct(), "d", "left_semi").select(F.col("rep").alias("doc_id"), "d", "d1", "d2", "n"), "reps")

    def run(batches):
        for batch, sets, off in _blocks(batches, k):
            maps = [parity_bitmap(sets[lo:hi]) for lo, hi in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.binary())], ["d", "n", "text", "bitmap"])

    # rows that repeat an id may differ in text: the one whose set is the class's stays
    own = sift(texts, reps, "doc_id").join(reps, "doc_id").select("d", "d1", "d2", "n", "text").mapInArrow(_own_text(k), "d long, n long, text string")
    out = materialize(own.dropDuplicates(["d"]).mapInArrow(run, "d long, n long, text string, bitmap binary"), "described")
    discard(reps)
    return out


def _own_text(k: int):
    def run(batches):
        for batch, sets, off in _blocks(batches, k):
            first, second = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            same = (set_digests(sets, off).view(np.int64) == first) & (second_digests(sets, off).view(np.int64) == second)
            yield batch.select(["d", "n", "text"]).filter(pa.array(same))

    return run


def _bounded(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    shape = own.select("d", "n", "bitmap")
    pairs = pairs.join(shape.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("xa")), "a").join(shape.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("xb")), "b")
    return materialize(pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bitmap_filter(percent), "a long, b long"), "bounded")


def _linked(pairs: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose similarity is reached; texts travel, not shingle arrays, as they are smaller.

    The text of a travels once, before those of its partners.
    """
    text = own.select("d", "text")
    theirs = pairs.join(text.withColumnRenamed("d", "b"), "b").select("a", "b", "text")
    mine = pairs.select(F.col("a").alias("d")).distinct().join(text, "d").select(F.col("d").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    return materialize(mine.union(theirs).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b")).mapInArrow(_verify(k, percent), "a long, b long"), "links")


def _joined(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose classes lie in different components, ca and cb."""
    a, b = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    pairs = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    return pairs.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _still_open(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    return materialize(pairs if comp is None else _joined(pairs, comp).select("a", "b"), "open_pairs")


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links; only the components that these join are looked at again."""
    if comp is None:
        return materialize(connected_components(links), "components")
    open_ = _joined(links, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    new = materialize(connected_components(open_), "joined")
    named = comp.join(new.select(F.col("node").alias("component"), F.col("component").alias("later")), "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    out = materialize(named.union(new.join(comp, "node", "left_anti").select("node", "component")), "components")
    discard(new, comp)
    return out


def _named(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sets whose names ``d`` are those of one class each, and the names that were given anew, if any.

    Different sets that share the first digest differ in the second one and take their name from it.
    """
    twice = materialize(sets.where("n > 0").groupBy("d").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi")).where("lo <> hi").select("d"), "collisions")
    if twice.isEmpty():
        discard(twice)
        return sets.withColumn("d1", F.col("d")), None
    mark = twice.withColumn("twice", F.lit(True))
    return sets.join(mark, "d", "left").withColumn("d1", F.col("d")).withColumn("d", F.when(F.col("twice"), F.xxhash64("d", "d2")).otherwise(F.col("d"))).drop("twice"), twice


@tidy
def ngram_jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents linked at a Jaccard similarity of percent/100."""
    spark = docs.sparkSession
    small_batches(spark)
    # a null id stands behind all others until the end
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot = spark.sparkContext.broadcast(hot_shingles(texts, k))
    read = materialize(texts.mapInArrow(_features(k, percent, hot), "doc_id long, n long, d long, d2 long, prefix array<long>, part array<int>"), "shingle_sets")
    sets, renamed = _named(read)
    classes = materialize(sets.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("d1").alias("d1"), F.min("d2").alias("d2")), "classes")
    members = materialize(sets.select("doc_id", "n", "d"), "members")

    rows = sets.where("n > 0").select("n", "d", F.explode(F.arrays_zip("prefix", "part")).alias("x")).select(F.col("x.prefix").alias("h"), "x.part", "n", "d")
    tiles = rows.repartition("h", "part").sortWithinPartitions("h", "part", "n", "d").mapInArrow(_tile_pairs(percent), "h long, n long, a long, b long")
    tiles = materialize(tiles, "tiles")
    discard(read, renamed)
    pairs = materialize(tiles.where("h is null").select("a", "b").distinct(), "pairs")
    large = materialize(tiles.where("h is not null").select("h", "n", F.col("a").alias("d")), "large_tiles")
    discard(tiles)

    tested, comp, shape, joining = None, None, None, True
    while not pairs.isEmpty():
        own = _describe(texts, classes, pairs, k)
        open_pairs = bounded = _bounded(pairs, own, percent)
        if comp is None:  # first a forest, each class with its smallest partner; most other pairs then lie inside a component
            chosen = materialize(open_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "chosen")
            found = _linked(chosen, own, k, percent)
            if not found.isEmpty():
                comp = _merged(comp, found)
            open_pairs = _still_open(open_pairs.join(chosen, ["a", "b"], "left_anti"), comp)
            discard(found, bounded, chosen)
        found = _linked(open_pairs, own, k, percent)
        if not found.isEmpty():
            comp = _merged(comp, found)
        discard(found, open_pairs, own)
        tested = pairs if tested is None else tested.union(pairs)
        placed = large.withColumn("c", F.col("d"))
        if comp is not None:
            placed = large.join(comp.select(F.col("node").alias("d"), "component"), "d", "left").select("h", "n", "d", F.coalesce("component", "d").alias("c"))
        mixed = placed.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count("*") / PART).cast("int").alias("m")).where("c0 < c1").select("h", "m")
        mixed = materialize(_salted(placed, mixed), "mixed_tiles")
        if mixed.isEmpty():
            break
        if shape is None:  # later rounds only have fewer members
            described = _describe(texts, classes, None, k, nodes=mixed)
            shape = materialize(described.select("d", "bitmap"), "shapes")
            discard(described)
        dealt = _squares(mixed, shape)
        while True:
            more = materialize(dealt.mapInArrow(_cross_pairs(percent, joining), "a long, b long").distinct(), "cross_pairs")
            pairs = materialize(more.join(tested, ["a", "b"], "left_anti"), "pairs")
            none = more.isEmpty()
            discard(more)
            if not joining or none or not pairs.isEmpty():
                break
            joining = False  # the likeliest pairs have all been refused: now every pair
        joining = False
        discard(mixed)
    discard(large, shape)

    # classes of a component are dealt over parts like the members of a tile, which is what its name is here
    by_class = classes.select("d", F.col("rep").alias("component_id"))
    if comp is not None:
        several = classes.select("d", "rep").join(comp.select(F.col("node").alias("d"), F.col("component").alias("h")), "d")
        several = materialize(_salted(several, several.groupBy("h").agg(F.min("rep").alias("component_id"))).select("d", "component_id"), "several")
        by_class = by_class.join(several.withColumnRenamed("component_id", "joined"), "d", "left").select("d", F.coalesce("joined", "component_id").alias("component_id"))
    by_class = materialize(by_class, "by_class")
    discard(classes, comp)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = members.join(by_class, "d", "left")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NO_ID)).alias("component_id"))


@tidy
def one_of_each_group(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row of the smallest id (null last).

    Rows are told apart by a number of their own, so repeated and null ids are documents like any other; of rows that tie
    on the id, the one of the smallest number stays. Texts without words, empty and null ones are kept. All columns are kept. Empty tables
    give empty results. Documents that stay aren't shuffled, as long as a bit table can tell that they do.
    """
    id_, text = f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}"
    numbered = materialize(numbered_columns(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = materialize(ngram_jaccard_components(numbered.select("row", text), percent, k, "row", text).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    named = numbered.select("row", F.col(id_).isNull().alias("none"), F.col(id_).alias("id")).join(groups, "row")
    first = named.groupBy("component_id").agg(F.min(F.struct("none", "id", "row")).alias("kept")).select("kept.row")
    gone = materialize(groups.join(first, "row", "left_anti").select("row"), "gone")
    discard(groups)
    return without(numbered, gone, "row").drop("row").toDF(*docs.columns)
