"""Document fingerprints of closed syncmers, and how alike a document is to an edited copy and to the next document.

A k-mer of K code points is an anchor if its smallest inner s-mer (S code points, smallest by hash) stands at one of its edges. Whether it is
one depends on nothing around it, so texts that share a passage share its anchors; any run of K - S + 1 k-mers has one. A text with fewer
code points, but not none, is one anchor. The fingerprint lists all anchors: for each the distance from the one before (the
first from -1) and 32 bits of its hash, ten hexadecimal digits in all.

Likeness matches anchors one to one by hash, in the order in which they stand in both texts (the longest chain of equal anchors
whose places rise in both), and is twice the matched ones over all anchors of both; 1 for two texts without any.

An edited text is the beginning of one text and the beginning of the next. Its anchors are those that lie whole inside either part,
which are known already, and those of the few k-mers across the seam.

Documents meet their next one in blocks: their ids (with the size and a hash of the text) are range-sorted, and the first id of every
BLOCK_BYTES of text begins a block; those ids are at most one a block. Texts are then shuffled once, to their blocks, together with one copy of the first document of
each block for the end of the block before; a task streams its blocks in order and holds two texts and one batch.

Edge cases: null texts are empty, have no anchors and an empty fingerprint. Ids that tie are ordered by a hash of the text, repeated
rows follow one another; null ids come last. A document that is the only one is its own next. Very long texts are cut into overlapping pieces.
Texts need not be valid UTF-8: bytes that begin no character belong to the one before. Empty tables give empty results. Extra columns are ignored.
The input is read twice and must have its rows in the same order both times, as files have; if not, the query fails.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize, small_batches, tidy
from chronoloom.llm.words import _P, _P_INV, _power, mix, text_blocks

K, S = 32, 8
#: Bytes of text in a block, at least; more where there would be more than MOST_BLOCKS.
BLOCK_BYTES, MOST_BLOCKS = 16 << 20, 1 << 18
#: Code points of a piece of a long text.
PIECE = 1 << 18
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.uint32))


class Codes:
    """Code points of a block of texts: the bytes of each as a number, where each begins, and where each text's begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        lead = (raw & 0xC0) != 0x80
        lead[at[:-1][at[1:] > at[:-1]]] = True
        self.start = np.flatnonzero(lead)
        self.at = np.searchsorted(self.start, at)
        size = np.diff(np.append(self.start, len(raw)))
        self.codes = raw[self.start].astype(np.uint64)
        for j in range(1, min(8, int(size.max(initial=1)))):
            more = np.flatnonzero(size > j)
            self.codes[more] |= raw[self.start[more] + j].astype(np.uint64) << np.uint64(8 * j)

    def byte(self, text: int, n: int, end: int) -> int:
        """The byte, counted from the block's first, at which the n-th code point of a text begins; ``end`` is where the text ends."""
        i = self.at[text] + n
        return int(self.start[i]) if i < self.at[text + 1] else end


def _windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of one run of at least K code points."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(0x9E37)) * _power(_P, n), out=total[1:])
    back = _power(_P_INV, n)
    inner = mix((total[S:] - total[:-S]) * back[: n - S + 1])
    width, have, least = K - S + 1, 1, inner
    while have < width:  # minima of ever longer windows
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    m = n - K + 1
    at = np.flatnonzero((inner[:m] == least[:m]) | (inner[K - S : K - S + m] == least[:m]))
    return at, (mix((total[at + K] - total[at]) * back[at] + np.uint64(K)) >> np.uint64(32)).astype(np.uint32)


def _short(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = (mix(codes + np.uint64(0x9E37)) * _power(_P, len(codes))).sum(dtype=np.uint64)
    return np.zeros(1, np.int64), (mix(np.array([whole + np.uint64(len(codes))])) >> np.uint64(32)).astype(np.uint32)


def anchors_of(codes: np.ndarray, at: np.ndarray, whole: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the anchors of each text of a block; with ``whole``, a text below K code points is one anchor."""
    n = np.diff(at)
    places, hashes = [], []
    for lo in range(0, max(len(codes) - K + 1, 0), PIECE):
        p, h = _windows(codes[lo : lo + PIECE + K - 1])
        places.append(p + lo)
        hashes.append(h)
    places, hashes = (np.concatenate(x) if x else none for x, none in zip((places, hashes), _NONE))
    text = np.searchsorted(at, places, side="right") - 1
    inside = places + K <= at[text + 1]  # others lie across two texts
    places, hashes, text = places[inside], hashes[inside], text[inside]
    cut = np.searchsorted(text, np.arange(len(n) + 1))
    out = []
    for i, size in enumerate(n.tolist()):
        if whole and 0 < size < K:
            out.append(_short(codes[at[i] : at[i + 1]]))
        else:
            own = slice(cut[i], cut[i + 1])
            out.append((places[own] - at[i], hashes[own]))
    return out


def fingerprint(places: np.ndarray, hashes: np.ndarray) -> str:
    """Ten hexadecimal digits an anchor: two of the distance from the one before, eight of the hash."""
    gap = np.diff(places, prepend=-1)
    if len(gap) and gap.max() > 255:
        raise ValueError("anchors are too far apart")
    rows = np.empty((len(gap), 5), np.uint8)
    rows[:, 0] = gap
    rows[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return rows.tobytes().hex()


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a fingerprint."""
    rows = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 5)
    return np.cumsum(rows[:, 0].astype(np.int64)) - 1, rows[:, 1:].copy().view(">u4").ravel().astype(np.uint32)


def _ranks(h: np.ndarray) -> np.ndarray:
    """How often each value stands before its place."""
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    first = np.searchsorted(sorted_, sorted_)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - first
    return out


def _chain(a: np.ndarray, b: np.ndarray) -> int:
    """The longest chain of equal values whose places rise in both; the k-th of a value in one goes with its k-th in the other."""
    short = min(len(a), len(b))
    if not short:
        return 0
    differs = np.flatnonzero(a[:short] != b[:short])
    same = int(differs[0]) if len(differs) else short
    a, b = a[same:], b[same:]
    if not len(a) or not len(b):
        return same
    common = np.intersect1d(a, b)
    if not len(common):
        return same
    ia, ib = np.flatnonzero(np.isin(a, common)), np.flatnonzero(np.isin(b, common))
    ka, kb = (x.astype(np.uint64) << np.uint64(32) | _ranks(x).astype(np.uint64) for x in (a[ia], b[ib]))
    order = np.argsort(kb)
    at = np.searchsorted(kb[order], ka)
    at[at == len(kb)] = 0
    hit = kb[order][at] == ka
    tails: list[int] = []
    for y in ib[order[at[hit]]].tolist():
        k = bisect.bisect_left(tails, y)
        tails[k : k + 1] = [y]
    return same + len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two lists of anchors' hashes, in the order of their places."""
    return 2 * _chain(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


class _Text:
    """A document in hand: id, bytes, where its code points begin, its anchors."""

    __slots__ = ("id", "raw", "codes", "starts", "anchors")

    def __init__(self, id_, raw: bytes, codes: np.ndarray, starts: np.ndarray, anchors):
        self.id, self.raw, self.codes, self.starts, self.anchors = id_, raw, codes, starts, anchors

    def byte(self, n: int) -> int:
        return int(self.starts[n]) if n < len(self.starts) else len(self.raw)


def compare(pairs: list[tuple[_Text, _Text]]) -> list[tuple]:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents and the ones after them."""
    seams, bases = [], []
    for one, two in pairs:
        n = len(one.codes)
        keep, take = n - n // 2, min(n // 2, len(two.codes))
        seams.append(np.concatenate([one.codes[max(0, keep - K + 1) : keep], two.codes[: min(take, K - 1)]]))
        bases.append((keep, take, max(0, keep - K + 1)))
    at = np.concatenate([[0], np.cumsum([len(x) for x in seams])]).astype(np.int64)
    across = anchors_of(np.concatenate(seams) if seams else np.zeros(0, np.uint64), at, whole=False)
    out = []
    for (one, two), seam, (keep, take, base), (places, hashes) in zip(pairs, seams, bases, across):
        if 0 < keep + take < K:
            places, hashes, base = *_short(seam), 0
        left, right = one.anchors[0] + K <= keep, two.anchors[0] + K <= take
        edited = (np.concatenate([one.anchors[0][left], places + base, two.anchors[0][right] + keep]), np.concatenate([one.anchors[1][left], hashes, two.anchors[1][right]]))
        digest = hashlib.sha256(one.raw[: one.byte(keep)])
        digest.update(two.raw[: two.byte(take)])
        out.append((one.id, len(one.codes), digest.hexdigest(), fingerprint(*one.anchors), fingerprint(*edited), likeness(one.anchors[1], edited[1]), likeness(one.anchors[1], two.anchors[1])))
    return out


def _texts(ids: list, raw: np.ndarray, at: np.ndarray) -> list[_Text]:
    codes = Codes(raw, at)
    anchors = anchors_of(codes.codes, codes.at)
    data, out = raw.tobytes(), []
    for i, found in enumerate(anchors):
        own = slice(codes.at[i], codes.at[i + 1])
        out.append(_Text(ids[i], data[at[i] : at[i + 1]], codes.codes[own], codes.start[own] - at[i], found))
    return out


OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _stream(kind: pa.DataType):
    """Results of blocks of documents (doc_id, block, ahead, text) in order; ``ahead`` marks the copy that ends a block."""
    types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches):
        held, block = None, None
        for batch, raw, at in text_blocks(batches):
            blocks, ahead = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            pairs = []
            for text, b, last in zip(_texts(batch.column(0).to_pylist(), raw, at), blocks, ahead):
                if held is not None:
                    if b != block:
                        raise ValueError("documents were read in another order the second time: write them to a table first")
                    pairs.append((held, text))
                held, block = (None if last else text), b
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*compare(pairs)), types)], list(OUT))
        if held is not None:
            raise ValueError("documents were read in another order the second time: write them to a table first")

    return run


def _first_of_blocks(block_bytes: int):
    """The order of the first document of each block, from sorted (missing, id, tie, row, cost)."""
    def run(batches):
        room = 0
        for batch in batches:
            cost = np.cumsum(batch.column(4).to_numpy())
            at, done = 0, 0
            keep = []
            while at < len(cost):
                if room <= 0:
                    keep.append(at)
                    room = block_bytes
                end = int(np.searchsorted(cost, done + room, side="left"))  # the document with which the block is full
                if end >= len(cost):
                    room -= int(cost[-1]) - done
                    break
                room, done, at = 0, int(cost[end]), end + 1
            if keep:
                yield batch.take(pa.array(keep)).select([0, 1, 2, 3])

    return run


class _Cuts:
    """The block of each document: how many blocks begin at or before it."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)
        self.ids = [np.array([r[1] for r in self.rows if r[0] == missing], np.int64) for missing in (0, 1)]

    def __call__(self, missing: np.ndarray, ids: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.int64)
        for m in (0, 1):
            here = np.flatnonzero(missing == m)
            lo, hi = (np.searchsorted(self.ids[m], ids[here], side=s) for s in ("left", "right"))
            out[here] = lo + (len(self.ids[0]) if m else 0)
            for i in here[lo < hi].tolist():  # ids with which a block begins
                out[i] = bisect.bisect_right(self.rows, (m, int(ids[i]), int(tie[i]), int(row[i])))
        return out - 1

    def begins(self, block: int, key: tuple) -> bool:
        return self.rows[block] == key


def _deal(cuts, kind: pa.DataType):
    """(doc_id, missing, id, tie, row, block, ahead, text): documents in their blocks, the first of each also at the end of the one before."""
    names = ["doc_id", "missing", "id", "tie", "row", "text"]

    def run(batches):
        table = cuts.value
        for batch in batches:
            missing, ids, tie, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            block = table(missing, ids, tie, row)

            def out(part, blocks, ahead):
                columns = {n: part.column(i) for i, n in enumerate(names)} | {"block": pa.array(blocks), "ahead": pa.array(np.full(len(blocks), ahead))}
                return pa.RecordBatch.from_arrays([columns[c] for c in ("doc_id", "missing", "id", "tie", "row", "block", "ahead", "text")], ["doc_id", "missing", "id", "tie", "row", "block", "ahead", "text"])

            yield out(batch, block, False)
            first = [i for i in range(len(block)) if table.begins(block[i], (int(missing[i]), int(ids[i]), int(tie[i]), int(row[i])))]
            if first:
                yield out(batch.take(pa.array(first)), (block[first] - 1) % len(table.rows), True)

    return run


def _order(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNull().cast("int").alias("missing"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row")]


@tidy
def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document (whole numbers as ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = ["missing", "id", "tie", "row"]
    keys = materialize(docs.select(*_order(doc_id, text), (F.octet_length(text) + 64).cast("long").alias("cost")), "keys")
    total = keys.agg(F.sum("cost")).first()[0] or 0
    block_bytes = max(block_bytes, total // MOST_BLOCKS)
    first = keys.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_first_of_blocks(block_bytes), "missing int, id long, tie long, row long")
    cuts = [tuple(r) for r in first.collect()]  # one document a block, MOST_BLOCKS and one a partition at most
    discard(keys)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, missing int, id long, tie long, row long, block long, ahead boolean, text string"
    held = spark.sparkContext.broadcast(_Cuts(cuts))
    arrow = pa.int32() if kind == "int" else pa.int64()
    dealt = docs.select(doc_id.alias("doc_id"), *_order(doc_id, text), text.alias("text")).mapInArrow(_deal(held, arrow), schema)
    dealt = dealt.repartitionById(max(1, len(cuts)), F.col("block").cast("int")).sortWithinPartitions("block", "ahead", *by).select("doc_id", "block", "ahead", "text")
    return dealt.mapInArrow(_stream(arrow), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, raw, at in text_blocks(batches):
            codes = Codes(raw, at)
            listed = [fingerprint(*x) for x in anchors_of(codes.codes, codes.at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(codes.at)), pa.array(listed, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")
