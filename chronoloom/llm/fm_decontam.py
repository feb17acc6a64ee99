"""Benchmark decontamination: an FM-index per shard of documents, searched for every benchmark window.

A shard is a block of whole texts inside a task. Its words are numbered by the benchmark's vocabulary; words outside
it, and runs too short to hold the shortest window, can't be part of an occurrence and become separators. Over the
remaining sequence stand a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix with
block ranks, and sampled suffix positions. All windows are searched backwards at once; occurrences are located by
walking to sampled positions; overlapping ones merge into removal spans of words.

The benchmark is the query set. Its items are cut into overlapping pieces of PIECE words, and these by a hash into blocks of about
BLOCK_BYTES of text, so neither one long item nor items without an id make a block large. One block at a time is
broadcast and searched in all documents, and its hits are written; only rows with hits are merged afterwards. With one
block, the usual case, documents aren't shuffled. A shard searches only windows all of whose words it holds.

Edge cases: null, empty or blank texts have no words, no hits and no items; items without words are never hit; an item
shorter than a window is one window. Repeated rows are each answered; repeated items count by their distinct ids, a
null item id counts as an item written as an empty string. Very long texts are a shard of their own; texts need not be valid UTF-8.
Empty tables give empty results or no hits. Extra columns of documents are kept where they don't clash with the operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, free_name, materialize, numbered_columns, place_of, small_batches, tidy
from chronoloom.llm.words import PLAIN, ShardWords, Words, raw_strings, string_column, text_buffers, text_blocks

#: Bytes of benchmark text in a block, and words in a piece of an item.
BLOCK_BYTES, PIECE = 4 << 20, 20_000
SAMPLE = 8
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


class WaveletMatrix:
    """Symbols below 2**bits with rank and access by vectors of positions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.levels.append((packed, before))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        packed, before = self.levels[level]
        word = i >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        lo = np.zeros_like(i)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            a, b = self._ones(k, lo), self._ones(k, i)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for k in range(self.bits):
            packed, _ = self.levels[k]
            one = ((packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            symbol = symbol * 2 + one
            a = self._ones(k, i)
            i = np.where(one, self.zeros[k] + a, i - a)
        return symbol


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling."""
    n, width = len(ranks), 1
    _, rank = np.unique(ranks, return_inverse=True)
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """Over a sequence of symbols from 1 on; 0 separates runs. Patterns never hold a 0."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        seq = np.concatenate([[0], seq, [0]])
        n = len(seq)
        gaps = np.flatnonzero(seq == 0)
        ranks = seq + len(gaps)
        ranks[gaps] = np.arange(len(gaps))  # separators differ, so common prefixes end with their run
        order = suffix_array(ranks)
        bwt = seq[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))])
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols).bit_length()))
        sampled = order % SAMPLE == 0
        sampled |= bwt == 0  # starts of runs: a walk never crosses a separator
        self.sampled, self.slot, self.position = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) in suffix order for each row of patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a, b = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows in suffix order."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.position[self.slot[at[done]]] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            steps[open_] += 1
            c = self.tree.access(at)
            at = self.first[c] + self.tree.rank(c, at)
        return out - 1  # the leading separator


class Windows:
    """The distinct windows of a block of pieces of benchmark items, as arrays."""

    def __init__(self, items: list[str], words: Words, size: int):
        names = sorted(set(items))
        number = {item: i for i, item in enumerate(names)}
        self.items = np.empty(len(names), object)
        self.items[:] = names
        owner = np.array([number[item] for item in items], np.int64)
        self.hashes, ids = np.unique(words.hash, return_inverse=True)
        ids = (ids + 1).astype(np.int32)
        n = np.diff(words.at)
        #: (length, distinct windows as rows of word numbers, where the owners of each begin, owners)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(n[n > 0], size)).tolist():
            mine = np.flatnonzero(n >= size) if length == size else np.flatnonzero(n == length)
            count = n[mine] - length + 1
            first = np.repeat(words.at[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows, own = ids[first[:, None] + np.arange(length)], np.repeat(owner[mine], count)
            order = np.lexsort((own, *rows.T[::-1]))
            rows, own = rows[order], own[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            again = np.zeros(len(rows), bool)  # an item that repeats a window owns it once
            again[1:] = ~new[1:] & (own[1:] == own[:-1])
            which = np.cumsum(new) - 1
            at = np.searchsorted(which[~again], np.arange(new.sum() + 1))
            self.groups.append((length, rows[new], at, own[~again]))
        self.shortest = min((g[0] for g in self.groups), default=0)
        self.n_symbols = len(self.hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        out[maybe] = np.where(self.hashes[at] == h[maybe], at + 1, 0) if len(self.hashes) else 0
        return out

    def occurrences(self, words: Words | ShardWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit flag of each word, then texts and items that occur in them, each pair once)."""
        hit, none = np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int64)
        if not self.groups or not len(words):
            return hit[:-1].astype(bool), none, none
        ids = self.number(words.hash)
        inside = ids > 0
        begin = np.zeros(len(ids) + 1, bool)
        begin[words.at] = True
        first = inside & (np.concatenate([[True], ~inside[:-1]]) | begin[:-1])
        last = inside & (np.concatenate([~inside[1:], [True]]) | begin[1:])
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return hit[:-1].astype(bool), none, none
        n = b - a + 1  # each run and a separator after it
        start = np.cumsum(n) - n
        where = np.repeat(a - start, n) + np.arange(n.sum())
        seq = ids[np.minimum(where, len(ids) - 1)]
        seq[start + n - 1] = 0
        present = np.zeros(self.n_symbols + 1, bool)
        present[seq] = True
        index, pairs = None, [np.zeros((2, 0), np.int64)]
        for length, patterns, owner_at, owners in self.groups:
            likely = np.flatnonzero(present[patterns].all(axis=1))
            if not len(likely):
                continue
            index = index or FMIndex(seq, self.n_symbols)
            lo, hi = index.search(patterns[likely])
            count = hi - lo
            rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = where[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            text = np.searchsorted(words.at, at, side="right") - 1
            found = np.unique(np.stack([text, np.repeat(likely, count)]), axis=1)
            times = owner_at[found[1] + 1] - owner_at[found[1]]
            owned = np.repeat(owner_at[found[1]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pairs.append(np.stack([np.repeat(found[0], times), owners[owned]]))
        text, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return np.cumsum(hit[:-1]) > 0, text, item


def _spans(hit: np.ndarray, words: ShardWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of maximal runs of hit words, counted from a text's first word."""
    begin = np.zeros(len(hit) + 1, bool)
    begin[words.at] = True
    before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
    after = np.concatenate([hit[1:], [False]]) if len(hit) else hit
    first, last = np.flatnonzero(hit & (~before | begin[:-1])), np.flatnonzero(hit & (~after | begin[1:]))
    text = np.searchsorted(words.at, first, side="right") - 1
    return text, first - words.at[text], last + 1 - words.at[text]


def _cut(raw: bytes, spans: list[tuple[int, int]], first: np.ndarray, last: np.ndarray) -> bytes:
    """The text without its removal spans, from the first byte of a span's first word to the last of its last."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : first[a]])
        at = last[b - 1]
    return b"".join([*parts, raw[at:]])


OWN = ("n_words", "removal_spans", "item_ids")
_SPANS = "array<struct<start: long, end: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values listed by the sorted numbers 0..n-1 that they belong to."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _found(windows: Windows, words: ShardWords) -> tuple[pa.Array, pa.Array]:
    """(removal spans, items) of each text of a shard."""
    n, (hit, text, item) = len(words.at) - 1, windows.occurrences(words)
    of, start, end = _spans(hit, words)
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
    return _lists(of, n, spans), _lists(text, n, pa.array(windows.items[item].tolist(), pa.string()))


def _search(windows, keep: list[str], text_col: str):
    """Each row with n_words, spans and items of one block of windows."""
    def run(batches):
        for part, raw, at in text_blocks(batches, text_col, SHARD_BYTES):
            words = ShardWords(raw, at, PLAIN)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(np.diff(words.at), pa.int64()), *_found(windows.value, words)], [*keep, *OWN])

    return run


def _pieces(item_col: str, text_col: str, size: int):
    """(item, block, words) of items cut into pieces that share size - 1 words, words joined by line feeds."""
    def run(batches):
        for batch, raw, at in text_blocks(batches, text_col, 1 << 19):
            words, items = Words(raw, at, PLAIN), batch.column(batch.schema.get_field_index(item_col)).to_pylist()
            low, out = words.low.tobytes(), ([], [])
            for i, (lo, hi) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist())):
                for first in range(lo, max(lo + 1, hi - size + 1), PIECE) if lo < hi else ():
                    last = min(hi, first + PIECE + size - 1)
                    out[0].append(items[i])
                    out[1].append(b"\n".join(low[a:b] for a, b in zip(words.start[first:last].tolist(), words.end[first:last].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), string_column(out[1], pa.string())], ["item", "words"])

    return run


def _blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(the pieces of the benchmark's items with the number of their block, number of blocks)."""
    pieces = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("words"))
    pieces = materialize(pieces.mapInArrow(_pieces("item", "words", size), "item string, words string"), "pieces")
    n = max(1, -(-(pieces.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0) // BLOCK_BYTES))
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))), n


def _windows(pieces: DataFrame, block: int, size: int) -> Windows:
    """Of one block, which is BLOCK_BYTES of text about."""
    rows = pieces.where(F.col("block") == block).select("item", "words").toArrow()
    raw, at = text_buffers(rows.column("words")) if rows.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return Windows(rows.column("item").to_pylist(), Words(raw, at, PLAIN), size)


def _ddl(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def _merge(docs: DataFrame, row: str, pieces: DataFrame, n_blocks: int, size: int, text_col: str) -> DataFrame:
    """(row, removal_spans, item_ids) of the rows that any block hits: each block's hits are a table, then hits of a row are merged."""
    parts = None
    for block in range(n_blocks):
        windows = docs.sparkSession.sparkContext.broadcast(_windows(pieces, block, size))
        found = docs.select(row, text_col).mapInArrow(_search(windows, [row], text_col), f"`{row}` long, n_words long, removal_spans {_SPANS}, item_ids array<string>")
        part = materialize(found.where(F.size("removal_spans") > 0).drop("n_words"), "hits")
        windows.destroy()
        parts = part if parts is None else parts.unionByName(part)
    all_spans = F.array_sort(F.flatten(F.collect_list("removal_spans")))
    start = F.array().cast(_SPANS)

    def joined(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), longer).otherwise(F.concat(acc, F.array(s)))

    rows = parts.groupBy(row).agg(all_spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return rows.select(row, F.aggregate("spans", start, joined).alias("removal_spans"), "item_ids")


@tidy
def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, removal_spans (array of word ranges) and item_ids (items with occurring windows)."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces, n_blocks = _blocks(benchmark, size, item_col, item_text_col)
    docs = docs.drop(*OWN)
    own = f"n_words long, removal_spans {_SPANS}, item_ids array<string>"
    if n_blocks == 1:
        windows = spark.sparkContext.broadcast(_windows(pieces, 0, size))
        return docs.mapInArrow(_search(windows, docs.columns, text_col), _ddl(docs, docs.columns) + own)
    row, keep = free_name(docs.columns, "_row"), docs.columns
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = materialize(_merge(docs, row, pieces, n_blocks, size, text_col), "merged")
    nothing = spark.sparkContext.broadcast(Windows([], Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), PLAIN), size))
    counted = docs.mapInArrow(_search(nothing, docs.columns, text_col), _ddl(docs, docs.columns) + own).drop("removal_spans", "item_ids")
    none = [F.coalesce("removal_spans", F.array().cast(_SPANS)).alias("removal_spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")]
    return counted.join(hits, row, "left").select(*keep, "n_words", *none)


def _cutter(names: list[str], text_col: str, windows=None):
    """Rows without the spans that the windows hit, or that the column ``removal_spans`` lists."""
    at = names.index(text_col)

    def run(batches):
        for part, raw, ends in text_blocks(batches, text_col, SHARD_BYTES):
            words, column = ShardWords(raw, ends, PLAIN), part.column(part.schema.get_field_index(text_col))
            if windows is not None:
                of, start, end = _spans(windows.value.occurrences(words)[0], words)
                spans: dict[int, list[tuple[int, int]]] = {}
                for i, a, b in zip(of.tolist(), start.tolist(), end.tolist()):
                    spans.setdefault(i, []).append((a, b))
            else:
                listed = part.column(part.schema.get_field_index("removal_spans")).to_pylist()
                spans = {i: [(s["start"], s["end"]) for s in x] for i, x in enumerate(listed) if x}
            if spans:
                texts = raw_strings(column)
                for i, mine in spans.items():
                    own = slice(words.at[i], words.at[i + 1])
                    texts[i] = _cut(texts[i], mine, words.start[own] - ends[i], words.end[own] - ends[i])
                column = string_column(texts, column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else part.column(part.schema.get_field_index(c)) for i, c in enumerate(names)], names)

    return run


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` with the merged removal spans cut out of their texts; clean texts stay as they are.

    Null texts stay null; a text that is hit as a whole becomes what stands around its words. All columns are kept; a column
    called removal_spans stays as it is. Empty tables give empty results or unchanged rows.
    """
    spark, names, text = docs.sparkSession, docs.columns, f"c{place_of(docs, text_col)}"
    small_batches(spark)
    pieces, n_blocks = _blocks(benchmark, size, "item_id", "text")
    docs = numbered_columns(docs)
    if n_blocks == 1:
        windows = spark.sparkContext.broadcast(_windows(pieces, 0, size))
        discard(pieces)
        return docs.mapInArrow(_cutter(docs.columns, text, windows), docs.schema).toDF(*names)
    held = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    hits = materialize(_merge(held, "row", pieces, n_blocks, size, text), "merged")
    marked = held.join(hits.select("row", "removal_spans"), "row", "left").select(*docs.columns, "removal_spans")
    return marked.mapInArrow(_cutter(docs.columns, text), docs.schema).toDF(*names)
