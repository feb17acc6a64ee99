"""PII: weak-supervision aggregation over candidate spans.

Candidates are matches of the base patterns, and long mixed tokens or digit groups that no pattern accepts. Labelers
(formats and checksums by pattern, gazetteers of words and endings, the words around a span, its shape) each vote for,
against or not at all. How often each combination of votes occurs is counted over the whole corpus; expectation
maximisation over this table of at most 3**LABELERS rows estimates how reliable each labeler is and how likely each
combination is personal data. These probabilities train the final span classifier, a logistic model over votes and
shape, on the same table. Base spans (below) are always found; other candidates are found when the classifier accepts.

Base, leftmost non-overlapping per kind: e-mail address, IP address with parts up to 255, card number of 16 to 19 digits
passing Luhn, phone number of 8 to 15 digits; failing matches are dropped without another try. Positions are code
points, ends exclusive.

Edge cases: null, empty and blank texts have no spans. Long runs of digits or letters are read once, not once per
start. Repeated rows are each answered. Empty tables give empty results. Extra columns are kept by ``find_personal_data``
where they don't clash with ``spans``, in upper or lower case.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import but_own, free_name, place_of, small_batches
from chronoloom.llm.words import raw_strings, string_column, text_blocks

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order in which they are listed after the base kinds.
ADDED = ("secret", "number")

# Gazetteers.
ENDINGS = frozenset(b"com org net edu gov io info biz de fr es uk eu us ch at it nl example".split())
SECRET_WORDS = frozenset(b"token secret password passwd pwd key apikey api_key access_key auth bearer credential credentials private".split())
PERSONAL_WORDS = frozenset(b"card visa account iban ssn id passport phone tel mobile call fax mail email contact".split())
CODE_WORDS = frozenset(b"version commit sha sha1 sha256 md5 hash build revision checksum digest uuid isbn".split())

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
_WORD_BEFORE = re.compile(rb"([A-Za-z0-9_]+)[^A-Za-z0-9_\n]{0,6}\Z")
_DIGIT = re.compile(rb"[0-9]")
_DIGITS, _LETTERS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = c - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: bytes) -> list[tuple[int, int]]:
    """Around each @: the longest local part before it that no earlier match has used, and its domain."""
    out, used, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            used = m.end()
            at = text.find(b"@", used)
        else:
            used = max(used, at + 1)  # no local part goes beyond an @
            at = text.find(b"@", at + 1)
    return out


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 3 or (len(part) == 3 and part <= b"255")


def _matches(text: bytes) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of the base patterns in bytes."""
    out = [("email", a, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            out.append(("ip", m.start(), m.end(), all(map(_small, m[0].split(b".")))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 9:
                digits = m[0].replace(b" ", b"").replace(b"-", b"")
                out.append(("card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
        for m in _PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 8 <= sum(48 <= c < 58 for c in m[0]) <= 15))
    return out


#: Labelers are taken to be right this often, with the weight of this share of their votes.
TRUSTED, TRUST = 0.9, 0.2
#: Names of the labelers, in the order of their votes.
LABELERS = ("format", "checksum", "gazetteer_near", "gazetteer_ending", "code_near", "quoted", "shape", "length")


def _votes(text: bytes, kind: str, start: int, end: int, passes: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 none."""
    span = text[start:end]
    near = _WORD_BEFORE.search(text[max(0, start - 40) : start])
    word = near[1].lower() if near else b""
    digits = len(span) - len(span.translate(None, _DIGITS))
    letters = len(span) - len(span.translate(None, _LETTERS))
    form = 1 if passes and kind in KINDS else 0
    check = 0
    if kind in ("card", "number"):
        check = 1 if passes else -1
    elif kind == "ip":
        check = 1 if passes else -1
    close = 1 if word in SECRET_WORDS or word in PERSONAL_WORDS else 0
    ending = (1 if span.rsplit(b".", 1)[-1].lower() in ENDINGS else -1) if kind == "email" else 0
    code = -1 if word in CODE_WORDS else 0
    quoted = 1 if start and text[start - 1] in b"\"'=:" and kind == "secret" else 0
    if kind == "secret":
        classes = Counter(span).values()
        varied = len(classes) >= 8 and digits >= 3 and letters >= 3 and max(classes) <= 0.25 * len(span)
        shape = 1 if varied else -1
    else:
        shape = 1 if digits >= 4 and kind != "number" else 0
    length = 0
    if kind in ("card", "phone"):
        length = 1
    elif kind == "number":  # a length alone makes no number personal
        length = 0 if 8 <= len(span.replace(b" ", b"").replace(b"-", b"")) <= 19 else -1
    elif kind == "secret":
        length = 1 if 20 <= len(span) <= 128 else -1
    return (form, check, close, ending, code, quoted, shape, length)


def candidates(text: bytes) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base, votes) in bytes; base spans first in their order, then the others by start."""
    found = _matches(text)
    out = [(k, a, b, True, _votes(text, k, a, b, True)) for k, a, b, ok in found if ok]
    taken = sorted((a, b) for _, a, b, base, _ in out)
    rest = [("number", a, b) for k, a, b, ok in found if not ok and k in ("card", "phone")]
    if _DIGIT.search(text):
        rest += [("secret", m.start(), m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and re.search(rb"[A-Za-z]", m[0])]
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    i, edge = 0, -1
    for k, a, b in sorted(rest, key=lambda x: (x[1], x[0])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= edge and not (i < len(taken) and taken[i][0] < b):
            out.append((k, a, b, False, _votes(text, k, a, b, False)))
            edge = b
    return sorted(out, key=lambda x: (order[x[0]], x[1]))


def _interesting(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts that hold a digit or an @; others have no candidates."""
    mark = ((raw >= 48) & (raw < 58)) | (raw == 64)
    total = np.concatenate([[0], np.cumsum(mark)])
    return np.flatnonzero(total[at[1:]] > total[at[:-1]])


def _count_votes(batches):
    counts: Counter = Counter()
    for _, raw, at in text_blocks(batches):
        for i in _interesting(raw, at).tolist():
            for kind, _, _, _, votes in candidates(raw[at[i] : at[i + 1]].tobytes()):
                counts[",".join(map(str, (kind, *votes)))] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


class SpanModel:
    """Reliabilities of labelers by expectation maximisation, and the span classifier trained on what they say."""

    def __init__(self, table: dict[tuple, int], rounds: int = 50):
        self.table = table
        patterns = sorted(table)
        votes = np.array([p[1:] for p in patterns], dtype=float).reshape(-1, len(LABELERS))
        n = np.array([table[p] for p in patterns], dtype=float)
        prob = np.full(len(n), 0.5) if not len(n) else 1 / (1 + np.exp(-votes.sum(axis=1)))  # the majority, to begin with
        self.reliability = np.full((len(LABELERS), 2), TRUSTED)  # of its votes on spans that aren't, that are personal
        for _ in range(rounds if len(n) else 0):
            log = np.zeros((len(n), 2))  # even odds before any vote
            for j in range(len(LABELERS)):
                spoke, agrees = votes[:, j] != 0, votes[:, j] > 0  # votes not given say nothing
                trust = TRUST * (n * spoke).sum() + 1
                for y, w in enumerate((n * (1 - prob) * spoke, n * prob * spoke)):
                    right = self.reliability[j, y] = ((w * (agrees == bool(y))).sum() + TRUSTED * trust) / (w.sum() + trust)
                    log[:, y] += np.where(spoke, np.log(np.where(agrees == bool(y), right, 1 - right)), 0)
            prob = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        self.probability = dict(zip(patterns, prob.tolist()))
        x = np.array([self.features(p) for p in patterns]).reshape(len(n), 1 + 2 * len(LABELERS) + len(KINDS) + len(ADDED))
        self.weights = _logistic(x, prob, n) if len(n) else None
        self.accepts = {p: bool(a) for p, a in zip(patterns, (x @ self.weights > 0) if len(n) else [])}

    @staticmethod
    def features(pattern: tuple) -> list[float]:
        kind, *votes = pattern
        return [1.0, *[float(v > 0) for v in votes], *[float(v < 0) for v in votes], *[float(kind == k) for k in (*KINDS, *ADDED)]]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w, n = np.zeros(x.shape[1]), n / n.max() * len(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * 0.1, x.T @ (n * (p - y)) + ridge * 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: DataFrame, text_col: str = "text") -> SpanModel:
    """From the votes of all candidates of all texts."""
    small_batches(texts.sparkSession)
    counts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_votes, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    table = {}
    for r in counts.collect():  # one row for each combination of votes
        kind, *votes = r["pattern"].split(",")
        table[(kind, *map(int, votes))] = r["n"]
    return SpanModel(table)


def _points(text: bytes, at: list[int]) -> list[int]:
    """Code points before each byte offset."""
    if text.isascii():
        return at
    b = np.frombuffer(text, np.uint8)
    total = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return total[at].tolist()


def spans_of(text: bytes, model: SpanModel) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind as listed, then start."""
    return [(k, a, b) for k, a, b, base, votes in candidates(text) if base or model.accepts.get((k, *votes), False)]


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with spans: array of (kind, start, end) in code points."""
    model = train(docs, text_col)
    keep = but_own(docs.columns if keep is None else list(keep), "spans")
    held = free_name(keep, "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", spans array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, raw, at in text_blocks(batches, held):
            out: list = [[] for _ in range(batch.num_rows)]
            for i in _interesting(raw, at).tolist():
                text = raw[at[i] : at[i + 1]].tobytes()
                found = spans_of(text, model)
                points = _points(text, [x for _, a, b in found for x in (a, b)])
                out[i] = [{"kind": k, "start": points[2 * j], "end": points[2 * j + 1]} for j, (k, _, _) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*keep, "spans"])

    return docs.select(*keep, F.col(text_col).cast("string").alias(held)).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; other texts stay as they are.

    Null texts stay null, texts that aren't valid UTF-8 keep their bytes outside spans, very long texts are read whole, rows that repeat are each
    cleaned. Empty tables give empty results; all columns are kept.
    """
    model = train(docs, text_col)
    at_col, names = place_of(docs, text_col), docs.columns

    def cleaned(text: bytes) -> bytes:
        # overlapping spans of several kinds become one, named after the first
        parts, edge = [], 0
        for k, a, b in sorted(spans_of(text, model), key=lambda s: (s[1], -s[2])):
            if a >= edge:
                parts += [text[edge:a], b"<" + k.encode() + b">"]
            edge = max(edge, b)
        return b"".join([*parts, text[edge:]])

    def run(batches):
        for batch, raw, at in text_blocks(batches, names[at_col]):
            column = batch.column(at_col)
            found = _interesting(raw, at).tolist()
            if found:
                texts = raw_strings(column)
                for i in found:
                    texts[i] = cleaned(texts[i])
                column = string_column(texts, column.type)
            yield pa.RecordBatch.from_arrays([column if i == at_col else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)
