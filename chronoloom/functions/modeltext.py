"""Text that models write: JSON inside other text, control characters, full-width marks, thoughts, labels of ids.

What needs a scan by character runs in Pandas functions over Arrow batches; everything else is a Column expression.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoloom.functions.scalars import clean_text

# Markers of a log that tells of a cut input.
TRUNCATED = ("input truncated", "truncated: n_ctx", "exceeds the context")
#: Full-width characters lie so far behind their ASCII forms.
WIDE_FIRST, WIDE_LAST, WIDE = "！", "～", 0xFEE0
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[^"]+', re.S)


def _each(function):
    """A Pandas function of one text column; null stays null."""
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(function, na_action="ignore")

    return run


def _escaped(part: str) -> str:
    return re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", part)


def escape_controls_text(text: str) -> str:
    """Control characters inside JSON strings, written as escapes."""
    return "".join(_escaped(p) if p.startswith('"') else p for p in _PARTS.findall(text))


def _narrow(part: str) -> str:
    return "".join(" " if c == "\u3000" else chr(ord(c) - WIDE) if WIDE_FIRST <= c <= WIDE_LAST else c for c in part)


def ascii_marks_text(text: str) -> str:
    """Full-width characters outside JSON strings become ASCII."""
    return "".join(p if p.startswith('"') else _narrow(p) for p in _PARTS.findall(text))


_BRACES = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S)


def first_object_text(text: str) -> str | None:
    """The first ``{`` from which braces outside strings balance, up to where they do."""
    start = text.find("{")
    while start >= 0:
        depth = 0
        for m in _BRACES.finditer(text, start):
            depth += (m[0] == "{") - (m[0] == "}")
            if not depth:
                return text[start : m.end()]
        start = text.find("{", start + 1)
    return None


escape_controls = _each(escape_controls_text)
ascii_marks = _each(ascii_marks_text)
first_object = _each(first_object_text)
normal_form = _each(lambda t: unicodedata.normalize("NFKC", t).strip())


def without_thoughts(c: Column) -> Column:
    """The text behind the end of its thoughts, or all of it if it has none."""
    t = F.btrim(c, F.lit(" \n\r\t"))
    return F.when(F.contains(t, F.lit("</think>")), F.btrim(F.regexp_replace(t, r"(?s)^.*?</think>", ""), F.lit(" \n\r\t"))).otherwise(t)


def thoughts(c: Column) -> Column:
    """What stands before the end of the thoughts, with or without a tag that opens them."""
    t = F.regexp_extract(F.btrim(c, F.lit(" \n\r\t")), r"(?s)^(.*?)</think>", 1)
    return F.btrim(F.regexp_replace(t, "^<think>", ""), F.lit(" \n\r\t"))


def unclosed_thoughts(c: Column) -> Column:
    return F.btrim(c, F.lit(" \n\r\t")).startswith("<think>") & ~F.contains(c, F.lit("</think>"))


def without_fence(c: Column) -> Column:
    """Without the lines of a code fence around the text."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(c, F.lit(" \n\r\t")), r"^```[A-Za-z0-9_-]*[ \t]*\r?\n", ""), r"\r?\n```\s*$", ""), F.lit(" \n\r\t"))


def widest_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def parsed(c: Column, schema: str) -> Column:
    """A JSON object, as it stands or after control characters in its strings are escaped; null if it is none."""
    return F.coalesce(F.from_json(F.when(c.rlike(r"^\s*\{"), c), schema, {"allowUnquotedControlChars": "true"}))


def reports_truncation(c: Column) -> Column:
    found = F.lit(False)
    for t in TRUNCATED:
        found = found | F.contains(F.lower(c), F.lit(t))
    return found


# How a turn and a chapter of a version may be written.
TURN_LABEL = r"(?i)^(?:(\d+)|\[?\s*turn\s*[:#_-]?\s*0*(\d+)\s*\]?)$"
CHAPTER_ID = r"(?i)^v0*(\d+)-chapter-?0*(\d+)$"


def turn_numbers(labels: Column) -> Column:
    """Numbers of turns given as digits or as ``[turn 0012]``, each once, in order; other labels stay as they are, as text."""
    def one(x: Column) -> Column:
        t = F.btrim(x)
        number = F.concat(F.regexp_extract(t, TURN_LABEL, 1), F.regexp_extract(t, TURN_LABEL, 2))
        return F.when(number != "", number.cast("long").cast("string")).otherwise(x)

    return F.array_distinct(F.transform(labels, one))


def source_ids(ids: Column) -> Column:
    """``v01-chapter03`` becomes ``v1-chapter-3``; each once, in order."""
    return F.array_distinct(F.transform(ids, lambda x: F.regexp_replace(F.btrim(x), CHAPTER_ID, "v$1-chapter-$2")))


def refs_in(text: Column) -> Column:
    """Segment ids that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"seg-\d{6}"), F.lit(0)))


def bullet_list(items: Column, most: int) -> Column:
    """Cleaned items, each once, in order, up to a number of them."""
    return F.slice(F.array_distinct(F.array_compact(F.transform(items, clean_text))), 1, most)
