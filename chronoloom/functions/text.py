"""Text similarity as Column expressions; sets and counts stay inside a row, so nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def grams(text: Column, n: int = 2) -> Column:
    """Character n-grams of the text without white space; a shorter text is one gram, an empty one none."""
    # the cleaned text is one value of a list, so it is made once and not for each gram
    made = F.transform(F.array(F.regexp_replace(text, r"(?U)\s+", "")), lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    return made[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def normalize_for_distance(c: Column) -> Column:
    """Without tags, in lower case, only digits, letters a-z and Chinese characters."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")), "[^0-9a-z一-鿿]", "")


def tokenize_for_distance(c: Column) -> Column:
    """A token for each Chinese character and each run of digits and letters."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")), F.lit("[一-鿿]|[0-9a-z]+"), F.lit(0))


def char_error_rate(hypothesis: Column, reference: Column, most_cells: int | None = 80_000_000) -> Column:
    """Edit distance over the reference's length; null without a reference or where the two have more cells than ``most_cells`` (None: no bound)."""
    h, r = normalize_for_distance(hypothesis), normalize_for_distance(reference)
    small = F.lit(True) if most_cells is None else F.length(h).cast("long") * F.length(r) <= most_cells
    return F.when((F.length(r) > 0) & small, F.levenshtein(h, r) / F.length(r))


@F.pandas_udf(LongType())
def token_distance(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Edit distance of two lists of tokens."""
    return pd.Series([_distance(list(h), list(r)) for h, r in zip(hypothesis, reference)], dtype="Int64")


def _distance(a: list, b: list) -> int:
    number: dict = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a, b))
    if not len(x) or not len(y):
        return max(len(x), len(y))
    row, step = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, t in enumerate(x, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != t))])
        row = np.minimum.accumulate(best - step) + step  # insertions, all at once
    return int(row[-1])


def token_error_rate(hypothesis: Column, reference: Column) -> Column:
    h, r = tokenize_for_distance(hypothesis), tokenize_for_distance(reference)
    return F.when(F.size(r) > 0, token_distance(h, r) / F.size(r))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
