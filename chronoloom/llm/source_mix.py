"""Mixing sources to target weights. DataFrame functions only.

Every document gets a hash-random key of its id and text. Within a source, documents stand in the order of their keys; prefix sums of their
sizes place them, and each source is cut at its exact budget: whole epochs first, then the beginning of one more, whose
last document gives only the words that are still missing.

Prefix sums are distributed over key ranges: FANOUT ranges of a source are summed up by an aggregation, a window over these few
sums finds the range that holds the cut, and that range alone is divided again, until no range with a cut holds more than
SORTED rows; only those rows are sorted. All other documents are told whole or left out by comparing their key with
their source's cut, so texts and whole documents are never shuffled, however large a source is. Rows that tie on the key are ordered by a number that each
row gets when the keys are written, and divided further by a hash of it.

Targets fill up by weight: a source stops at MOST_EPOCHS times its size and what it leaves is shared again by weight,
which is solved in closed form over the table of sources.

Edge cases: a null text has no words; a null source is a source, last in order; sources without words have target 0.
Repeated rows are documents of their own; which of several equal rows is cut is left open, the rows returned are the
same. Null ids are ids like others. Very long texts count whole. Empty tables give empty results. Extra columns are ignored,
or kept by ``mix_documents`` but for those of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import but_own, discard, materialize, tidy

MOST_EPOCHS = 3
#: Ranges into which a range of keys is divided, as a power of two; rows of a range that one task sorts.
FANOUT_BITS, SORTED = 12, 20_000
#: Bits of the key, and of the hash of a row's number that follows it.
KEY_BITS, ROW_BITS = 60, 60
SPACE = " \t\n\x0b\x0c\r"
OWN = ("size", "source_size", "target", "taken")
WHERE = ["no_source", "source_key"]


def count_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; null has none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def hash_key(id_: Column, text: Column, seed: int) -> Column:
    """A random number of KEY_BITS bits that follows from id and text: the beginning of their MD5 digest."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def fill_targets(sources: DataFrame, weights: int = 3) -> DataFrame:
    """(no_source, source_key, source_size, target) of sources (no_source, source_key, source_size); weights 1..weights repeat in order."""
    rank = F.row_number().over(Window.orderBy("no_source", "source_key"))
    cap = F.col("source_size") * MOST_EPOCHS
    table = sources.withColumn("weight", F.pmod(rank - 1, F.lit(weights)) + 1).withColumn("cap", cap).withColumn("level", cap / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("level", "no_source", "source_key")
    table = table.withColumns({
        "k": F.row_number().over(order),
        "total": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # the first source in this order that stays below its cap fixes what one unit of weight gets
    opens = F.col("cap") * F.col("open_weight") >= (F.col("total") - F.col("full")) * F.col("weight")
    table = table.withColumn("first", F.min(F.when(opens, F.struct("k", (F.col("total") - F.col("full")).alias("rest"), "open_weight"))).over(everything))
    target = F.when(F.col("k") < F.col("first.k"), F.col("cap").cast("double")).otherwise(F.col("first.rest") * F.col("weight") / F.col("first.open_weight"))
    return table.select("no_source", "source_key", "source_size", target.cast("double").alias("target"))


def _digit(level: int) -> Column:
    """The part of a row's order (key, then hash of its number) that divides a range of this level."""
    per_key = KEY_BITS // FANOUT_BITS
    column, level, bits = ("_key", level, KEY_BITS) if level < per_key else ("_salt", level - per_key, ROW_BITS)
    return F.shiftright(F.col(column), bits - FANOUT_BITS * (level + 1)).bitwiseAND((1 << FANOUT_BITS) - 1)


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(no_source, source_key, cut_key, cut_salt, cut_row, cut_rest) of sources: the row in which the last epoch ends, and the words it gives."""
    open_ = sources.select(*WHERE, (F.col("rest")).alias("left"), F.array().cast("array<long>").alias("path"))
    found, rows = None, sized.select(*WHERE, "_key", "_salt", "_row", "size")
    for level in range((KEY_BITS + ROW_BITS) // FANOUT_BITS + 1):
        inside = rows.join(open_, WHERE)
        for k in range(level):
            inside = inside.where(_digit(k) == F.col("path")[k])
        last = level * FANOUT_BITS >= KEY_BITS + ROW_BITS
        digit = F.lit(0).cast("long") if last else _digit(level)
        ranges = inside.groupBy(*WHERE, "left", "path", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy(*WHERE).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = ranges.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        hit = materialize(hit.select(*WHERE, (F.col("left") - F.col("upto") + F.col("words")).alias("left"), F.concat("path", F.array("digit")).alias("path"), "n"), "cut_ranges")
        few = hit.where("true" if last else f"n <= {SORTED}").drop("n")
        order = Window.partitionBy(*WHERE).orderBy("_key", "_salt", "_row").rowsBetween(Window.unboundedPreceding, -1)
        mine = rows.join(few, WHERE)
        for k in range(level + (not last)):
            mine = mine.where(_digit(k) == F.col("path")[k])
        mine = mine.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        at = (F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left"))
        mine = mine.where(at).select(*WHERE, F.col("_key").alias("cut_key"), F.col("_salt").alias("cut_salt"), F.col("_row").alias("cut_row"), (F.col("left") - F.col("before")).alias("cut_rest"))
        found = mine if found is None else found.union(mine)
        if last or hit.where(f"n > {SORTED}").isEmpty():
            return found
        open_ = hit.where(f"n > {SORTED}").drop("n")


@tidy
def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, after the columns named in ``keep``."""
    text, source = F.col(text_col), F.col(source_col)
    sized = docs.select(
        *keep, F.col(id_col).alias("_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key"), count_words(text).alias("size"),
        hash_key(F.col(id_col), text, seed).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    # the row's number is fixed by the written table
    sized = materialize(sized.withColumn("_salt", F.shiftrightunsigned(F.xxhash64("_row"), 64 - ROW_BITS)), "sized")
    sources = fill_targets(sized.groupBy(*WHERE).agg(F.sum("size").alias("source_size")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "sources")
    cuts = materialize(_cuts(sized, sources.where("rest > 0")), "cuts")
    placed = sized.join(materialize(sources.join(cuts, WHERE, "left"), "source_cuts"), WHERE)
    discard(cuts, sources)
    mine, cut = F.struct("_key", "_salt", "_row"), F.struct(F.col("cut_key").alias("_key"), F.col("cut_salt").alias("_salt"), F.col("cut_row").alias("_row"))
    more = F.when(F.col("cut_key").isNull() | (mine > cut), F.lit(0).cast("long")).when(mine < cut, F.col("size")).otherwise(F.col("cut_rest"))
    return placed.select(*keep, F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and taken; columns of these names, in any case, are replaced."""
    held = F.struct(*but_own(docs.columns, *OWN)).alias("_held")
    mixed = mix_sources(docs.select(held, F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source")), "_doc", "_text", "_source", seed, ("_held",))
    return mixed.select("_held.*", *OWN)
