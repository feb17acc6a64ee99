"""Conversation prefix trie: which conversations begin alike, as a tree of shared prefixes.

Every prefix of a conversation has a digest: the exclusive or of the hashes of its turns, each with its place (two lanes of 64 bits).
It is a running total over range partitions, so a conversation of any length is split. The owner of a prefix is the smallest
conversation that has it. A conversation that owns a prefix owns all its longer ones, so a binary search finds its first owned
depth: in each round all conversations that are still open probe one depth, in one join of their digests with the minima of all prefixes.

What a conversation owns is a chain of nodes; the chain hangs on the node before it, which another conversation owns (the smallest of
all owns the root). Totals go up this tree of chains by doubling: in round k every conversation hands its totals to its
ancestor 2**k chains above, so even a path of chains takes a logarithm of its length. Along a chain they are running totals
from its end. What a node needs follows from those of the conversations that hang on its chain from it on: members, leaves, words of
all members, and words of all nodes.

Edge cases: null roles and texts are empty. Turns without a number come first; turns that tie are ordered by role, then by the
digest of role and text; repeated rows are turns of their own. Rows without conv_id form one conversation, behind all others, whose id is null.
A conversation whose rebuilt form has no turns is a member of the root. Empty tables give empty results. Extra columns are ignored. Very long texts are read whole.
Turns are compared by 120 bits of MD5, prefixes by 128 bits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, scratch_tables, tidy
from chronoloom.llm.source_mix import count_words
from chronoloom.operators.scan import running

#: Turns of a conversation that meet its other facts in one key.
BLOCK = 4096
NO_ID = 2**63 - 1
#: Conversations that take their first turns from one of them, and at most so many less one turns.
FAMILY, TURNS = 20, 4
TOTALS = ("members", "leaves", "words", "node_words")


def _lane(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK)


def _taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % TURNS, F.lit(0)).cast("long")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (c, n), turns (c, depth, t1, t2, w)): each with its first turns from the first conversation of its family.

    The facts of a conversation meet its turns in blocks of BLOCK turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c"), "turn", role.alias("role"), digest.alias("digest"), count_words(text).alias("w"))
    turns = turns.select("c", "turn", "role", _lane(F.col("digest"), 1).alias("t1"), _lane(F.col("digest"), 16).alias("t2"), "w")
    placed = running(turns, ["c"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t1").asc(), F.col("t2").asc()], count=True, write=materialize, name="placed").drop("turn", "role")
    head = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("depth"), "t1", "t2", "w")))  # TURNS - 1 turns at most
    heads = placed.where((F.col("c") % FAMILY == 0) & (F.col("pos") < TURNS)).groupBy(F.col("c").alias("first")).agg(head.alias("head"))
    known = F.col("c") != NO_ID
    talks = placed.groupBy("c").agg(F.max("pos").alias("own")).withColumns({"first": F.when(known, F.col("c") - F.col("c") % FAMILY), "h": F.when(known, _taken(F.col("c"))).otherwise(F.lit(0).cast("long"))})
    talks = talks.join(heads, "first", "left").withColumn("head", F.filter(F.coalesce("head", F.array().cast("array<struct<depth: long, t1: long, t2: long, w: long>>")), lambda t: t["depth"] <= F.col("h")))
    took = F.size("head").cast("long")
    talks = materialize(talks.select("c", "own", "h", "head", (F.col("h") - took).alias("shift"), (took + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "talks")
    # only conversations that take fewer turns than they drop move the rest of theirs
    shifts = talks.where("shift > 0 and own > h").select("c", "shift", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK))).alias("block"))
    rest = placed.where(F.col("pos") > F.when(F.col("c") != NO_ID, _taken(F.col("c"))).otherwise(0)).withColumn("block", _block("pos")).join(shifts, ["c", "block"], "left")
    rest = rest.select("c", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("depth"), "t1", "t2", "w")
    taken = talks.select("c", F.explode("head").alias("t")).select("c", "t.depth", "t.t1", "t.t2", "t.w")
    return talks.select("c", "n"), rest.unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, w, x1, x2, upto): digests of the prefixes of turns, and their words."""
    z = [F.xxhash64(F.lit(lane), "depth", "t1", "t2").alias(f"z{lane}") for lane in (1, 2)]
    return running(turns.select("c", "depth", "w", *z), ["c"], [F.col("depth").asc()], {"upto": "w"}, {"x1": "z1", "x2": "z2"}, write=materialize, name="prefixes").drop("z1", "z2")


def first_owned(talks: DataFrame, found: DataFrame) -> DataFrame:
    """(c, n, first, owner): the first depth that each conversation owns (n + 1: none), and who owns the one before.

    Binary search: depths from ``first`` to ``last`` are open; each round probes the middle of all open conversations in one join.
    """
    minima = materialize(found.groupBy("depth", "x1", "x2").agg(F.min("c").alias("min_c")), "minima")
    root, longest = talks.agg(F.min("c"), F.max("n")).first()
    whole = talks.where(F.col("c") == root).select("c", "n", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("owner"))
    open_ = talks.where(F.col("c") != root).select("c", "n", F.lit(1).cast("long").alias("first"), (F.col("n") + 1).alias("last"), F.lit(root).cast("long").alias("owner"))
    done = [whole]
    for _ in range(int(longest or 0).bit_length()):  # of n + 1 answers half are left each round
        done.append(open_.where("first >= last").select(*whole.columns))
        probe = open_.where("first < last").withColumn("depth", F.floor((F.col("first") + F.col("last")) / 2).cast("long")).join(found.select("c", "depth", "x1", "x2"), ["c", "depth"]).join(minima, ["depth", "x1", "x2"])
        own = F.col("min_c") == F.col("c")
        open_ = materialize(probe.select("c", "n", F.when(own, F.col("first")).otherwise(F.col("depth") + 1).alias("first"), F.when(own, F.col("depth")).otherwise(F.col("last")).alias("last"), F.when(own, F.col("owner")).otherwise(F.col("min_c")).alias("owner")), "open")
    done.append(open_.select(*whole.columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out, "chains")


def subtree_totals(rows: DataFrame, columns: tuple[str, ...] = TOTALS) -> DataFrame:
    """Rows (c, up, columns): totals of each row and all below it in the tree of ``up`` (null: a root), by doubling."""
    now = rows
    while True:
        handed = now.where("up is not null").groupBy(F.col("up").alias("c")).agg(*[F.sum(x).alias(f"more_{x}") for x in columns])
        higher = now.where("up is not null").select(F.col("c").alias("up"), F.col("up").alias("next"))
        after = now.join(handed, "c", "left").join(higher, "up", "left")
        after = materialize(after.select("c", F.col("next").alias("up"), *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in columns]), "totals")
        now = after
        if now.where("up is not null").isEmpty():
            return now.select("c", *columns)


def _ends(batches):
    """(c, depth, ends) of rows (c, depth, member) sorted by them: the digest of the members' ids, streamed."""
    open_, digest, out = None, None, ([], [], [])

    def close():
        if open_ is not None:
            for column, value in zip(out, (*open_, digest.hexdigest())):
                column.append(value)

    for batch in batches:
        for c, depth, member in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, depth) != open_:
                close()
                open_, digest = (c, depth), hashlib.sha256()
            elif member != NO_ID:
                digest.update(b",")
            if member != NO_ID:
                digest.update(str(member).encode())
        if len(out[0]) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["c", "depth", "ends"])
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["c", "depth", "ends"])


@tidy
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    with scratch_tables(conversations.sparkSession):
        talks, turns = rebuild(conversations)
        found = prefixes(turns)
        chains = first_owned(talks, found)
        # what hangs where: chains and, below the last depth that another owns, conversations without one
        hangs = chains.where("owner is not null").select("c", F.col("owner"), (F.col("first") - 1).alias("depth"), (F.col("first") <= F.col("n")).alias("chain"))
        kids = materialize(hangs.where("chain").groupBy(F.col("owner").alias("c"), "depth").agg(F.count("*").alias("kids")), "kids")
        blocks = chains.select("c", "n", "first", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
        lines = materialize(found.withColumn("block", _block("depth")).join(blocks, ["c", "block"]).select("c", "depth", "w", "upto", "n", "first", "owner"), "lines")
        words = lines.groupBy("c").agg(F.sum("w").alias("words"), F.sum(F.when(F.col("depth") >= F.col("first"), F.col("w")).otherwise(0)).alias("node_words"))
        last = kids.select("c", F.col("depth").alias("n"), F.lit(0).alias("inner"))
        own = (F.col("first") <= F.col("n")) | F.col("owner").isNull()
        each = chains.join(words, "c", "left").join(last, ["c", "n"], "left").select(
            "c", F.col("owner").alias("up"), F.lit(1).cast("long").alias("members"), F.when(own & F.col("inner").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("node_words", F.lit(0)).cast("long").alias("node_words"),
        )
        totals = subtree_totals(materialize(each, "each"))
        hung = hangs.join(totals, "c").groupBy(F.col("owner").alias("c"), "depth").agg(*[F.sum(x).alias(x) for x in TOTALS], F.count_if("chain").alias("kids"))
        root = chains.where("owner is null").select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("upto"), "n", "first", "owner")
        nodes = lines.where("depth >= first").unionByName(root).join(hung, ["c", "depth"], "left").na.fill(0, [*TOTALS, "kids"])
        end = (F.col("depth") == F.col("n")).cast("long")
        nodes = nodes.select(
            "c", "depth", "first", "owner", (F.col("kids") + (1 - end)).alias("n_children"), (F.col("upto") - F.col("w")).alias("before"), (F.col("members") + end).alias("members"),
            (F.col("leaves") + end * (F.col("kids") == 0).cast("long")).alias("leaves"), (F.col("words") + end * F.col("upto")).alias("words"), (F.col("node_words") + F.col("w")).alias("node_words"),
        )
        # from the end of each chain on
        whole = running(nodes, ["c"], [F.col("depth").desc()], {f"all_{x}": x for x in TOTALS}, write=materialize, name="nodes")
        ended = chains.select(F.when(own, F.col("c")).otherwise(F.col("owner")).alias("c"), F.col("n").alias("depth"), F.col("c").alias("member"))
        ends = ended.repartition("c", "depth").sortWithinPartitions("c", "depth", "member").mapInArrow(_ends, "c long, depth long, ends string")
        rows = whole.join(ends, ["c", "depth"], "left")
        parent = F.when(F.col("depth") == F.col("first"), F.col("owner")).otherwise(F.col("c"))
        nothing = hashlib.sha256().hexdigest()
        out = rows.select(
            F.nullif("c", F.lit(NO_ID)).alias("conv_id"), "depth", F.nullif(parent, F.lit(NO_ID)).alias("parent_conv_id"), F.col("all_members").alias("n_convs"), "n_children", F.col("all_leaves").alias("n_leaves"),
            (F.col("all_words") - F.col("all_members") * F.col("before") - F.col("all_node_words")).alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
        )
        return materialize(out, "trie", keep=True)
