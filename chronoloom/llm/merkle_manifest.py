"""Merkle manifest of a dataset: a hash tree of its rows by language, proofs of every row, and which rows were tampered with.

Every row is a leaf. Leaves of a language stand in the order of their ids; a running count over range partitions gives them their
places, so a language of any size is split. Places are cut into aligned buckets of BUCKET leaves, each a whole subtree. In the
executors a DuckDB block engine takes one bucket at a time as an Arrow table and runs one query a level: an ordered string_agg of
each run of two nodes, and its sha256. Spark puts the roots of buckets into buckets of their own, and so on, until one root a
language is left, and does the same with the languages; the steps that lead from a bucket's root to the top are then joined to its rows,
whose inner proofs the engine finds by joining each level with itself. Nothing but single buckets is gathered.

A bucket that isn't the only one of its tree is raised to the full height: its last nodes have no siblings, but are hashed on each level.

Edge cases: null values are written ``-``; null ids come first, a null language is a language. Rows that tie on the id are ordered by
their leaf. Repeated rows are leaves of their own. Empty tables give empty results. Very long texts are hashed whole. Extra columns
are ignored, whatever they are called. Rows without id or count of characters can't be tampered with.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, scratch_tables, tidy
from chronoloom.operators.scan import running

#: Levels of a bucket, and its leaves.
LEVELS = 12
BUCKET = 1 << LEVELS
#: One in so many documents is tampered with.
TAMPERED = 7


def told(value: Column) -> Column:
    """A value with its length in bytes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(told, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def _levels(con, nodes: pa.Table) -> int:
    """Tables n0, n1, .. of (pos, digest) until one node is left; how many levels lie above n0."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TABLE n0 AS SELECT pos, digest FROM nodes")
    height = max(0, (nodes.num_rows - 1).bit_length())
    for k in range(height):
        con.execute(f"CREATE OR REPLACE TABLE n{k + 1} AS SELECT pos // 2 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM n{k} GROUP BY pos // 2")
    return height


def _connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '400MB'")
    return con


def _buckets(batches, n_keys: int):
    """Whole buckets as Arrow tables from batches that are sorted by the first n_keys columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
        lo = 0
        if held and tuple(c[0].as_py() for c in held[-1].columns[:n_keys]) != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                yield pa.Table.from_batches([*held, batch.slice(lo, i - lo)])
                held, lo = [], i
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _roots(batches):
    """(g, bucket, height, root) of rows (g, bucket, pos, digest) sorted by them."""
    con = _connect()
    for t in _buckets(batches, 2):
        height = _levels(con, t.select(["pos", "digest"]))
        root = con.execute(f"SELECT digest FROM n{height}").fetchall()[0][0]
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks()[:1], t.column(1).combine_chunks()[:1], pa.array([height], pa.int32()), pa.array([root])], ["g", "bucket", "height", "root"])


def _sibling(k: int) -> tuple[str, str]:
    """(what stands before a node, what stands behind it) in its run on a level, as SQL."""
    odd, other = f"(p.pos >> {k}) & 1 = 1", f"coalesce(s{k}.digest, '')"
    return f"CASE WHEN {odd} THEN {other} ELSE '' END", f"CASE WHEN {odd} THEN '' ELSE {other} END"


def _joined(height: int) -> str:
    return "FROM nodes p " + " ".join(f"LEFT JOIN n{k} s{k} ON s{k}.pos = xor(p.pos >> {k}, 1)" for k in range(height)) + " ORDER BY p.pos"


def _steps(batches):
    """(g, pos, before, behind): for each row the siblings on every level of its bucket."""
    con = _connect()
    for t in _buckets(batches, 2):
        height = _levels(con, t.select(["pos", "digest"]))
        sides = [_sibling(k) for k in range(height)]
        before, behind = ("[" + ", ".join(x[i] for x in sides) + "]::VARCHAR[]" for i in (0, 1))
        got = con.execute(f"SELECT p.pos, {before} AS before, {behind} AS behind {_joined(height)}").to_arrow_table()
        sides = [got.column(c).cast(pa.list_(pa.string())) for c in ("before", "behind")]
        out = pa.table([t.column("g"), t.column("whole"), *sides], names=["g", "pos", "before", "behind"])
        yield from out.combine_chunks().to_batches()


def _proofs(batches):
    """Rows sorted by language, bucket and place with the concatenated siblings inside their bucket, and what the changed leaf makes of its root."""
    con = _connect()
    for t in _buckets(batches, 2):
        height = _levels(con, t.select(["pos", "digest", "changed"]))
        folded, parts = "p.changed", []
        for k in range(height):
            before, behind = _sibling(k)
            folded = f"sha256({before} || {folded} || {behind})"
            parts.append(f"coalesce(s{k}.digest, '')")
        got = con.execute(f"SELECT concat({', '.join(parts) or chr(39) * 2}) AS inner_proof, {folded} AS inner_root {_joined(height)}").to_arrow_table()
        out = t.append_column("inner_proof", got.column("inner_proof").cast(pa.string())).append_column("inner_root", got.column("inner_root").cast(pa.string()))
        yield from out.combine_chunks().to_batches()


def _hashed(root: Column, times: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), root, lambda acc, i: F.when(i <= times, F.sha2(acc.cast("binary"), 256)).otherwise(acc))


def _cut(nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, ..) with their bucket and their place in it, each bucket whole and in order in one partition."""
    rows = nodes.withColumns({"whole": F.col("pos"), "bucket": F.floor(F.col("pos") / BUCKET), "pos": F.col("pos") % BUCKET})
    return rows.select("g", "bucket", "pos", *[c for c in rows.columns if c not in ("g", "bucket", "pos")]).repartition("g", "bucket")


def _bucket_roots(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, bucket, up, root) of nodes (g, pos, digest): roots of buckets, raised by ``up`` levels where the tree has more buckets."""
    rows = _cut(nodes.select("g", "pos", "digest")).select("g", "bucket", "pos", "digest").sortWithinPartitions("g", "bucket", "pos")
    roots = rows.mapInArrow(_roots, "g string, bucket long, height int, root string")
    up = F.when(F.col("size") > BUCKET, LEVELS - F.col("height")).otherwise(0)
    return materialize(roots.join(sizes, "g").select("g", "bucket", up.alias("up"), _hashed(F.col("root"), up).alias("root")), "bucket_roots")


def tree(nodes: DataFrame) -> DataFrame:
    """(g, pos, before, behind, root) of nodes (g, pos, digest), places from 0: the siblings of each node up to its group's root.

    For the few nodes above the leaves' buckets: one in BUCKET leaves.
    """
    none = F.array().cast("array<string>")
    paths = nodes.select("g", "pos", F.col("pos").alias("at"), none.alias("before"), none.alias("behind"))
    while True:
        sizes = materialize(nodes.groupBy("g").agg(F.count("*").alias("size")), "sizes")
        roots = _bucket_roots(nodes, sizes)
        rows = _cut(nodes.select("g", "pos", "digest")).sortWithinPartitions("g", "bucket", "pos")
        steps = rows.mapInArrow(_steps, "g string, pos long, before array<string>, behind array<string>")
        steps = steps.select("g", F.col("pos").alias("at"), F.col("before").alias("more_before"), F.col("behind").alias("more_behind"))
        found = paths.join(steps, ["g", "at"]).withColumn("bucket", F.floor(F.col("at") / BUCKET)).join(roots, ["g", "bucket"])
        empty = F.array_repeat(F.lit(""), F.col("up"))
        paths = found.select("g", "pos", F.col("bucket").alias("at"), F.concat("before", "more_before", empty).alias("before"), F.concat("behind", "more_behind", empty).alias("behind"), "root")
        paths = materialize(paths, "paths")
        if (sizes.agg(F.max("size")).first()[0] or 0) <= BUCKET:
            return paths.select("g", "pos", "before", "behind", "root")
        nodes, paths = roots.select("g", F.col("bucket").alias("pos"), F.col("root").alias("digest")), paths.drop("root")


def _outer(placed: DataFrame) -> DataFrame:
    """(g, bucket, before, behind, subroot, root): the siblings above each bucket of leaves, up to the root of all."""
    sizes = materialize(placed.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    roots = _bucket_roots(placed.select("g", "pos", F.col("leaf").alias("digest")), sizes)
    inside = tree(roots.select("g", F.col("bucket").alias("pos"), F.col("root").alias("digest")))
    langs = inside.where("pos = 0").select(F.lit("").alias("one"), "g", F.col("root").alias("subroot"))
    lang = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    langs = running(langs, ["one"], [lang.asc_nulls_first()], count=True, write=materialize, name="langs").withColumn("pos", F.col("pos") - 1)
    above = tree(langs.select(F.col("one").alias("g"), "pos", F.col("subroot").alias("digest")))
    top = above.select("pos", F.col("before").alias("top_before"), F.col("behind").alias("top_behind"), "root").join(langs, "pos").select("g", "top_before", "top_behind", "subroot", "root")
    raised = F.array_repeat(F.lit(""), F.col("up"))
    outer = roots.select("g", "bucket", "up").join(inside.select("g", F.col("pos").alias("bucket"), "before", "behind"), ["g", "bucket"]).join(top, "g")
    outer = outer.select("g", "bucket", F.concat(raised, "before", "top_before").alias("before"), F.concat(raised, "behind", "top_behind").alias("behind"), "subroot", "root")
    return materialize(outer, "outer", keep=True)


@tidy
def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    doc_id, source, lang, n_chars, text = columns
    chosen = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False)) & n_chars.isNotNull()
    leaf, tampered = leaf_of(*columns), leaf_of(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text)
    # a language is told with its length, so none is null
    leaves = docs.select(doc_id.alias("doc_id"), told(lang).alias("g"), leaf.alias("leaf"), F.when(chosen, tampered).alias("tampered"))
    with scratch_tables(docs.sparkSession):
        keep = functools.partial(materialize, keep=True)
        placed = running(leaves, ["g"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], count=True, write=keep, name="leaves")
        placed = placed.select("doc_id", "g", "leaf", F.coalesce("tampered", "leaf").alias("changed"), (F.col("pos") - 1).alias("pos"))
        outer = _outer(placed)

    # rows and the proofs of their buckets meet on (language, bucket): BUCKET rows at most a key
    rows = _cut(placed.select("g", "pos", F.col("leaf").alias("digest"), "changed", "doc_id")).drop("whole")
    met = rows.join(outer, ["g", "bucket"]).select(*rows.columns, "before", "behind", "subroot", "root").sortWithinPartitions("g", "bucket", "pos")
    proved = met.mapInArrow(_proofs, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema) + ", inner_proof string, inner_root string")
    steps = F.zip_with("before", "behind", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    folded = F.aggregate(steps, F.col("inner_root"), lambda acc, s: F.sha2(F.concat(s["a"], acc, s["b"]).cast("binary"), 256))
    outer_proof = F.array_join(F.transform(steps, lambda s: F.concat(s["a"], s["b"])), "")
    out = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat("inner_proof", outer_proof).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
