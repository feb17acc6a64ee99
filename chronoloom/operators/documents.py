"""Nested JSON documents as tables: every node a row, checks against a schema, bounded projections, and files of documents.

Documents are parsed once into VARIANT values. One level after another is taken apart by a lateral explode, as deep as asked for; a node is
(doc, path, pattern, parent, kind, pos, value). Patterns name the place without numbers of items (``$.chapters[].title``), so a schema is
a small table of patterns, which is joined to the nodes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.tables import exists, written

#: Bounds of a projection: levels, keys of an object, items of a list, characters of a text and of a key.
DEPTH, KEYS, ITEMS, TEXT, KEY = 2, 24, 16, 600, 80
#: What is put behind a text to see that it ended.
END = "end of the text"


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    told = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(told == "OBJECT", "object").when(told == "ARRAY", "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(told.isin("VOID", ""), "null").otherwise("number")


def whole_json(text: Column) -> Column:
    """A JSON text as VARIANT; null where it isn't JSON, or is JSON with something behind it (which parsing alone would ignore)."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]'))), "$", "array<variant>")
    return F.when((F.size(both) == 2) & (F.try_variant_get(F.get(both, F.lit(1)), "$", "string") == END), F.get(both, F.lit(0)))


def nodes(docs: DataFrame, most_depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes (doc, depth, path, pattern, parent, parent_pattern, kind, pos, value), broken) of documents (doc, json); broken: ids of texts that aren't JSON.

    The root is at depth 0. Keys of an object are numbered by name, items of a list as they stand.
    """
    spark = docs.sparkSession
    parsed = written(docs.select("doc", whole_json(F.col("json")).alias("value")), "parsed")
    none = F.lit(None).cast("string")
    level = parsed.where("value is not null").select("doc", F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit("$").alias("pattern"), none.alias("parent"), none.alias("parent_pattern"), kind_of(F.col("value")).alias("kind"), F.lit(0).alias("pos"), "value")
    found = [level]
    for depth in range(1, most_depth + 1):
        inner = spark.tvf.variant_explode(F.col("value").outer())
        rows = level.where("kind in ('object', 'array')").withColumnsRenamed({"pos": "up_pos", "path": "up", "pattern": "up_pattern"}).lateralJoin(inner.toDF("pos", "key", "child"))
        step, general = F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))), F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[]"))
        level = rows.select("doc", F.lit(depth).alias("depth"), F.concat("up", step).alias("path"), F.concat("up_pattern", general).alias("pattern"), F.col("up").alias("parent"), F.col("up_pattern").alias("parent_pattern"), kind_of(F.col("child")).alias("kind"), "pos", F.col("child").alias("value"))
        found.append(level)
    return functools.reduce(DataFrame.unionByName, found), parsed.where("value is null").select("doc")


def patterns(schema, pattern: str = "$", parent: str | None = None, required: bool = True) -> list[tuple[str, str | None, str, bool]]:
    """(pattern, parent pattern, kinds, required) of a schema: a dict of keys (``?`` behind one that may be missing), a list of one item, or kinds joined by ``|``."""
    kinds = "object" if isinstance(schema, dict) else "array" if isinstance(schema, list) else schema
    out = [(pattern, parent, kinds, required)]
    if isinstance(schema, dict):
        for key, inner in schema.items():
            out += patterns(inner, f"{pattern}.{key.rstrip('?')}", pattern, not key.endswith("?"))
    elif isinstance(schema, list):
        out += patterns(schema[0], f"{pattern}[]", pattern, False)
    return out


def _fault(path: Column, fault: str, told: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(fault).alias("fault"), told.alias("told"))


def violations_by_name(docs: DataFrame, schemas: dict) -> DataFrame:
    """(doc, name, path, fault, told): where documents (doc, name, json) differ from the schema of their name; documents of other names aren't looked at.

    A node is held against its rule and against the keys of its own value, so nodes are neither kept nor joined with one another: many documents cost no shuffle.
    """
    wanted = [(name, *p) for name, schema in schemas.items() for p in patterns(schema)]
    inner: dict = {}  # keys of objects: those known, those that must be there, and their kinds
    for name, pattern, parent, kinds, required in wanted:
        if parent is not None and pattern.startswith(f"{parent}."):
            inner.setdefault((name, parent), []).append((pattern[len(parent) + 1 :], kinds, required))
    rules = [(n, p, kinds, [k for k, *_ in own], [k for k, _, required in own if required], {k: v for k, v, _ in own}) for n, p, _, kinds, _ in wanted for own in [inner.get((n, p), [])]]
    depth = max(len(p.replace("[]", ".[]").split(".")) for _, p, *_ in wanted) - 1
    found, broken = nodes(docs.where(F.col("name").isin(*schemas)).select(F.struct("doc", "name").alias("doc"), "json"), depth)
    rules = F.broadcast(found.sparkSession.createDataFrame(rules, "name string, pattern string, kinds string, known array<string>, due array<string>, key_kinds map<string, string>"))  # as long as the schemas
    path, kind = F.col("path"), F.col("kind")
    # only keys of objects that should be objects: what lies below an unknown key or a wrong kind isn't told again
    held = F.when((F.col("kinds") == "object") & (kind == "object"), F.try_variant_get("value", "$", "map<string, variant>"))
    wrong = F.when(~F.array_contains(F.split("kinds", r"\|"), kind), F.array(_fault(path, "wrong_type", kind)))
    extra = F.transform(F.map_entries(F.map_filter(held, lambda k, _: ~F.array_contains("known", k))), lambda x: _fault(F.concat(path, F.lit("."), x["key"]), "extra", kind_of(x["value"])))
    missing = F.transform(F.array_except("due", F.map_keys(held)), lambda k: _fault(F.concat(path, F.lit("."), k), "missing", F.col("key_kinds")[k]))
    faults = [F.coalesce(x, F.array().cast("array<struct<path: string, fault: string, told: string>>")) for x in (wrong, extra, missing)]
    known = found.select(F.col("doc.doc").alias("doc"), F.col("doc.name").alias("name"), "path", "pattern", "kind", "value").join(rules, ["name", "pattern"])
    text = broken.select("doc.doc", "doc.name", F.lit("$").alias("path"), F.lit("not_json").alias("fault"), F.lit(None).cast("string").alias("told"))
    return text.union(known.select("doc", "name", F.explode(F.concat(*faults)).alias("_f")).select("doc", "name", "_f.*"))


def violations(docs: DataFrame, schema) -> DataFrame:
    """(doc, path, fault, told): where documents (doc, json) differ from a schema; one row a fault.

    fault: not_json, wrong_type (told: the kind found), missing (a required key) or extra (a key that the schema doesn't know; what lies below isn't told again).
    """
    return violations_by_name(docs.withColumn("name", F.lit("")), {"": schema}).drop("name")


def long_lists(docs: DataFrame, most: dict[str, int]) -> DataFrame:
    """(doc, path, n): lists of documents (doc, json) that hold more items than their pattern may (``$.risks``: 8)."""
    depth = max(len(p.replace("[]", ".[]").split(".")) for p in most)
    found, _ = nodes(docs, depth)
    rules = F.broadcast(found.sparkSession.createDataFrame(list(most.items()), "parent_pattern string, most int"))  # as long as the table of patterns
    lists = found.where("parent is not null").join(rules, "parent_pattern").groupBy("doc", F.col("parent").alias("path"), "most").agg(F.count("*").alias("n"))
    return lists.where(F.col("n") > F.col("most")).select("doc", "path", "n")


def bounded(docs: DataFrame, depth: int = DEPTH, keys: int = KEYS, items: int = ITEMS, text: int = TEXT, key: int = KEY) -> tuple[DataFrame, DataFrame]:
    """(kept, cuts) of documents (doc, json) within bounds.

    kept: (doc, path, kind, value) of objects, lists and scalars that stay, texts cut. cuts: (doc, path, cut, n): depth (what lies deeper; n is null), keys
    and items (of a holder; n: how many were left out), text (n: characters left out), key (n: characters of the key that are left out of its path).
    """
    found, _ = nodes(docs, depth + 1)
    found = written(found.withColumn("text", F.when(F.col("kind").isin("string", "number", "boolean"), F.expr("try_variant_get(value, '$', 'string')"))).drop("value"), "nodes")
    inside = found.join(found.select("doc", F.col("path").alias("parent"), F.col("kind").alias("holder")), ["doc", "parent"], "left")
    room = F.when(F.col("holder") == "object", keys).when(F.col("holder") == "array", items)
    over = F.coalesce(F.col("pos") >= room, F.lit(False))
    levels = [inside.where("depth = 0")]
    for level in range(1, depth + 1):  # what lies below a key or an item that was left out goes with it
        levels.append(inside.where(~over & (F.col("depth") == level)).join(levels[-1].select("doc", F.col("path").alias("parent")), ["doc", "parent"], "left_semi").select(*inside.columns))
    kept = written(functools.reduce(DataFrame.unionByName, levels), "kept")
    holders = kept.select("doc", F.col("path").alias("parent"))
    counted = inside.where(over & (F.col("depth") <= depth)).join(holders, ["doc", "parent"], "left_semi").groupBy("doc", "parent", "holder").agg(F.count("*").alias("n"))
    cuts = [counted.select("doc", F.col("parent").alias("path"), F.when(F.col("holder") == "object", "keys").otherwise("items").alias("cut"), "n")]
    deep = inside.where(F.col("depth") == depth + 1).select("doc", F.col("parent").alias("path")).distinct().join(kept.select("doc", "path"), ["doc", "path"], "left_semi")
    cuts.append(deep.select("doc", "path", F.lit("depth").alias("cut"), F.lit(None).cast("long").alias("n")))
    long = F.length("text") > text
    cuts.append(kept.where((F.col("kind") == "string") & long).select("doc", "path", F.lit("text").alias("cut"), (F.length("text") - text).cast("long").alias("n")))
    name = F.regexp_extract("pattern", r"([^.]*)$", 1)
    cuts.append(kept.where((F.col("holder") == "object") & (F.length(name) > key)).select("doc", "path", F.lit("key").alias("cut"), (F.length(name) - key).cast("long").alias("n")))
    value = F.when(F.col("kind") == "string", F.substring("text", 1, text)).otherwise(F.col("text"))
    return kept.select("doc", "path", "kind", value.alias("value")), functools.reduce(DataFrame.unionByName, cuts)


def _staged(spark: SparkSession, stage: str, packed: bool) -> DataFrame:
    """(key, name, json, file) of a folder of documents."""
    rows = spark.read.schema("key string, name string, json string").json(stage) if packed else spark.read.text(stage).withColumnRenamed("value", "json")
    return rows.select(F.col("key").cast("string").alias("key"), "name", "json", F.col("_metadata.file_path").alias("file"))


def write_documents(docs: DataFrame, folder: str, packed: bool = False) -> DataFrame:
    """Documents (key, name, json) as files, one a key and name, and the manifest (key, name, file, bytes, sha256) that commits them.

    ``packed`` writes many documents a file, a line each, for so many of them that a file each would cost more than its content.

    Files are written to a new staging folder and checked by reading them again; then the manifest names that folder and replaces the one before in a single rename. A
    reader follows the manifest, so it sees all documents of a run or none. Keys must be unique with names.
    """
    spark = docs.sparkSession
    stage = f"{folder}/run-{uuid.uuid4().hex}"
    rows = docs.select(F.col("key").cast("string").alias("key"), "name", F.regexp_replace("json", "[\\r\\n]+", " ").alias("json"))
    if packed:
        rows.withColumn("json", F.coalesce("json", F.lit(""))).write.json(stage)
    else:
        rows.repartition("key", "name").write.partitionBy("key", "name").text(stage)
    made = _staged(spark, stage, packed).select("key", "name", "file", F.octet_length("json").cast("long").alias("bytes"), F.sha2(F.col("json").cast("binary"), 256).alias("sha256"))
    twice = made.groupBy("key", "name").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("several documents have the same key and name")
    made.write.parquet(f"{stage}-manifest")
    _replace(spark, f"{folder}/CURRENT", json.dumps({"run": stage, "manifest": f"{stage}-manifest", "packed": packed}))
    return spark.read.parquet(f"{stage}-manifest")


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then moved there."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}-{hashlib.sha256(text.encode()).hexdigest()[:12]}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"{path} can't be replaced")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, json) of the last committed run; none before the first."""
    if not exists(spark, f"{folder}/CURRENT"):
        return spark.createDataFrame([], "key string, name string, json string")
    current = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/CURRENT").collect()))  # one line
    rows = _staged(spark, current["run"], current.get("packed", False)).select("key", "name", "json", F.sha2(F.col("json").cast("binary"), 256).alias("_own"))
    told = spark.read.parquet(current["manifest"]).select("key", "name", "sha256").hint("merge")  # a row a document: it is never sent whole to the driver
    return rows.join(told, ["key", "name"]).where("_own = sha256").select("key", "name", "json")
