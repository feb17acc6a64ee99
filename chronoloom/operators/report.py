"""Reports over the artifacts of runs: ragged JSON of many kinds as one long table of facts, sections as aggregations over it.

An artifact that is missing, broken or of another version only makes its section smaller: measures that nothing tells are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.documents import nodes
from chronoloom.operators.tables import written

# Under which places artifacts of different versions tell a measure, as patterns.
TOKENS = ("$.usage.total_tokens", "$.usage.total", "$.tokens")
PROMPT = ("$.usage.prompt_tokens", "$.usage.prompt")
RESIDENT = ("$.samples[].rss", "$.samples[].rss_kb")
#: (section, measure) of every report.
MEASURES = (("artifacts", "documents"), ("artifacts", "broken"), ("requests", "requests"), ("requests", "tokens"), ("requests", "prompt_tokens"), ("stages", "done"), ("stages", "failed"), ("stages", "elapsed"), ("memory", "samples"), ("memory", "peak"), ("errors", "errors"))


def facts(artifacts: DataFrame, depth: int = 4) -> DataFrame:
    """(run, artifact, file, pattern, kind, text, number) of artifacts (run, artifact, file, json): a row each scalar, and one of pattern ``$`` each document.

    ``file`` tells documents apart. A document that isn't JSON has the kind ``broken``.
    """
    held = written(artifacts, "artifacts")
    found, broken = nodes(held.select(F.col("file").alias("doc"), "json"), depth)
    text = F.when(F.col("kind").isin("string", "number", "boolean"), F.expr("try_variant_get(value, '$', 'string')"))
    rows = found.where("kind not in ('object', 'array') or depth = 0").select("doc", "pattern", "kind", text.alias("text"))
    rows = rows.unionByName(broken.select("doc", F.lit("$").alias("pattern"), F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("text")))
    names = held.select(F.col("file").alias("doc"), "run", "artifact")
    out = rows.join(names, "doc").select("run", "artifact", F.col("doc").alias("file"), "pattern", "kind", "text", F.when(F.col("kind") == "number", F.col("text").try_cast("double")).alias("number"))
    return written(out, "facts")


def report(told: DataFrame) -> DataFrame:
    """(run, section, measure, value) of facts, all of MEASURES for each run."""
    pattern, number = F.col("pattern"), F.col("number")
    status = pattern.rlike(r"^\$\.stages\.[^.]+\.status$")

    def total(names: tuple[str, ...]) -> Column:
        return F.sum(F.when(pattern.isin(*names), number))

    found = {
        ("artifacts", "documents"): F.count_if(pattern == "$"), ("artifacts", "broken"): F.count_if(F.col("kind") == "broken"),
        ("requests", "requests"): F.count_distinct(F.when(pattern.isin(*TOKENS), F.col("file"))), ("requests", "tokens"): total(TOKENS), ("requests", "prompt_tokens"): total(PROMPT),
        ("stages", "done"): F.count_if(status & (F.col("text") == "done")), ("stages", "failed"): F.count_if(status & (F.col("text") == "failed")), ("stages", "elapsed"): F.sum(F.when(pattern.rlike(r"^\$\.stages\.[^.]+\.elapsed$"), number)),
        ("memory", "samples"): F.count_if(pattern.isin(*RESIDENT)), ("memory", "peak"): F.max(F.when(pattern.isin(*RESIDENT), number)), ("errors", "errors"): F.count_if((F.col("artifact") == "error") & (pattern == "$.code")),
    }
    rows = told.groupBy("run").agg(*[found[m].cast("double").alias("__".join(m)) for m in MEASURES])
    listed = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("measure"), F.coalesce(f"{s}__{m}", F.lit(0.0)).alias("value")) for s, m in MEASURES])
    return rows.select("run", F.explode(listed).alias("x")).select("run", "x.*")
