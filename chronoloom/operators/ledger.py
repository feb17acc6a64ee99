"""A map over windows that isolates faults: a failing window is a row, attempts are kept in a ledger, a killed run is resumed.

The ledger is a folder of Parquet parts, one for each slice and round of attempts; a part counts once Spark has committed it (its ``_SUCCESS`` file), so
what a killed run was writing is written again and nothing is done twice. Slices follow the windows' fingerprints, which also tell whether an
earlier result still fits: a window whose text or function has changed is mapped anew.
"""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.tables import exists

#: Characters of an error that are kept, in the ledger and in a placeholder.
ERROR_CHARS = 500
_LEDGER = "meeting_id long, window long, fingerprint string, attempt int, slice int, status string, output string, error_type string, error string"


def fingerprint(version: str, *columns: str) -> Column:
    """Of a window and of the version of the function; null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]).cast("binary"), 256)


def _isolated(function: Callable[[str], str]):
    def run(batches):
        for rows in batches:
            out = []
            for text in rows["text"]:
                try:
                    out.append(("ok", function(text), None, None))
                except Exception as e:  # the row's own fault: kept with it, other rows go on
                    last = traceback.extract_tb(e.__traceback__)[-1]
                    out.append(("failed", None, type(e).__name__, f"{e} ({last.name})"[:ERROR_CHARS]))
            told = pd.DataFrame(out, columns=["status", "output", "error_type", "error"], index=rows.index)
            yield pd.concat([rows[["meeting_id", "window", "fingerprint", "attempt", "slice"]], told], axis=1)

    return run


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All committed attempts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [str(x.getPath()) for x in files.listStatus(path)] if files.exists(path) else []
    done = [p for p in parts if exists(spark, f"{p}/_SUCCESS")]
    rows = spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(*done) if done else rows


def latest(ledger: DataFrame) -> DataFrame:
    """The last attempt of each fingerprint; a success stays, whatever was tried later."""
    order = F.struct((F.col("status") == "ok").alias("ok"), "attempt")
    rest = [c for c in ledger.columns if c != "fingerprint"]
    return ledger.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), order).alias("last")).select("fingerprint", "last.*")


def map_with_ledger(windows: DataFrame, function: Callable[[str], str], folder: str, version: str, attempts: int = 1, slices: int = 8) -> DataFrame:
    """Each window (meeting_id, window, text) with fingerprint, status, output, error_type, error, attempts and placeholder.

    Windows without a success in the ledger are tried up to ``attempts`` times in all. What still fails is a row of status ``failed`` whose placeholder names the window and the
    fault. Calling it again with the same folder goes on where the last call ended.
    """
    spark = windows.sparkSession
    rows = windows.select("meeting_id", "window", "text", fingerprint(version, "meeting_id", "window", "text").alias("fingerprint"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("fingerprint"), F.lit(slices)).cast("int"))
    for _ in range(attempts):
        for part in range(slices):
            known = read_ledger(spark, folder).groupBy("fingerprint").agg(F.count("*").alias("tries"), F.max((F.col("status") == "ok").cast("int")).alias("done"))
            todo = rows.where(F.col("slice") == part).join(known, "fingerprint", "left").where(f"tries is null or (done = 0 and tries < {attempts})")
            if todo.isEmpty():
                continue
            todo = todo.select("meeting_id", "window", "fingerprint", (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("attempt"), "slice", "text")
            tried = todo.mapInPandas(_isolated(function), _LEDGER)
            tried.write.parquet(f"{folder}/part-{uuid.uuid4().hex}")
    return results(rows, read_ledger(spark, folder))


def results(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Windows (meeting_id, window, fingerprint) with what the ledger says of them; those that it doesn't know are ``missing``."""
    tries = ledger.groupBy("fingerprint").agg(F.count("*").alias("attempts"))
    last = latest(ledger).select("fingerprint", "status", "output", "error_type", "error")
    out = rows.join(last, "fingerprint", "left").join(tries, "fingerprint", "left")
    failed = F.format_string("MAP window %d failed: %s", F.col("window"), F.coalesce("error", F.lit("not tried")))
    status = F.coalesce("status", F.lit("missing"))
    return out.select("meeting_id", "window", "fingerprint", status.alias("status"), "output", "error_type", "error", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.when(status != "ok", failed).alias("placeholder"))


def totals(mapped: DataFrame) -> DataFrame:
    """(meeting_id, status, map_results, failed): pass, or partial if a window failed."""
    failed = F.count_if(F.col("status") != "ok")
    return mapped.groupBy("meeting_id").agg(F.when(failed == 0, "pass").otherwise("partial").alias("status"), F.count("*").alias("map_results"), failed.alias("failed"))
