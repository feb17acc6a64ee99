"""Product records folded from a stream of events, with keyed state, repeated and late events, and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a record holds: the last event by time and id, how many there were, when the first and the last happened.
RECORD = "product long, state string, n long, first_us long, last_us long, last_id long, version long, expired boolean"
STATE = "state string, n long, first_us long, last_us long, last_id long, version long"


def _fold(idle_us: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            state, n, first, last, last_id, version = group.get
            group.remove()
            yield pd.DataFrame([(key[0], state, n, first, last, last_id, version + 1, True)], columns=[c.split()[0] for c in RECORD.split(", ")])
            return
        state, n, first, last, last_id, version = group.get if group.exists else (None, 0, None, None, -1, 0)
        for rows in parts:
            n += len(rows)
            first = min([*rows["us"].tolist(), *([first] if first is not None else [])])
            top = rows.sort_values(["us", "event_id"]).iloc[-1]
            if last is None or (int(top["us"]), int(top["event_id"])) > (last, last_id):  # a late event doesn't undo a later one
                state, last, last_id = top["event_type"], int(top["us"]), int(top["event_id"])
        group.update((state, int(n), int(first), last, last_id, version + 1))
        group.setTimeoutTimestamp(max(last // 1000 + idle_us // 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], state, n, first, last, last_id, version + 1, False)], columns=[c.split()[0] for c in RECORD.split(", ")])

    return run


def product_records(events: DataFrame, late: str, idle: int) -> DataFrame:
    """Updates of records by product of a stream of events (product, event_id, event_type, ts).

    Events that repeat an id within the horizon ``late`` count once; those later than the horizon are dropped. A record whose product is silent for ``idle``
    seconds behind the watermark leaves the state with a last update, so the state holds only active products. The newest version of each product is its record.
    """
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    at = at.select("product", "event_id", "event_type", "at", F.unix_micros("at").alias("us"))
    return at.groupBy("product").applyInPandasWithState(_fold(idle * 1_000_000), RECORD, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_updates(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """All that the source holds now; the newest version of each product is read back. A batch that runs again replaces its own folder."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(table).drop("batch")
    rest = [c for c in rows.columns if c != "product"]
    # a product that comes back after its record has left begins with version 1 again: the later event wins
    return rows.groupBy("product").agg(F.max_by(F.struct(*rest), F.struct("last_us", "last_id", "version")).alias("r")).select("product", "r.*")
