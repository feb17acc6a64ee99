"""Running totals over groups that range partitions split, against plain loops."""

import random
from functools import reduce

from pyspark.sql import functions as F

from chronoloom.operators.scan import running


def test_split_groups_nulls_and_repeats(spark):
    rng = random.Random(4)
    keys = ["hot"] * 3000 + [None] * 200 + [f"k{i % 40}" for i in range(400)] + ["one"]
    table = [(k, rng.randrange(50), rng.choice([None, 1, 5, 2**40 + 3]), i % 7) for i, k in enumerate(keys)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(table, "g string, t long, v long, other long")
        got = [r.asDict() for r in running(df, ["g"], [F.col("t"), F.col("other"), F.col("v").asc_nulls_first()], {"total": "v"}, {"x": "v"}, True, {"before": "v"}).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(table) and sorted(map(repr, ((r["g"], r["t"], r["v"], r["other"]) for r in got))) == sorted(map(repr, table))
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r)
    assert len(by) == 43
    for rows in by.values():
        rows.sort(key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r["t"], r["other"], r["v"] or 0) for r in rows] == sorted((r["t"], r["other"], r["v"] or 0) for r in rows)
        values = [r["v"] or 0 for r in rows]
        assert [r["total"] for r in rows] == [sum(values[: i + 1]) for i in range(len(rows))]
        known = [[v for v in (r["v"] for r in rows[:i]) if v is not None] for i in range(len(rows))]
        assert [r["before"] for r in rows] == [k[-1] if k else None for k in known]
        assert [r["x"] for r in rows] == [reduce(lambda a, b: a ^ b, values[: i + 1]) for i in range(len(rows))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, t long, v long")
    assert running(df, ["g"], [F.col("t")], {"total": "v"}, count=True).collect() == []
