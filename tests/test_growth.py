"""Results of steps whose work must grow no faster than their input, against plain versions."""

import random

from chronoloom.operators import evaluation, metrics
from chronoloom.operators import intervals as iv

KIND = "key long, id long, label string, start_ms long, end_ms long"


def made(seed: int, n: int, length: int = 40) -> list[tuple]:
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 2, 3]), i, rnd.choice(["a", "b", "unknown", None]), s := rnd.randrange(200), s + rnd.randrange(-2, length)) for i in range(n)]


def pairs(a: list[tuple], b: list[tuple]):
    for x in a:
        for y in b:
            ms = min(x[4], y[4]) - max(x[3], y[3])
            if x[0] == y[0] and x[4] > x[3] and y[4] > y[3] and ms > 0:
                yield x, y, ms


def test_shared_time_is_that_of_all_pairs(spark):
    rows, reference = made(1, 80), made(2, 90)
    a, b = spark.createDataFrame(rows, KIND), spark.createDataFrame(reference, KIND)
    want, first = {}, {}
    for x, y, ms in pairs(rows, reference):
        k = (x[0], x[1], y[2])
        want[k] = want.get(k, 0) + ms
        first[k] = min(first.get(k, (y[3], y[4], y[1])), (y[3], y[4], y[1]))
    got = iv.shared_time(a, b, ["key"], ["id"], first=True).collect()
    assert {(r["key"], r["id"], r["ref_label"]): r["ms"] for r in got} == want
    assert {(r["key"], r["id"], r["ref_label"]): tuple(r["at"]) for r in got} == first


def test_meeting_unions(spark):
    rows, reference = [r for r in made(3, 60, 9)], [r for r in made(4, 60, 9)]
    a, b = (iv.islands(spark.createDataFrame(r, KIND).where("end_ms > start_ms"), ["key"]) for r in (rows, reference))
    want = {(x[0], t) for x, y, _ in pairs(rows, reference) for t in range(max(x[3], y[3]), min(x[4], y[4]))}
    got = [(r["key"], t) for r in iv.meets(a, b, ["key"]).collect() for t in range(r["start_ms"], r["end_ms"])]
    assert len(got) == len(set(got)) and set(got) == want


def test_very_long_intervals_are_not_cut(spark):
    # of a length that no number of time buckets could hold
    most = 10**15
    a, b = spark.createDataFrame([(1, 1, "a", 0, most)], KIND), spark.createDataFrame([(1, 2, "b", 5, most + 5), (1, 3, "b", most, most + 9)], KIND)
    assert [tuple(r) for r in metrics.overlap_matrix(a, b, ["key"]).collect()] == [("a", "b", most - 5)]
    mapping = evaluation.label_mapping(evaluation.by_labels(a, b, ["key"]), ["key"])
    got = evaluation.sample_metrics(a, b, mapping, ["key"], 1000).collect()[0]
    assert (got["n_ref"], got["n_known"], got["n_hit"]) == (most // 1000, most // 1000, most // 1000 - 1)
    assert evaluation.coverage_rows(a, b, mapping, ["key"]).where("id = 2").collect()[0]["known_ms"] == most - 5


def test_cosine_of_bigrams_beside_counters():
    from chronoloom.operators.topics import _alike, _counts, bigram_cosine

    rnd = random.Random(5)
    texts = ["", "a", "\0", "\0\0", "aa", "会议😀会议", *["".join(rnd.choice("ab会😀") for _ in range(rnd.randrange(60))) for _ in range(40)]]
    for a in texts:
        for b in texts:
            assert bigram_cosine(a, b) == _alike(_counts([a]), _counts([b]))


def test_cohesion_holds_no_table_of_grams(spark):
    from chronoloom.operators import topics

    rows = [(1, i, f"seg-{i:06d}", "ein Satz über Zahlen " * (i + 1), "speaker_0", i * 10, i * 10 + 9) for i in range(5)]
    made = topics.cohesion(spark.createDataFrame(rows, "meeting_id long, idx long, segment_id string, text string, speaker string, start_ms long, end_ms long"))
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r["cohesion"] is None for r in made.orderBy("idx").collect()] == [True, False, False, False, False]


def test_files_of_many_meetings(spark, tmp_path, monkeypatch):
    """No folder a meeting: their number doesn't grow with the meetings; each file of a listing is still there."""
    from chronoloom.operators import tables
    from chronoloom.plans import files

    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    for name, most in (("textgrid_files", 3), ("diarization_files", 16), ("transcript_files", 16), ("file_listing", 10**6)):
        before = set(tmp_path.rglob("*.txt"))
        getattr(files, name)(spark, "/root/testdata/sf0.001").collect()
        made = set(tmp_path.rglob("*.txt")) - before
        assert 0 < len(made) <= most and len({f.parent for f in made}) <= 64, name


def test_packed_documents_are_committed_like_files(spark, tmp_path):
    from chronoloom.operators import documents

    folder, kind = f"file://{tmp_path}/exports", "key long, name string, json string"
    docs = [(k, n, '{"t": "é\\u0000 \\\\ %d"}' % k) for k in range(40) for n in ("a.json", "b.json")]
    told = documents.write_documents(spark.createDataFrame(docs, kind).coalesce(2), folder, packed=True).collect()
    assert len(told) == 80 and len({r["file"] for r in told}) == 2 and all(r["bytes"] == len(docs[2 * int(r["key"])][2].encode()) for r in told)
    assert sorted(tuple(r) for r in documents.read_documents(spark, folder).collect()) == sorted((str(k), n, j) for k, n, j in docs)
    documents.write_documents(spark.createDataFrame(docs[:3], kind), folder)
    assert documents.read_documents(spark, folder).count() == 3


def test_long_summaries_are_folded_in_line_with_their_length():
    from chronoloom.operators.units import fold_texts

    def plain(texts: list[str], alike: float) -> str:
        acc = texts[0]
        for t in texts[1:]:
            x, y = ({c[i : i + 2] for i in range(len(c) - 1)} for c in ("".join(acc.split()), "".join(t.split())))
            if (len(x & y) / len(x | y) if x and y else 0.0) < alike:
                acc += "；" + t
        return acc

    rnd = random.Random(6)
    for _ in range(400):
        texts = ["".join(rnd.choice("ab 会；") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(1, 7))]
        assert fold_texts(texts, ["".join(t.split()) for t in texts], 0.5) == plain(texts, 0.5)
    assert fold_texts(["a", None, "b"], ["a", None, "b"], 0.8) is None and fold_texts(["x y"], ["xy"], 0.8) == "x y"


def test_chapters_of_long_summaries(spark):
    """A summary's bigrams were cut out of it one by one, each from its beginning."""
    import time

    from chronoloom.operators import units

    long = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(100_000))
    blocks = [(1, i, f"t{i}", s, ["p"], ["a"], "s0", "s0", ["s0"], i > 0) for i, s in enumerate((long, long, "kurz"))]
    kind = "meeting_id long, block long, title string, summary string, key_points array<string>, anchors array<string>, start_ref string, end_ref string, refs array<string>, continues_previous boolean"
    segments = spark.createDataFrame([(1, "s0", "v", 3, 9)], "meeting_id long, segment_id string, speaker string, start_ms long, end_ms long")
    began = time.time()
    got = units.fold_chapters(spark.createDataFrame(blocks, kind), segments).collect()
    assert [r["overview"] for r in got] == [long + "；kurz"] and time.time() - began < 60


def test_small_meetings_are_packed_in_batches(spark):
    from chronoloom.operators import packing

    items = [(1, "a", 0, 9), (1, "b", 1, 20), (1, "c", 2, 6), (1, "d", 3, 4), (1, "e", 4, 1), (2, "z", 0, 10), (None, "n", 5, 3)]
    made = packing.best_fit(spark.createDataFrame(items, "meeting_id long, item string, first long, cost long"), 10)
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["meeting_id"], r["item"]): (r["bin"], r["oversize"]) for r in made.collect()}
    assert got == {(1, "a"): (0, False), (1, "b"): (None, True), (1, "c"): (1, False), (1, "d"): (1, False), (1, "e"): (0, False), (2, "z"): (0, False), (None, "n"): (0, False)}


def test_rounds_read_what_is_ahead(spark, tmp_path):
    """Each round read all segments again and wrote eight tables; segments of meetings that have ended are now left out."""
    from chronoloom.operators import carryover
    from chronoloom.plans import deep

    long = {40: 12, **{m: 2 for m in range(10, 20)}}
    rows = [(m, i, f"seg-{i:06d}", "w" * 300, "speaker_0", i, i) for m, n in long.items() for i in range(n)]
    segments = spark.createDataFrame(rows, "meeting_id long, idx long, segment_id string, text string, speaker string, start_ms long, end_ms long")
    got = carryover.wavefront(segments, deep.model, 700, 20, folder=f"file://{tmp_path}")
    assert sorted((r["meeting_id"], r["round"], r["start"], r["n"]) for r in got["windows"].collect()) == sorted((m, r, 2 * r, 2) for m, n in long.items() for r in range(n // 2))
    assert sorted((r["meeting_id"], r["round"], r["start_pos"], r["full_end"]) for r in got["chapters"].collect()) == sorted((m, r, 2 * r, 2 * r + 1) for m, n in long.items() for r in range(n // 2))
    made = {p.name for p in tmp_path.iterdir()}
    assert sum(not n.startswith(("laid", "starts", "ahead")) for n in made) <= 4 * 6
    kept = [spark.read.parquet(f"file://{tmp_path}/{n}").count() for n in sorted(n for n in made if n.startswith("ahead"))]
    assert kept and kept[0] == 10 and all(2 * b < a for a, b in zip(kept, kept[1:]))


def test_references_of_two_sources_are_merged_without_a_shuffle(spark):
    import json

    from chronoloom.operators import diagnostics

    beside = {"a": "side", "f": "f.txt", "k": "stays", "n" * 81: "long"}
    result = {"a": {"path": "/r/x", "size_bytes": 2, "sha256": "s"}, "k": 5, "n" * 82: "z", "n" * 83: "y", "g": "../q"}
    docs = [(1, "/r", json.dumps({"artifacts": beside}), json.dumps({"artifacts": result})), (2, "/r", json.dumps({"artifacts": beside}), '{"artifacts": 3}'), (3, "/r", "no json", None), (4, None, None, json.dumps({"artifacts": result}))]
    rows = spark.createDataFrame(docs, "doc long, root string, beside string, result string")
    made = diagnostics.artifact_refs(rows, ("beside", "result"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    own = {"a": ("x", 2, "s"), "n" * 80: ("z", None, None), "g": ("q", None, None)}
    first = {"a": ("side", None, None), "f": ("f.txt", None, None), "k": ("stays", None, None), "n" * 80: ("long", None, None)}
    got = [(r["doc"], r["name"], r["ref"], r["size_bytes"], r["sha256"]) for r in made.collect()]
    want = [(d, n, *v) for d, told in ((1, first | own), (2, first), (4, own | {"a": ("x", 2, "s")})) for n, v in told.items()]
    assert sorted(got) == sorted(want)
    tables = [diagnostics.artifact_refs(rows.where("doc < 4").select("doc", "root", rows[c].alias("json"))) for c in ("beside", "result")]
    again = [(r["doc"], r["name"], r["ref"]) for r in diagnostics.merged_refs(*tables).collect() if len(r["name"]) < 80]
    assert sorted(again) == sorted((d, n, ref) for d, n, ref, *_ in got if d < 4 and len(n) < 80)


def test_faults_need_no_join_of_nodes(spark):
    """Missing keys were sought by a join with all nodes, which Parquet packs so well that Spark sent them whole through the driver."""
    from chronoloom.operators import documents

    schemas = {"a.json": {"id": "number", "m": {"x": "string|null", "y?": "number"}}, "b.json": [{"id": "string"}], "c.json": {"any": "object"}}
    docs = [
        (1, "a.json", '{"id": 1, "m": {"x": null}}'), (1, "b.json", '[{"id": "s"}, {"ID": null, "n": {"id": 1}}, 3]'), (2, "a.json", '{"id": "1", "m": {"y": []}, "z": {"id": 1}}'), (2, "b.json", '{"id": "s"}'),
        (3, "a.json", "{"), (3, "b.json", None), (3, "other.json", "{"), (4, "c.json", '{"any": {"k": null}}'), (5, "a.json", '{"id": null, "m": []}'), (5, "a.json", '{"m": {"x": "é"}}'), (6, None, "{"),
    ]
    table = spark.createDataFrame(docs, "doc long, name string, json string")
    one, made = documents.violations(table.where("name = 'a.json'").select("doc", "json"), schemas["a.json"]), documents.violations_by_name(table, schemas)
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (one, made)):
        assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") == 1
    got = [tuple(r) for r in made.collect()]
    assert sorted(repr((r["doc"], "a.json", r["path"], r["fault"], r["told"])) for r in one.collect()) == sorted(repr(r) for r in got if r[1] == "a.json")
    assert sorted(map(repr, got)) == sorted(map(repr, [
        (1, "b.json", "$[1].ID", "extra", "null"), (1, "b.json", "$[1].n", "extra", "object"), (1, "b.json", "$[1].id", "missing", "string"), (1, "b.json", "$[2]", "wrong_type", "number"),
        (2, "a.json", "$.id", "wrong_type", "string"), (2, "a.json", "$.m.x", "missing", "string|null"), (2, "a.json", "$.m.y", "wrong_type", "array"), (2, "a.json", "$.z", "extra", "object"), (2, "b.json", "$", "wrong_type", "object"),
        (3, "a.json", "$", "not_json", None), (3, "b.json", "$", "not_json", None), (4, "c.json", "$.any.k", "extra", "null"),
        (5, "a.json", "$.id", "wrong_type", "null"), (5, "a.json", "$.m", "wrong_type", "array"), (5, "a.json", "$.id", "missing", "number"),
    ]))


def test_no_table_of_files_is_broadcast(spark):
    """Neither texts, nor digests, nor nodes of exported files are sent whole through the driver, however small their Parquet is."""
    import re

    from chronoloom.plans import deep

    plan = deep.export_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"BroadcastExchange[^\n]*\n(?:[^\n]*(?:Filter|Project)[^\n]*\n)*[^\n]*?(Scan ExistingRDD|FileScan|\w+)[ \[(]", plan)
    assert sent and set(sent) == {"Scan ExistingRDD"}, sent
