"""Edge cases of model answers, drafts and diagnostics: nulls, empty tables, ties, other shapes, small cases by hand."""

import difflib
import json

from pyspark.sql import functions as F

from chronoloom.operators import answers, diagnostics, documents, drafts, records, reviews

SEGMENTS = "meeting_id long, block long, idx long, segment_id string, short string, text string"
ANSWERS = "meeting_id long, block long, finish_reason string, truncated boolean, content string"
ITEMS = "meeting_id long, kind string, pos long, item_id string, text string, review_status string"
MEETINGS = "meeting_id long, title string, finalized boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def segments(spark):
    return spark.createDataFrame([(1, 0, 0, "seg-0", "s0", "hello"), (1, 0, 1, "seg-1", "s1", ""), (1, 0, 2, "seg-2", "s2", "bye"), (1, 1, 3, "seg-3", "s3", "next")], SEGMENTS)


def test_block_summaries_by_hand(spark):
    good = {"title": " a  title ", "summary": "x" * 12, "key_refs": ["s2", "seg-1", "seg-0", "seg-2", "seg-3", None, {"a": 1}], "key_points": "none", "continues_previous": " 是 ", "action_candidates": [{"task": "do", "refs": ["seg-1"]}, {"task": "go", "owner": 5, "refs": ["s0", "s0"]}]}
    said = [(1, 0, "stop", False, f"well: {json.dumps(good)} and more"), (1, 1, "stop", None, json.dumps(good | {"summary": None})), (1, 7, "stop", None, json.dumps(good)), (2, 0, None, None, "{}"), (2, 1, "stop", True, None), (2, 2, "stop", None, None), (2, 3, "stop", None, "[1]")]
    df = spark.createDataFrame(said, ANSWERS)
    summaries = answers.block_summaries(df, segments(spark), chars=10)
    got = {(r["meeting_id"], r["block"]): r for r in summaries.collect()}
    assert {k: r["fault"] for k, r in got.items()} == {(1, 0): None, (1, 1): "no_title_or_summary", (1, 7): "empty_block", (2, 0): "unfinished", (2, 1): "cut_input", (2, 2): "not_json", (2, 3): "not_json"}
    one = got[1, 0]
    assert (one["title"], one["refs"], one["key_points"], one["anchors"], one["continues_previous"], one["start_ref"], one["end_ref"]) == ("a title", ["seg-2", "seg-0"], [], [], True, "seg-0", "seg-2")
    assert got[1, 1]["title"] is None and got[1, 1]["refs"] is None
    assert rows(answers.block_actions(df, segments(spark), summaries)) == [(1, 0, 1, "go", None, None, ["seg-0"])]


def test_answers_of_empty_tables(spark):
    none, of = spark.createDataFrame([], ANSWERS), spark.createDataFrame([], SEGMENTS)
    assert answers.block_summaries(none, of).count() == 0
    assert answers.block_actions(none, of, answers.block_summaries(none, of)).count() == 0
    told = spark.createDataFrame([(1, "stop", None, json.dumps({"overview": {"text": "long enough"}}))], "meeting_id long, finish_reason string, truncated boolean, content string")
    cited = spark.createDataFrame([(1, 1, ["seg-2", None, "seg-0"]), (1, 0, ["seg-1", "seg-0", "seg-0"])], "meeting_id long, chapter long, refs array<string>")
    assert rows(answers.overviews(told, cited, segments(spark), chars=5)) == [(1, None, None, "long enough", ["seg-0", "seg-2"])]
    assert rows(answers.overviews(told, cited, of, chars=5)) == [(1, "no_refs", None, None, None)]


def test_draft_of_nothing_and_of_ties(spark):
    meetings = spark.createDataFrame([(1, "t", None), (2, None, True)], MEETINGS)
    items = spark.createDataFrame([(2, "outline", 0, "a", "x", None), (2, "decisions", 9, "a", "y", "edited"), (2, "decisions", 1, None, None, "edited"), (3, "decisions", 1, "z", "no meeting", None)], ITEMS)
    speakers = spark.createDataFrame([(2, 0, "s", "A"), (2, 1, "s", None), (2, 2, None, "B")], "meeting_id long, pos long, speaker_id string, display_name string")
    overviews = spark.createDataFrame([(2, "o")], "meeting_id long, overview string")
    got = {r["meeting_id"]: json.loads(r["json"]) for r in drafts.contents(meetings, items, speakers, overviews).collect()}
    assert got[1] == {"title": "t", "speaker_names": {}, "transcript_edits": [], "minutes": None, "chapters": [], "decisions": [], "action_items": [], "review_marks": {}}
    assert got[2]["review_marks"] == {"a": "reviewed"} and got[2]["speaker_names"] == {"s": "s"}
    assert [x["item_id"] for x in got[2]["decisions"]] == [None, "a"] and got[2]["minutes"]["outline"][0]["review_status"] == "reviewed"
    assert drafts.draft_faults(spark.createDataFrame([(1, json.dumps(got[1]))], "meeting_id long, json string")).count() == 0


def test_draft_faults_by_hand(spark):
    whole = {"title": "t", "speaker_names": {}, "transcript_edits": [], "chapters": [], "decisions": [], "action_items": [], "review_marks": {}, "more": 1}
    docs = [(1, json.dumps(whole)), (2, json.dumps(whole | {"minutes": 3, "title": None})), (3, None), (4, "[]"), (5, json.dumps({k: v for k, v in whole.items() if k != "chapters"}))]
    assert rows(drafts.draft_faults(spark.createDataFrame(docs, "meeting_id long, json string"))) == [(2, "minutes"), (2, "title"), (3, "content"), (4, "content"), (5, "chapters")]


def test_artifacts_by_hand(spark):
    told = {"a": "/data/r/x/y", "b": "/data/rest/z", "c": "x/../y", "d": {"path": "k" * 300, "size_bytes": 3, "sha256": "s"}, "e": None, "n" * 90: "p", "f": ""}
    docs = spark.createDataFrame([(1, "/data/r/", json.dumps({"artifacts": told})), (2, None, '{"artifacts": {"a": "/q/w", "b": "v"}}'), (3, "/", None), (4, "/", "{}")], "doc long, root string, json string")
    got = {(r["doc"], r["name"]): (r["ref"], r["size_bytes"], r["sha256"]) for r in diagnostics.artifact_refs(docs).collect()}
    assert got == {(1, "a"): ("x/y", None, None), (1, "b"): ("z", None, None), (1, "c"): ("y", None, None), (1, "d"): ("k" * 240, 3, "s"), (1, "n" * 80): ("p", None, None), (1, "f"): ("", None, None), (2, "a"): ("w", None, None), (2, "b"): ("v", None, None)}


def test_diagnostics_of_nothing(spark):
    records = spark.createDataFrame([(1, None), (2, "{")], "meeting_id long, previous string")
    tasks = spark.createDataFrame([(2, json.dumps({"error": {"stage": "harness", "failure_stage": "asr", "code": "", "message": "m" * 700}}))], "meeting_id long, task string")
    results = spark.createDataFrame([], "meeting_id long, result string")
    got = {r["meeting_id"]: r for r in diagnostics.failed_diagnostics(records, tasks, results).collect()}
    assert (got[1]["stage"], got[1]["code"], got[1]["message"], got[1]["diagnostic_source"]) == ("harness", "HARNESS_FAILED", "processing failed", "legacy_task_snapshot")
    assert (got[2]["stage"], got[2]["code"], len(got[2]["message"]), got[2]["return_code"]) == ("asr", "HARNESS_FAILED", 600, None)


def test_likeness_equals_a_plain_loop(spark):
    left = {1: {"a": "abcabba", "b": [1, 2], "c": {"y": 1, "x": None}}, 2: {"a": "q"}, 3: {"a": "x"}}
    right = {1: {"a": "cbabac", "b": [1, 2], "c": {"x": None, "y": 2}}, 2: {"a": ""}, 4: {}}
    got = rows(reviews.summary_likeness(*[spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()] + [(9, None)], "key long, json string") for d in (left, right)], ("a", "b", "c")))

    def text(d, f):
        return json.dumps(d[f], separators=(",", ":"), sort_keys=True) if f in d else None

    want = [(9, f, None, None) for f in "abc"]
    for k in (1, 2):
        for f in "abc":
            a, b = text(left[k], f), text(right[k], f)
            # a text at the top of a field stands without quotes
            a, b = (x.strip('"') if x is not None else None for x in (a, b))
            want.append((k, f, None, None) if a is None or b is None else (k, f, a == b, round(difflib.SequenceMatcher(None, a, b).ratio(), 6)))
    assert got == sorted(want, key=repr)


def test_windows_chunks_and_links_by_hand(spark):
    recordings = spark.createDataFrame([("a", 25.0), ("b", 20.0), ("c", 0.0), ("d", None)], "key string, duration double")
    results = spark.createDataFrame([("a", 0, "ok", None), ("a", 2, "failed", "lost"), ("a", 9, "ok", "beyond")], "key string, window long, status string, text string")
    windows = reviews.recording_windows(recordings, results, 10)
    assert rows(windows) == [("a", 0, 0.0, 10.0, "ok", None), ("a", 1, 10.0, 10.0, "missing", None), ("a", 2, 20.0, 5.0, "failed", None), ("b", 0, 0.0, 10.0, "missing", None), ("b", 1, 10.0, 10.0, "missing", None)]
    assert rows(reviews.recording_totals(windows)) == [("a", 3, 1, 1, 0), ("b", 2, 0, 2, 0)]
    of = spark.createDataFrame([(1, "s0", "A", "x", 5), (1, "s1", "B", None, 3)], "meeting_id long, segment_id string, speaker string, text string, start_ms long")
    chunks = spark.createDataFrame([(1, 0, ["s1", "s0", "s1"]), (1, 1, ["s0", "q", "p"]), (1, 2, []), (2, 0, None), (3, 0, ["s0"])], "meeting_id long, chunk long, segment_ids array<string>")
    members, faults = reviews.chunk_members(chunks, of)
    assert rows(members) == [(1, 0, 0, "s1", None), (1, 0, 1, "s0", "x"), (1, 0, 2, "s1", None)] and rows(faults) == [(1, 1, "q"), (3, 0, "s0")]
    evidence = spark.createDataFrame([(1, "e", ["s0", "s1", "s0"]), (1, "d", ["q"]), (1, "f", None), (1, "c", ["s1"])], "meeting_id long, evidence_id string, refs array<string>")
    there, back = reviews.evidence_links(evidence, of)
    assert rows(there) == [(1, "c", "s1", 3), (1, "d", None, None), (1, "e", "s1", 3), (1, "f", None, None)] and rows(back) == [(1, "s0", "e", 1), (1, "s1", "c", 2)]
    cited = reviews.cited_segments(evidence.select("meeting_id", F.col("evidence_id").alias("no"), "refs"), of)
    assert rows(cited) == [(1, 0, "s1", "B", None), (1, 1, "s0", "A", "x")]


def test_texts_with_something_behind_their_json(spark):
    texts = ['{"a": 1}', ' [1] \n', "null", '{"a": 1} x', '"a": 1', "1, 2", "", None, "{", '1], [2', "{}{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", documents.whole_json(F.col("t")).cast("string").alias("v"), documents.whole_json(F.col("t")).isNotNull().alias("is"))
    assert [r["i"] for r in df.where("is").orderBy("i").collect()] == [0, 1, 2]
    assert df.where("i = 1").first()["v"] == "[1]"


def test_records_by_hand(spark):
    asked = spark.createDataFrame([(1, 0, "tape"), (1, 1, "pc_record"), (1, 2, "local_upload"), (2, 0, "pc_record"), (3, 0, None)], "meeting_id long, place long, source_type string")
    asked = asked.selectExpr("*", "'t' AS title", "CAST(null AS string) AS language", "'dir.x/.wav' AS file_name", "CAST(null AS string) AS mime_type", "CAST(null AS long) AS size_bytes", "'now' AS now")
    got = records.create_records(asked, spark.createDataFrame([(2,), (2,)], "meeting_id long"))
    assert rows(got.select("meeting_id", "place", "outcome")) == [(1, 0, "unsupported_source"), (1, 1, "created"), (1, 2, "exists"), (2, 0, "exists"), (3, 0, "unsupported_source")]
    made = json.loads(got.where("json is not null").first()["json"])
    assert made["directory"] == "meetings/1" and made["detail"]["source"]["original_extension"] is None and not made["detail"]["source"]["requires_conversion"] and made["board_task"] is None
    stored = spark.createDataFrame([(1, json.dumps(made)), (2, json.dumps(made) + "x"), (3, "3"), (4, None)], "meeting_id long, json string")
    assert rows(records.decode_records(stored)) == [(1, None, "t", "created", "now"), (2, "not_json", None, None, None), (3, "wrong_shape", None, None, None), (4, "not_json", None, None, None)]
    files = spark.createDataFrame([("a/status.json",), ("a/final_json.txt",), ("b/status.json",), ("status.json",), ("final_json.txt",), (None,)], "path string")
    assert rows(records.complete_requests(files)) == [("",), ("a",)]
