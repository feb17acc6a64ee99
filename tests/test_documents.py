"""Nested documents, their files, exports and the stateful stream against plain versions."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import documents, exports
from chronoloom.operators.tables import exists
from chronoloom.streaming import events as streams
from chronoloom.streaming import products

SCHEMA = {"id": "number", "tags": ["string|null"], "meta": {"lang": "string", "deep?": {"list": [{"a": "number", "b?": "boolean"}]}}}


def rows(df):
    return [r.asDict() for r in df.collect()]


def kind_of(x):
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def plain_faults(x, schema, path="$"):
    kinds = ["object"] if isinstance(schema, dict) else ["array"] if isinstance(schema, list) else schema.split("|")
    if kind_of(x) not in kinds:
        return [(path, "wrong_type", kind_of(x))]
    out = []
    if isinstance(schema, dict):
        names = {k.rstrip("?"): v for k, v in schema.items()}
        for key, inner in schema.items():
            if key.rstrip("?") in x:
                out += plain_faults(x[key.rstrip("?")], inner, f"{path}.{key.rstrip('?')}")
            elif not key.endswith("?"):
                told = "object" if isinstance(inner, dict) else "array" if isinstance(inner, list) else inner
                out.append((f"{path}.{key}", "missing", told))
        out += [(f"{path}.{k}", "extra", kind_of(v)) for k, v in x.items() if k not in names]
    elif isinstance(schema, list):
        for i, item in enumerate(x):
            out += plain_faults(item, schema[0], f"{path}[{i}]")
    return out


def anything(rng, depth=0):
    kind = rng.choice(["s", "n", "b", "z", "o", "l"] if depth < 4 else ["s", "n"])
    if kind == "o":
        return {rng.choice(["id", "tags", "meta", "lang", "deep", "list", "a", "b", "x"]): anything(rng, depth + 1) for _ in range(rng.randrange(5))}
    if kind == "l":
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"s": "text é", "n": rng.choice([1, -2.5, 10**12]), "b": True, "z": None}[kind]


def test_faults_of_random_documents(spark):
    rng = random.Random(1)
    made = []
    for i in range(150):
        doc = {"id": i, "tags": ["a", None], "meta": {"lang": "en", "deep": {"list": [{"a": 1, "b": True}, {"a": 2}]}}}
        for _ in range(rng.randrange(4)):
            place = rng.choice([doc, doc["meta"] if isinstance(doc.get("meta"), dict) else doc])
            key = rng.choice(["id", "tags", "meta", "lang", "deep", "x"])
            if rng.random() < 0.4:
                place.pop(key, None)
            else:
                place[key] = anything(rng)
        made.append(doc)
    made += [[], 5, None, "text", {}, {"meta": {"deep": {"list": [{"a": "x"}, 3, {"b": None, "a": 1}]}}}]
    table = [(i, json.dumps(x)) for i, x in enumerate(made)] + [(900, "{"), (901, ""), (902, None)]
    got = sorted(map(repr, ((r["doc"], r["path"], r["fault"], r["told"]) for r in rows(documents.violations(spark.createDataFrame(table, "doc long, json string"), SCHEMA)))))
    want = [(i, *f) for i, x in enumerate(made) for f in plain_faults(x, SCHEMA)] + [(i, "$", "not_json", None) for i in (900, 901, 902)]
    assert got == sorted(map(repr, want)) and len({f[2] for f in want}) == 4


def plain_bounded(x, bounds, path="$", depth=0):
    """(kept, cuts) of one value; keys in the order of their names."""
    most, keys, items, text = bounds
    if isinstance(x, (dict, list)):
        kept, cuts = [(path, kind_of(x), None)], []
        inner = [(f"{path}.{k}", x[k]) for k in sorted(x)] if isinstance(x, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(x)]
        if inner and depth == most:
            return kept, [(path, "depth", None)]
        room = keys if isinstance(x, dict) else items
        if len(inner) > room:
            cuts.append((path, "keys" if isinstance(x, dict) else "items", len(inner) - room))
        for p, v in inner[:room]:
            k, c = plain_bounded(v, bounds, p, depth + 1)
            kept, cuts = kept + k, cuts + c
        return kept, cuts
    if isinstance(x, str):
        return [(path, "string", x[:text])], [(path, "text", len(x) - text)] if len(x) > text else []
    return [(path, kind_of(x), None if x is None else json.dumps(x))], []


@pytest.mark.parametrize("bounds", [(2, 3, 2, 4), (3, 24, 16, 600), (0, 1, 1, 1)])
def test_bounded_projections(spark, bounds):
    rng = random.Random(2)
    made = [anything(rng) for _ in range(80)] + [{"a": {"b": {"c": {"d": 1}}}, "l": list(range(40)), "t": "é" * 700}]
    made = [x if not isinstance(x, float) else 1 for x in made]
    df = spark.createDataFrame([(i, json.dumps(x).replace("-2.5", "25").replace(str(10**12), "12")) for i, x in enumerate(made)], "doc long, json string")
    made = [json.loads(json.dumps(x).replace("-2.5", "25").replace(str(10**12), "12")) for x in made]
    kept, cuts = (rows(x) for x in documents.bounded(df, *bounds))
    want = [plain_bounded(x, bounds) for x in made]
    assert sorted(map(repr, ((r["doc"], r["path"], r["kind"], r["value"]) for r in kept))) == sorted(repr((i, *k)) for i, (ks, _) in enumerate(want) for k in ks)
    assert sorted(map(repr, ((r["doc"], r["path"], r["cut"], r["n"]) for r in cuts))) == sorted(repr((i, *c)) for i, (_, cs) in enumerate(want) for c in cs)


def test_long_keys_are_told(spark):
    _, cuts = documents.bounded(spark.createDataFrame([(1, json.dumps({"k" * 90: 1}))], "doc long, json string"))
    assert [(r["cut"], r["n"]) for r in rows(cuts)] == [("key", 10)]


def test_files_are_seen_whole_or_not_at_all(spark):
    folder = "file://" + tempfile.mkdtemp() + "/exports"
    kind = "key long, name string, json string"
    assert rows(documents.read_documents(spark, folder)) == []
    first = [(k, n, json.dumps({"k": k, "t": "é\nline"})) for k in range(6) for n in ("a.json", "b.json")]
    told = rows(documents.write_documents(spark.createDataFrame(first, kind), folder))
    assert len(told) == 12 and len({r["file"] for r in told}) == 12 and exists(spark, f"{folder}/CURRENT")
    assert sorted((r["key"], r["name"], r["json"]) for r in rows(documents.read_documents(spark, folder))) == sorted((str(k), n, j) for k, n, j in first)
    # a run that fails leaves the one before in place
    with pytest.raises(ValueError):
        documents.write_documents(spark.createDataFrame([(1, "a.json", "{}"), (1, "a.json", "[]")], kind), folder)
    broken = spark.createDataFrame(first, kind).withColumn("json", F.when(F.col("key") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="no"):
        documents.write_documents(broken, folder)
    assert len(rows(documents.read_documents(spark, folder))) == 12
    documents.write_documents(spark.createDataFrame(first[:3], kind), folder)
    assert len(rows(documents.read_documents(spark, folder))) == 3


def test_bundles_with_faults(spark):
    names = sorted(exports.BUNDLE)
    good = [(1, n, json.dumps({"TaskId": "t"})) for n in names]
    bad = [(2, n, json.dumps({"TaskId": f"t{n}"})) for n in names] + [(3, n, "{}") for n in names[:3]] + [(4, n, json.dumps({"TaskId": "t"})) for n in [*names, names[0]]]
    got = {(r["meeting_id"], r["fault"]) for r in rows(exports.bundle_faults(spark.createDataFrame(good + bad, "meeting_id long, name string, json string")))}
    assert got == {(2, "task_ids"), (3, "unexpected_files"), (3, "task_ids"), (4, "unexpected_files")}


def test_items_that_cite_nothing_and_empty_meetings(spark):
    kind = "meeting_id long, idx long, segment_id string, speaker string, start_ms long, end_ms long, text string"
    sentences = exports.sentence_index(spark.createDataFrame([(1, 0, "s0", "a", 0, 5, ""), (1, 1, "s1", "a", 5, 9, "x"), (1, 2, "s2", "b", 4, 30, "y")], kind))
    meetings = spark.createDataFrame([(1, "t1", None, None), (2, "t2", 7, "f.wav")], "meeting_id long, task_id string, duration_ms long, source_audio string")
    items = spark.createDataFrame([(1, "sentence", 3, "p", ["s1", "s2", "s9"]), (1, "sentence", 1, "none", ["s0"]), (1, "action", 0, "do", [])], "meeting_id long, kind string, no long, text string, refs array<string>")
    got = {r["meeting_id"]: json.loads(r["json"])["MeetingAssistance"] for r in rows(exports.assistance(meetings, sentences, items, spark.createDataFrame([], "meeting_id long, no long, keyword string")))}
    assert got[1] == {"Keywords": [], "KeySentences": [{"Id": 1, "SentenceId": 2, "Start": 4, "End": 30, "Text": "p"}], "Actions": []} and got[2] == {"Keywords": [], "KeySentences": [], "Actions": []}
    told = {r["meeting_id"]: json.loads(r["json"]) for r in rows(exports.transcription(meetings, sentences))}
    assert told[2] == {"TaskId": "t2", "Transcription": {"AudioInfo": {"Duration": 7, "SourceAudio": "f.wav"}, "Paragraphs": []}} and len(told[1]["Transcription"]["Paragraphs"]) == 2


def test_stream_is_the_batch_fold_of_shuffled_repeated_and_late_events(spark):
    rng = random.Random(4)
    base = tempfile.mkdtemp()
    kind = "product long, event_id long, event_type string, ts timestamp"
    start = 1_700_000_000
    events = [(rng.randrange(6), i, rng.choice("abc"), start + i * 60 + rng.randrange(600)) for i in range(400)]  # in order but for ten minutes
    events += [(9, 1000 + i, "early", start + i) for i in range(3)]  # a product that falls silent
    late = [(0, 5000, "too_late", start - 86_400), (1, 5001, "too_late", start)]
    files = [sorted(events, key=lambda e: e[1] if e[1] < 1000 else -1)[k::1] for k in (0,)][0]
    parts = [files[:150], files[100:300], files[250:], late]  # parts repeat one another's events
    stream_dir = f"{base}/in"
    for k, part in enumerate(parts):
        rng.shuffle(part)
        made = spark.createDataFrame([(p, i, t, s) for p, i, t, s in part], "product long, event_id long, event_type string, s long").select("product", "event_id", "event_type", F.timestamp_seconds("s").alias("ts"))
        made.coalesce(1).write.mode("append").parquet(stream_dir)
        source = spark.readStream.schema(kind).parquet(stream_dir)
        got = rows(products.run_updates(products.product_records(source, "30 minutes", 3600), f"file://{base}/out", f"file://{base}/check"))
    want = {}
    for p, i, t, s in sorted(set(events), key=lambda e: (e[3], e[1])):
        n, first = want.get(p, (None, 0, s))[1:3]
        want[p] = (t, n + 1, first, s, i)
    assert {r["product"]: (r["state"], r["n"], r["first_us"] // 10**6, r["last_us"] // 10**6, r["last_id"]) for r in got} == want
    assert {r["product"] for r in got if r["expired"]} == {9}


def test_a_stream_reads_a_single_table(spark):
    out = streams.read_stream(spark, "/root/testdata/sf0.001/events.parquet")
    assert out.isStreaming


def test_reports_of_missing_and_broken_artifacts(spark):
    from chronoloom.operators import report

    table = [(1, "usage", "a", '{"usage": {"total": 7}}'), (1, "usage", "b", '{"tokens": 5, "usage": [1]}'), (1, "memory", "c", "{"), (2, "other", "d", '{"stages": {"x": {"status": "done"}, "y": {"status": "failed", "elapsed": 2.5}}}'), (3, "error", "e", "[]"), (3, "error", "f", '{"code": null}')]
    got = {}
    for r in rows(report.report(report.facts(spark.createDataFrame(table, "run long, artifact string, file string, json string")))):
        got[r["run"], r["section"], r["measure"]] = r["value"]
    assert len(got) == 3 * len(report.MEASURES)
    told = {k: v for k, v in got.items() if v}
    assert told == {(1, "artifacts", "documents"): 3, (1, "artifacts", "broken"): 1, (1, "requests", "requests"): 2, (1, "requests", "tokens"): 12, (2, "artifacts", "documents"): 1, (2, "stages", "done"): 1, (2, "stages", "failed"): 1, (2, "stages", "elapsed"): 2.5, (3, "artifacts", "documents"): 2, (3, "errors", "errors"): 1}
