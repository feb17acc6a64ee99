"""Queries and operators do the whole job, beyond what fits the small tables."""

import hashlib
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import modeltext, scalars
from chronoloom.operators import evaluation, mapreduce, packing, topics, validation
from chronoloom.plans import registry
from chronoloom.sources import adapters, formats

DIR = "/root/testdata/sf0.001"


def tree(parts, fan_in):
    level = 0
    while level == 0 or len(parts) > 1:
        parts, level = ["(" + "|".join(parts[i : i + fan_in]) + ")" for i in range(0, len(parts), fan_in)], level + 1
    return level, parts[0]


@pytest.mark.parametrize("fan_in", [2, 3])
def test_reduce_tree_ends_with_one_output(spark, fan_in):
    sizes = {1: 1, 2: 8, 3: 9, 4: 37}
    windows = [(m, 3 * i + 5, f"{m}.{i}") for m, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(windows, "meeting_id long, window long, output string")
    got = mapreduce.reduce_tree(df, lambda p: F.concat(F.lit("("), F.array_join(p, "|"), F.lit(")")), fan_in).collect()
    want = {m: tree([f"{m}.{i}" for i in range(n)], fan_in) for m, n in sizes.items()}
    assert len(got) == len(want) and {r["meeting_id"]: (r["level"], r["output"]) for r in got} == want
    assert max(r["level"] for r in got) == math.ceil(math.log(37, fan_in))


def test_reduce_tree_must_shrink(spark):
    df = spark.createDataFrame([(1, i, "x") for i in range(9)], "meeting_id long, window long, output string")
    join = lambda p: F.array_join(p, "|")
    with pytest.raises(ValueError):
        mapreduce.reduce_tree(df, join, 1)
    with pytest.raises(ValueError):
        mapreduce.reduce_tree(df, join, 2, 3)


def grams(t):
    t = re.sub(r"\s+", "", t)
    return [t[i : i + 2] for i in range(max(len(t) - 1, 1))] if t else []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_of_whole_texts(spark, tmp_path):
    texts = {1: "one two three four " * 40 + "the tail of this text says what no other part says", 2: "a b c 多字", 3: "lone", 4: "", 5: "<b>A</b> b c"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {name: {r[0]: r[1] for r in registry.queries()[name](spark, str(tmp_path)).collect()} for name in ("bigram_jaccard", "bigram_cosine", "char_error_rate", "token_error_rate")}
    for i in range(1, 5):
        a, b = texts[i], texts[i + 1]
        x, y = Counter(grams(a)), Counter(grams(b))
        (r, rt), (h, ht) = (("".join(re.findall("[0-9a-z一-鿿]", t)), re.findall("[一-鿿]|[0-9a-z]+", t)) for t in (re.sub("<[^>]+>", "", t).lower() for t in (a, b)))
        assert got["bigram_jaccard"][i] == pytest.approx(len(x.keys() & y.keys()) / len(x.keys() | y.keys()) if x and y else 0, abs=1e-6)
        dot = sum(x[g] * y[g] for g in x)
        if x or y:
            assert got["bigram_cosine"][i] == pytest.approx(dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) if dot else 0, abs=1e-6)
        assert got["char_error_rate"][i] == (pytest.approx(distance(h, r) / len(r), abs=1e-6) if r else None)
        assert got["token_error_rate"][i] == (pytest.approx(distance(ht, rt) / len(rt), abs=1e-6) if rt else None)


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_meeting(spark, name):
    out = {}
    for r in sorted(rows(registry.queries()[name](spark, DIR)), key=repr):
        out.setdefault(r["meeting_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def talks(spark):
    out = {}
    for r in rows(adapters.segments(spark, DIR)):
        out.setdefault(r["meeting_id"], []).append(r)
    return {m: sorted(v, key=lambda r: r["idx"]) for m, v in out.items()}


def cosine(x, y):
    x, y = Counter(grams(x)), Counter(grams(y))
    dot = sum(x[g] * y[g] for g in x)
    return dot / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))) if dot else 0.0


def test_blocks_are_cut_at_their_weakest_point(spark, talks):
    whole, cut = by_meeting(spark, "topic_blocks"), by_meeting(spark, "topic_blocks_capped")

    def split(part, opened):
        if len(part) <= 1 or math.ceil(sum(len(r["text"]) for r in part) / 1.3) <= 300:
            return [(part[0]["idx"], part[-1]["idx"], opened)]
        texts = [r["text"] for r in part]
        at = min(range(1, len(part)), key=lambda i: (cosine("".join(texts[max(0, i - 3) : i]), "".join(texts[i : i + 3])), i))
        return split(part[:at], opened) + split(part[at:], "size_split")

    assert any(r["opened_by"] == "size_split" for v in cut.values() for r in v)
    for m, found in whole.items():
        said = [r for r in talks[m] if r["text"].strip()]
        want = [x for b in sorted(found, key=lambda b: b["block"]) for x in split([r for r in said if b["first_idx"] <= r["idx"] <= b["last_idx"]], b["opened_by"])]
        got = sorted(cut[m], key=lambda b: b["block"])
        assert [(b["first_idx"], b["last_idx"], b["opened_by"]) for b in got] == want
        assert [b["block"] for b in got] == list(range(1, len(got) + 1))


def test_boundary_rules(spark):
    """A valley must be the lowest of its neighbours; changes from or to an unknown speaker don't count; short blocks join."""
    one, two = "alpha beta gamma delta " * 30, "one two three four five " * 30
    table = [(1, i, t, s, a, a + 900) for i, (t, s, a) in enumerate([(one, "speaker_0", 0), (one, "unknown", 1000), (one, "speaker_0", 2000), (two, "speaker_1", 3000), (two, "speaker_1", 4000), (two, "speaker_1", 9000), ("tiny", "speaker_1", 20000)])]
    df = spark.createDataFrame(table, "meeting_id long, idx long, text string, speaker string, start_ms long, end_ms long")
    found = {r["idx"]: (r["score"], r["reasons"]) for r in rows(topics.boundaries(df))}
    assert found[3] == (1.25, ["speaker", "cohesion"]) and found[1] == (0.0, []) and found[2] == (0.0, []) and found[5] == (1.0, ["gap"])
    got = [(r["first_idx"], r["last_idx"], r["opened_by"]) for r in sorted(rows(topics.blocks(topics.placed(df))), key=lambda r: r["block"])]
    assert got == [(0, 2, "start"), (3, 4, "speaker,cohesion"), (5, 6, "gap")]


def test_chunks_groups_and_bins(spark, talks):
    chunks, groups, bins = by_meeting(spark, "chunk_plan"), by_meeting(spark, "consecutive_groups"), by_meeting(spark, "bin_packing")
    for m, said in talks.items():
        cost = [(r["idx"], len(r["text"]) + 1) for r in said if r["text"].strip()]
        at, want = 0, []
        while at < len(cost):
            end, fit = at, None
            while end < len(cost):
                first = next((c for c in range(max(0, at - 1), at + 1) if sum(x for _, x in cost[c : end + 1]) <= 2000), None)
                if first is None:
                    break
                fit, end = (end + 1, first), end + 1
            want.append((cost[at][0], cost[fit[0] - 1][0], cost[fit[1]][0]) if fit else (cost[at][0], cost[at][0], cost[at][0]))
            at = fit[0] if fit else at + 1
        assert sorted((c["first_idx"], c["last_idx"], c["context_idx"]) for c in chunks.get(m, [])) == want
        out = []
        for r in said:
            n = len(r["text"])
            if out and out[-1][2] <= 500 and n <= 500 and out[-1][2] + n <= 500:
                out[-1][1:] = [r["idx"], out[-1][2] + n]
            else:
                out.append([r["idx"], r["idx"], n])
        assert sorted([g["first_idx"], g["last_idx"], g["cost"]] for g in groups[m]) == out
        room, where = [], {}
        for r in sorted(said, key=lambda r: (-len(r["text"]), r["idx"])):
            n = len(r["text"])
            if n > 1500:
                continue
            fits = [(left, i) for i, left in enumerate(room) if left >= n]
            i = min(fits)[1] if fits else len(room)
            room += [1500] * (i == len(room))
            room[i] -= n
            where.setdefault(i, set()).add(r["idx"])
        got = {}
        assert all(b["oversize"] == (b["bin"] is None) == (len(said[int(b["item"][4:])]["text"]) > 1500) for b in bins[m])
        for b in bins[m]:
            if b["oversize"]:
                continue
            got.setdefault(b["bin"], set()).add(int(b["item"][4:]))
        assert [got[k] for k in sorted(got)] == sorted(where.values(), key=min)


def test_oversize_is_told(spark):
    df = spark.createDataFrame([(1, 0, "x" * 50), (1, 1, "y" * 5), (1, 2, "z" * 5)], "meeting_id long, idx long, text string")
    got = sorted(rows(packing.chunk_plan(df, 20, 1)), key=lambda r: r["first_idx"])
    assert [(r["chunk"], r["first_idx"], r["last_idx"], r["oversize"]) for r in got] == [(None, 0, 0, True), (0, 1, 2, False)]
    with pytest.raises(Exception, match="exceeds the budget"):
        packing.fail_on_oversize(packing.chunk_plan(df, 20, 1)).collect()


def test_windows_cover_all_units(spark):
    units = {}
    for r in rows(registry.queries()["window_units"](spark, DIR)):
        units.setdefault(r["meeting_id"], []).append(r)
    stamp = lambda ms: f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
    line = lambda u: f"[turn {u['turn_id']:04d}{'.' + str(u['part']) if u['parts'] > 1 else ''}][{stamp(u['start_ms'])}-{stamp(u['end_ms'])}] {u['speaker']}: {u['text']}"
    windows = by_meeting(spark, "window_plan")
    for m, own in units.items():
        own.sort(key=lambda u: (u["start_ms"], u["end_ms"], u["turn_id"], u["part"]))
        found = sorted(windows[m], key=lambda w: w["win"])
        assert found[0]["first_no"] == 0 and found[-1]["last_no"] == len(own) - 1
        for a, b in zip(found, found[1:]):
            assert a["first_no"] < b["first_no"] <= a["last_no"] + 1
        for w in found:
            part = own[w["first_no"] : w["last_no"] + 1]
            assert w["chars"] == len("\n".join(map(line, part))) and w["turn_ids"] == ",".join(map(str, sorted({u["turn_id"] for u in part})))
            assert len(part) == 1 or (w["chars"] + 1 <= 900 and len({u["turn_id"] for u in part}) <= 4)
    assert packing.sentence_chunks("一句。二句！three? rest of it", 8) == [(0, 6, "一句。二句！"), (6, 13, "three?"), (13, 21, "rest of "[:8].strip()), (21, 23, "it")]
    assert packing.choose_end([40, 40, 40, 40], ["a", "b", "b", "b"], [0, 10, 20, 9000], [5, 15, 25, 9001], 0, 4, 100) == 4
    assert packing.choose_end([40, 40, 40, 40, 9], ["a", "a", "b", "b", "b"], [0] * 5, [0] * 5, 0, 4, 100) == 2


def test_labels_map_one_to_one():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(40):
        a, b = [f"p{i}" for i in range(rng.randrange(1, 5))], [f"r{i}" for i in range(rng.randrange(4, 6))]
        value = {(x, y): rng.randrange(4) for x in a for y in b}
        best = max(itertools.permutations(b, len(a)), key=lambda p: sum(value[x, y] for x, y in zip(a, p)))
        assert evaluation.assign(a, b, value) == list(best)


def test_model_text():
    assert modeltext.first_object_text('x {"a": "}{"} y {') == '{"a": "}{"}' and modeltext.first_object_text("{ { }") == "{ }" and modeltext.first_object_text("none") is None
    assert modeltext.ascii_marks_text('｛"a：": １}') == '{"a：": 1}' and json.loads(modeltext.escape_controls_text('{"a": "x\ny"}')) == {"a": "x\ny"}


def test_readers_and_writers(spark, tmp_path):
    d = str(tmp_path)
    files = {
        "a.rttm": "SPEAKER f 1 0.5 1.25 <NA> <NA> spk0 <NA>\nnoise\nSPEAKER f 1 2 0 <NA> <NA> spk1 <NA>\n", "t.txt": "[seg-000001][0m00s-0m05s][speaker_0] hello\nodd\n[seg-000001][0m05s-0m05s][speaker_1]  \n",
        "g.TextGrid": 'item [1]:\n name = "A"\n intervals [1]:\n xmin = 0\n xmax = 1.5\n text = "say ""hi"""\n intervals [2]:\n xmin = 1.5\n xmax = 2\n text = "<sil>"\n',
        "l.jsonl": '{"job_id": "a", "n": 1}\nbroken\n{"n": 2}\n', "m.csv": "file,start,end,duration\nx.wav,1,3,\ny.wav,1,3,9\n", "turns.json": '{"turns": [{"id": 1, "start": 0.5, "end": 1, "speaker": " s ", "text": "x", "chunk_ids": [1]}, {"id": 1, "start": 2, "end": 1, "speaker": "", "text": "y", "chunk_ids": [0]}]}',
        "seg.json": '[{"index": 3, "start": 0.0005, "end": 2.5, "speaker": "1", "text": " a  b ", "status": "ok"}]', "plan.json": '[{"start": 0, "end": 1.5, "speaker": "a"}, {"start": 2, "end": 2}]', "plan.csv": "start,end,speaker\n0,1.5,a\n2,2,b\n",
        "dia.json": '{"segments": [{"start": 1, "end": 2, "label": "x"}, {"start": 3, "end": 3, "speaker": "y"}]}', "bad.json": "{",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert [(r["start_ms"], r["end_ms"], r["speaker"], r["source_ids"]) for r in rows(formats.read_rttm(spark, f"{d}/a.rttm"))] == [(500, 1750, "spk0", ["rttm:1"])]
    line = formats.read_timeline(spark, f"{d}/t.txt")
    assert [(r["segment_id"], r["start_s"], r["end_s"], r["speaker"]) for r in rows(line)] == [("seg-000001", 0, 5, "speaker_0"), ("seg-000001", 5, 5, "speaker_1")]
    assert {r["check"] for r in rows(formats.check_timeline(line))} == {"not_increasing", "end_before_start", "blank_text"}
    grid = formats.read_textgrid(spark, f"{d}/g.TextGrid")
    assert [(r["tier"], r["start_ms"], r["end_ms"], r["text"]) for r in rows(grid)] == [("A", 0, 1500, 'say "hi"')] and rows(formats.textgrid_text(grid, "A"))[0]["text"] == 'say "hi"'
    good, bad = formats.read_json_lines(spark, f"{d}/l.jsonl", "job_id string, n long", "job_id")
    assert rows(good) == [{"job_id": "a", "n": 1}] and bad.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        formats.read_strict_lines(spark, f"{d}/l.jsonl", "job_id string, n long").collect()
    assert [r["duration"] for r in rows(formats.read_manifest(spark, f"{d}/m.csv"))] == [2.0, 9.0]
    turns = formats.read_turns(spark, f"{d}/turns.json")
    assert [(r["start_ms"], r["speaker"], r["speaker_kind"]) for r in rows(turns)] == [(500, "s", "main"), (2000, "", "main")]
    assert {r["check"] for r in rows(validation.check_turns(turns.withColumn("meeting_id", F.lit(1))))} == {"duplicate_id", "invalid_range", "blank_speaker", "bad_chunk_ids"}
    assert [(r["segment_id"], r["start_ms"], r["end_ms"], r["speaker"], r["text"]) for r in rows(formats.read_transcript(spark, f"{d}/seg.json"))] == [("seg-000003", 0, 2500, "speaker_1", "a b")]
    for kind in ("json", "csv"):
        assert [(r["speaker"], r["start_ms"], r["end_ms"]) for r in rows(formats.read_plan(spark, f"{d}/plan.{kind}", kind))] == [("a", 0, 1500)]
    assert [(r["speaker"], r["end_ms"]) for r in rows(formats.read_diarization(spark, f"{d}/dia.json"))] == [("x", 2000)]
    assert [r["doc"] for r in rows(formats.read_document_or_null(spark, f"{d}/bad.json", "a long"))] == [None]
    name = spark.createDataFrame([("p/seg_3_spk_1_0.5_2.wav",), ("p/other.wav",)], "path string")
    manifest = spark.createDataFrame([("seg_3_spk_1_0.5_2.wav", 9.0, None)], "file string, start double, end double")
    assert [(r["idx"], r["speaker"], r["start_s"], r["end_s"]) for r in rows(formats.find_segments(name, manifest))] == [(3, "spk_1", 9.0, 2.0)]
    assert {r["path"].rsplit("/", 1)[1] for r in rows(formats.list_files(spark, d))} == set(files)
    hashes = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in rows(formats.file_hashes(spark, d))}
    assert hashes["bad.json"] == hashlib.sha256(b"{").hexdigest()
    formats.write_lines(line, F.col("text"), f"{d}/lines", [F.col("start_s")])
    assert [r["value"] for r in spark.read.text(f"{d}/lines").collect()] == ["hello", " "]
    formats.write_table(line, f"{d}/table", ["segment_id", "missing"])
    assert rows(spark.read.csv(f"{d}/table", header=True)) == [{"segment_id": "seg-000001", "missing": None}] * 2
    formats.write_document(good, f"{d}/doc")
    formats.append_lines(good, f"{d}/doc")
    assert spark.read.json(f"{d}/doc").count() == 2
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {(r["k"], r["v"]) for r in rows(formats.upsert(old, new, ["k"]))} == {(1, "a"), (2, "c")} and formats.delete_keys(old, new, ["k"]).count() == 1


def test_scalar_rules(spark):
    df = spark.createDataFrame([("\x1b[1mfinal result: \"Hello there all\"",), ("load model 3 ms",), ("我们开始",), (None,)], "t string")
    got = [tuple(r) for r in df.select(scalars.clean_candidate(F.col("t")), scalars.is_transcript_line(F.col("t")), scalars.bool_of(F.col("t")), scalars.integer_or(F.col("t"), 7)).collect()]
    assert got[0][0] == "Hello there all" and [g[1] for g in got[1:3]] == [False, True] and got[3][2:] == (False, 7)
    lines = spark.range(1).select(scalars.clean_lines(F.lit(" a  b\r\n\n\x1b[0m c ")).alias("x")).first()["x"]
    assert lines == "a b\nc"
