"""Folds, frontiers, ledgers, logs and wavefronts against plain sequential versions, with edge cases and hot groups."""

import math
import random
import re
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars
from chronoloom.operators import carryover, evaluation, frontier, ledger, logs, sequence, topics, units
from chronoloom.plans import deep
from chronoloom.sources import adapters

DIR = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- units

def plain_units(segments, gap=500, bridge=300, least=500, least_boundary=1500, least_fragment=700, boundary=True, fragments=False, unknown=False):
    """One segment after another, with the open unit and the fragment that waits."""
    done, unit, waiting = [], None, None

    def kind_of(s):
        return {"unknown_boundary": "boundary", "unknown_fragment": "fragment"}.get(s, "main" if s.startswith("speaker_") else "unknown")

    for _, idx, name, speaker, a, b in segments:
        kind, long = kind_of(speaker), b - a
        if kind == "fragment" and not fragments:
            if unit and long <= bridge and a - unit["end"] <= gap:
                waiting = (name, b)
            else:
                done, unit, waiting = done + [unit] * bool(unit), None, None
            continue
        wanted = {"main": long >= least, "boundary": boundary and long >= least_boundary, "fragment": fragments and long >= least_fragment, "unknown": unknown and long >= least}[kind]
        if kind == "main" and wanted and unit and unit["speaker"] == speaker and a - (waiting[1] if waiting else unit["end"]) <= gap:
            unit["ids"] += ([waiting[0]] if waiting else []) + [name]
            unit["bridged"] += [waiting[0]] if waiting else []
            unit["end"], waiting = b, None
            continue
        done, unit, waiting = done + [unit] * bool(unit), None, None
        if wanted:
            fresh = {"speaker": speaker, "start": a, "end": b, "ids": [name], "bridged": []}
            if kind == "main":
                unit = fresh
            else:
                done.append(fresh)
    done += [unit] * bool(unit)
    return [(u["speaker"], u["start"], u["end"], ",".join(u["ids"]), ",".join(u["bridged"])) for u in done]


def voices(rng, meeting, n):
    out, t = [], 0
    for i in range(n):
        t += rng.choice([0, 100, 499, 500, 501, 900])
        speaker = rng.choice(["speaker_0"] * 5 + ["speaker_1", "unknown_boundary", "unknown", "unknown_fragment", "unknown_fragment"])
        long = rng.choice([100, 299, 300, 301]) if speaker == "unknown_fragment" else rng.choice([300, 500, 800, 1500, 4000])
        out.append((meeting, i * 2, f"s{i}", speaker, t, t + long))
        t += long
    return out


@pytest.mark.parametrize("more", [{}, {"fragments": True, "unknown": True}, {"boundary": False, "merge_gap": 100, "bridge": 1000}])
def test_units_of_a_hot_meeting(spark, more):
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = [voices(rng, 1, 1500), voices(rng, 2, 300)] + [voices(rng, m, 6) for m in range(3, 30)]
        df = spark.createDataFrame([r for t in table for r in t], "meeting_id long, idx long, segment_id string, speaker string, start_ms long, end_ms long")
        got = rows(units.unit_rows(units.mark_units(df, **more)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = {"merge_gap": "gap"}
    for t in table:
        mine = sorted((r for r in got if r["meeting_id"] == t[0][0]), key=lambda r: r["unit"])
        assert [r["unit"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["speaker"], r["start_ms"], r["end_ms"], r["source_ids"], r["bridged_ids"]) for r in mine] == plain_units(t, **{names.get(k, k): v for k, v in more.items()})


def test_units_without_merging_and_empty(spark):
    kind = "meeting_id long, idx long, segment_id string, speaker string, start_ms long, end_ms long"
    df = spark.createDataFrame([(1, i, f"s{i}", "speaker_0", i * 1000, i * 1000 + 900 * (i != 2)) for i in range(5)], kind)
    assert [r["source_ids"] for r in sorted(rows(units.unit_rows(units.mark_units(df, merge=False))), key=lambda r: r["unit"])] == ["s0", "s1", "s3", "s4"]
    assert rows(units.unit_rows(units.mark_units(spark.createDataFrame([], kind)))) == []


# ---- chapters

def test_chapters_of_a_first_block_that_goes_on(spark):
    kind = "meeting_id long, block long, title string, summary string, key_points array<string>, anchors array<string>, start_ref string, end_ref string, refs array<string>, continues_previous boolean"
    told = [(1, 0, "a", "one two", ["p"], None, "s0", "s1", ["s0", "s9"], True), (1, 1, "b", "one  two", ["p", "q"], ["x"], "s1", "s2", ["s2", "s0"], True), (1, 2, "c", "x", [], [], "s2", "s2", [], True), (1, 3, "d", "new", [], [], "s9", "s9", ["s9"], None)]
    seg = spark.createDataFrame([(1, f"s{i}", f"speaker_{i % 2}", i * 10, i * 10 + 5) for i in range(3)], "meeting_id long, segment_id string, speaker string, start_ms long, end_ms long")
    one, two = sorted(rows(units.fold_chapters(spark.createDataFrame(told, kind), seg)), key=lambda r: r["chapter"])
    assert (one["blocks"], one["title"], one["overview"], one["key_points"], one["anchors"], one["refs"]) == (3, "a", "one two；x", ["p", "q"], ["x"], ["s0", "s9", "s2"])
    assert (one["speakers"], one["start_ms"], one["end_ms"]) == (["speaker_0"], 0, 25) and (two["overview"], two["speakers"], two["start_ms"], two["end_ms"]) == ("new", [], 0, 0)


# ---- frontiers

def test_split_keeps_every_item_once(spark):
    rng = random.Random(5)
    items = [(f"b{b}", p, rng.randrange(1, 90)) for b in range(12) for p in range(rng.randrange(1, 20))] + [("alone", 0, 500), ("bad", 0, 1), ("bad", 1, 1)]

    def attempt(df):
        told = df.groupBy("request_id").agg(F.sum("cost").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cost"))), lambda x: x["cost"].cast("string")), "+").alias("output"))
        outcome = F.when(F.col("request_id").startswith("bad"), "invalid_json").when(F.col("c") > 100, "length").otherwise("ok")
        return told.select("request_id", outcome.alias("outcome"), "output")

    lineage, outputs = (rows(x) for x in frontier.split_on_length(spark.createDataFrame(items, "request_id string, pos long, cost long"), attempt))
    assert len({r["request_id"] for r in lineage}) == len(lineage) and max(r["depth"] for r in lineage) == 3
    by = {r["request_id"]: r for r in lineage}
    for r in lineage:
        kids = [x for x in lineage if x["parent_id"] == r["request_id"]]
        assert (len(kids) == 2) == (not r["final"]) and (r["final"] or sum(x["n"] for x in kids) == r["n"])
        assert r["depth"] == 0 or by[r["parent_id"]]["outcome"] == "length"
    assert by["bad"]["final"] and by["alone"]["final"] and "alone-split-1" not in by
    for root in {i[0] for i in items}:
        mine = sorted((r["request_id"], r["output"]) for r in outputs if r["request_id"].split("-split")[0] == root)
        costs = [c for b, p, c in sorted(items) if b == root]
        lost = [r for r in lineage if r["final"] and r["outcome"] != "ok" and r["request_id"].split("-split")[0] == root]
        assert sum(len(o.split("+")) for _, o in mine) + sum(r["n"] for r in lost) == len(costs)
        assert lost or [int(x) for _, o in mine for x in o.split("+")] == costs


def packed(costs, budget):
    groups, used = [], 0
    for i, c in enumerate(costs):
        if groups and used + c <= budget:
            groups[-1].append(i)
            used += c
        else:
            groups.append([i])
            used = c
    return groups


def test_budgeted_groups_of_a_hot_meeting(spark):
    rng = random.Random(6)
    table = {1: [rng.choice([0, 1, 5, 30, 99, 100, 150]) for _ in range(2000)], 2: [200, 200, 200], 3: [0] * 50, 4: [7]}
    df = spark.createDataFrame([(m, 3 * i, c) for m, cs in table.items() for i, c in enumerate(cs)], "meeting_id long, node long, cost long")
    got = rows(frontier.budgeted_groups(df, 100))
    for m, costs in table.items():
        mine = sorted((r["node"], r["group"]) for r in got if r["meeting_id"] == m)
        assert [g for _, g in mine] == [g for g, group in enumerate(packed(costs, 100)) for _ in group]


def test_merges_end_with_one_root_or_an_error(spark):
    rng = random.Random(7)
    table = {m: ["x" * rng.randrange(1, 30) for _ in range(n)] for m, n in ((1, 1), (2, 40), (3, 7), (4, 100))}
    df = spark.createDataFrame([(m, i, o) for m, os in table.items() for i, o in enumerate(os)], "meeting_id long, node long, output string")
    short = lambda x: F.substring(F.array_join(x, ""), 1, 12)
    roots, lineage = frontier.merge_in_budget(df, short, F.length, 40)
    got, told = {r["meeting_id"]: (r["round"], r["output"]) for r in rows(roots)}, rows(lineage)
    for m, os in table.items():
        n = 0
        while len(os) > 1:
            groups, n = packed([len(o) for o in os], 40), n + 1
            mine = sorted((r["grp"], r["n"], r["cost"]) for r in told if (r["meeting_id"], r["round"]) == (m, n))
            assert mine == [(g, len(x), sum(len(os[i]) for i in x)) for g, x in enumerate(groups)] and all(r[2] <= 40 for r in mine)
            os = ["".join(os[i] for i in x)[:12] for x in groups]
        assert got[m] == (n, os[0])
    with pytest.raises(ValueError):
        frontier.merge_in_budget(df, short, F.length, 20)[0].collect()


# ---- ledger

def test_ledger_isolates_resumes_and_forgets_nothing(spark):
    folder = "file://" + tempfile.mkdtemp() + "/ledger"
    table = [(1, i, t) for i, t in enumerate(["a", "bb", "seven77", "", None, "fine", "fourteen chars"])]
    df = spark.createDataFrame(table, "meeting_id long, window long, text string")

    def work(text):
        if text == "bb":
            raise KeyError("late")
        return deep.digest_of(text)

    first = {r["window"]: r for r in rows(ledger.map_with_ledger(df, work, folder, "1", attempts=2, slices=3))}
    assert {w: r["status"] for w, r in first.items()} == {0: "ok", 1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "ok", 6: "failed"}
    assert (first[1]["error_type"], first[4]["error_type"], first[2]["attempts"], first[0]["attempts"]) == ("KeyError", "TypeError", 2, 1)
    assert first[2]["placeholder"] == "MAP window 2 failed: a multiple of seven (digest_of)" and first[0]["placeholder"] is None
    n = ledger.read_ledger(spark, folder).count()
    again = {r["window"]: r for r in rows(ledger.map_with_ledger(df, work, folder, "1", attempts=2, slices=3))}
    assert again == first and ledger.read_ledger(spark, folder).count() == n
    # a part that was never committed isn't read; a text that has changed and another version are mapped anew
    ledger.read_ledger(spark, folder).limit(1).coalesce(1).write.parquet(f"{folder}/part-killed")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-killed/_SUCCESS"), False)
    assert ledger.read_ledger(spark, folder).count() == n
    changed = {r["window"]: r for r in rows(ledger.map_with_ledger(df.withColumn("text", F.when(F.col("window") == 2, "mended").otherwise(F.col("text"))), work, folder, "1", attempts=2, slices=3))}
    assert changed[2]["status"] == "ok" and changed[2]["attempts"] == 1 and changed[0] == first[0]
    assert {r["attempts"] for r in rows(ledger.map_with_ledger(df, work, folder, "2", slices=3))} == {1}
    assert rows(ledger.totals(ledger.map_with_ledger(df, work, folder, "2", slices=3))) == [{"meeting_id": 1, "status": "partial", "map_results": 7, "failed": 5}]


# ---- logs

def plain_transcript(text, looks, clean):
    """The rules read one line at a time; looks and clean are the library's rules for single lines."""
    lines = [x.strip() for x in re.sub(r"\x1b\[[0-9;?]*[A-Za-z]", "", text).replace("\r", "\n").split("\n") if x.strip()]
    for i, line in enumerate(lines):
        hit = next((m for p in logs.OPENING if (m := re.search(p, line, re.I))), None)
        if not hit:
            continue
        said = [clean[hit[1]]] if clean[hit[1]] else []
        for later in lines[i + 1 :]:
            if any(re.search(p, later, re.I) for p in logs.CLOSING):
                break
            if clean[later] and looks[clean[later]]:
                said.append(clean[later])
        if said:
            return "\n".join(said), "block"
    for i, line in enumerate(lines):
        for p in logs.NAMING:
            if m := re.search(p, line, re.I):
                for x in [m[1], *lines[i + 1 : i + 2]]:
                    if clean[x] and looks[clean[x]]:
                        return clean[x], "named"
    return "", "none"


def test_logs_with_unclosed_interleaved_and_named_results(spark):
    rng = random.Random(8)
    pieces = ["text res: ", "text res: hi", "Final Commit Result： some spoken words", "------", "RTF = 0.4", "we talk about many things", "result: another long thing said", "[I] load model now", "\x1b[31m我们开始\x1b[0m", "short", "", "  ", "ASR Result: ok", "Recognition Result: the words of this one", "Final Result:", "a\rb and some more letters here"]
    table = {f"f{k}": [rng.choice(pieces) for _ in range(rng.randrange(12))] for k in range(150)}
    table["hot"] = ["nothing here"] * 700 + ["text res:"] + ["words are said in line"] * 300
    flat = [(s, i + 1, v) for s, vs in table.items() for i, v in enumerate(vs)]
    got = {r["source"]: r for r in rows(logs.transcripts(spark.createDataFrame(flat, "source string, line long, value string")))}
    texts = {s: "\n".join(vs) for s, vs in table.items() if vs}
    singles = {x.strip() for t in texts.values() for x in re.sub(r"\x1b\[[0-9;?]*[A-Za-z]", "", t).replace("\r", "\n").split("\n")}
    singles |= {m[1] for x in singles for p in (*logs.OPENING, *logs.NAMING) if (m := re.search(p, x, re.I))}
    ruled = spark.createDataFrame([(x,) for x in singles], "v string").withColumn("c", scalars.clean_candidate(F.col("v"))).withColumn("l", scalars.is_transcript_line(F.col("c"))).collect()
    clean, looks = {r["v"]: r["c"] for r in ruled}, {r["c"]: r["l"] for r in ruled}
    assert set(got) == set(texts)
    for s, t in texts.items():
        assert (got[s]["text"], got[s]["how"]) == plain_transcript(t, looks, clean), s
    assert {r["how"] for r in got.values()} == {"block", "named", "none"} and (got["hot"]["from_line"], got["hot"]["to_line"]) == (702, 1001)


def test_log_files_are_read_by_line(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"run{k}.log").write_text("\n".join(f"line {i} of file {k}" for i in range(500)) + "\n\ntext res: 你好\nRTF = 1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = rows(logs.read_lines(spark, str(tmp_path)))
        told = rows(logs.transcripts(logs.read_lines(spark, str(tmp_path))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k in range(4):
        mine = sorted((r["line"], r["value"]) for r in lines if r["source"].endswith(f"run{k}.log"))
        assert [v for _, v in mine] == (tmp_path / f"run{k}.log").read_text().splitlines() and [n for n, _ in mine] == list(range(1, len(mine) + 1))
    assert [(r["text"], r["from_line"]) for r in told] == [("你好", 502)] * 4


# ---- wavefronts

def plain_wavefront(spark, segments, budget, overhead):
    """Meeting by meeting, window by window, with the same model run on single windows."""
    said = [s for s in segments if s["text"].strip()]
    windows, at, number = [], 0, 0
    while at < len(said):
        end, used = at, 0
        while end < len(said) and used + len(said[end]["text"]) + overhead <= budget:
            used += len(said[end]["text"]) + overhead
            end += 1
        if end == at:
            return [*windows, (number, at, 0, None, "segment_exceeds_budget", [])]
        final, n = end == len(said), end - at
        if said[0]["meeting_id"] % 23 == 7:
            return [*windows, (number, at, n, None, "finish_reason", [])]
        place = {s["segment_id"]: i for i, s in enumerate(said[at:end])}
        told = []
        for p in range(0, n, 2):
            if p == n - 1 and not final:
                continue
            idx = said[at + p]["idx"]
            last = f"seg-{idx + 100:06d}" if p % 10 == 4 else f"seg-{idx + 1:06d}" if p + 1 < n else said[at + p]["segment_id"]
            if p % 8 != 6 and last in place:
                told.append([p, place[last]])
        carried = n - 1 if n % 2 == 1 and n > 1 and not final else None
        stop = (carried if carried is not None else n) - 1
        ranges = []
        for i, (a, b) in enumerate(told):
            follows = told[i + 1][0] if i + 1 < len(told) else None
            b = min(b, follows - 1) if follows is not None else b
            full = (0 if i == 0 else a, min(follows - 1 if follows is not None else stop, stop))
            if full[0] <= full[1]:
                ranges.append((a + at, min(max(a, min(b, stop)), full[1]) + at, full[0] + at, full[1] + at))
        windows.append((number, at, n, carried, None, ranges))
        at, number = at + stop + 1, number + 1
    return windows


def test_wavefront_is_the_sequential_run_and_resumes(spark):
    seg = adapters.segments(spark, DIR)
    extra = spark.createDataFrame([(5000, i, f"seg-{i:06d}", "w" * (i * 37 % 300 + 1), "speaker_0", i, i) for i in range(60)] + [(5001, 0, "seg-000000", "x" * 900, "speaker_0", 0, 1), (5002, 0, "seg-000000", " ", "speaker_0", 0, 1)] + [(5003, i, f"seg-{i:06d}", "short", "speaker_0", i, i) for i in range(40)], seg.schema)
    seg = seg.unionByName(extra).cache()
    folder = "file://" + tempfile.mkdtemp() + "/wave"
    got = {k: rows(v) for k, v in carryover.wavefront(seg, deep.model, 700, 20, folder=folder).items()}
    by = {}
    for s in sorted(rows(seg), key=lambda r: (r["meeting_id"], r["idx"])):
        by.setdefault(s["meeting_id"], []).append(s)
    errors = set()
    for m, segments in by.items():
        want = plain_wavefront(spark, segments, 700, 20)
        mine = sorted((r["round"], r["start"], r["n"], r["carryover"], r["error"]) for r in got["windows"] if r["meeting_id"] == m)
        assert mine == [w[:5] for w in want]
        errors |= {w[4] for w in want}
        chapters = sorted((r["round"], r["start_pos"], r["end_pos"], r["full_start"], r["full_end"]) for r in got["chapters"] if r["meeting_id"] == m)
        assert chapters == [(w[0], *r) for w in want for r in w[5]]
    assert errors == {None, "finish_reason", "segment_exceeds_budget"} and any(r["carryover"] is not None for r in got["windows"])
    assert {r["repair"] for r in got["repairs"]} >= {"drop_empty_chapter", "drop_invalid_chapter_range", "expand_chapter_range"}
    # a run that was killed in its third round goes on there
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("ranges_2", "starts_3", "window_3", "told_3"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"), False)
    again = {k: rows(v) for k, v in carryover.wavefront(seg, deep.model, 700, 20, folder=folder).items()}
    for k in got:
        assert sorted(map(str, again[k])) == sorted(map(str, got[k]))


# ---- linear time

def test_assignment_of_64_labels_takes_a_second():
    rng = random.Random(9)
    names = [f"l{i:02d}" for i in range(64)]
    value = {(a, b): rng.randrange(10**9) for a in names for b in names}
    began = time.time()
    got = evaluation.assign(names, names, value)
    assert time.time() - began < 3 and sorted(got) == names
    even = evaluation.assign(names[:9], names[:12], {(a, b): 5 for a in names for b in names})
    assert even == names[:9]


def test_windows_of_a_long_meeting_end(spark):
    n = 200_000
    df = spark.range(n).selectExpr("1L as meeting_id", "id as idx", "case when id % 1000 = 999 then 'speaker_1' else 'unknown' end as speaker", "'some words are said here' as text", "id * 1000 as start_ms", "id * 1000 + 900 as end_ms")
    began = time.time()
    got = sequence.fill_speakers(df).groupBy("speaker").count().collect()
    assert {r["speaker"]: r["count"] for r in got} == {"speaker_1": n}
    assert topics.boundaries(df.where(f"idx < {n // 4}")).count() == n // 4
    assert time.time() - began < 120 and math.isfinite(began)


# ---- windows of units

def plain_windows(units_, target, most_turns, overlap):
    """One window after another over a meeting's units."""
    from chronoloom.operators import packing

    turn, cost, speaker, begin, end_of = (list(x) for x in zip(*units_))
    out, start = [], 0
    while start is not None and start < len(turn):
        end, after = packing._windows_from(turn, cost, speaker, begin, end_of, start, target, most_turns, overlap)
        out.append((start, end - 1))
        start = after
    return out


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_windows_of_a_hot_meeting(spark, monkeypatch, overlap):
    from chronoloom.operators import packing

    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = random.Random(11)
    table, at = [], 0
    for m, n in ((1, 700), (2, 3), (3, 51), (4, 50)):
        for t in range(n):
            parts = rng.choice([1, 1, 1, 2, 3])
            for p in range(1, parts + 1):
                at += rng.choice([0, 100, 3000])
                table.append((m, t + 1, p, parts, at, at + 50, f"speaker_{rng.randrange(2)}", "w" * rng.randrange(1, 200)))
                at += 50
    df = spark.createDataFrame(table, "meeting_id long, turn_id long, part long, parts long, start_ms long, end_ms long, speaker string, text string")
    line = packing.unit_line(*[F.col(c) for c in ("turn_id", "part", "parts", "start_ms", "end_ms", "speaker", "text")])
    costs = {(r["meeting_id"], r["turn_id"], r["part"]): r["c"] for r in rows(df.select("meeting_id", "turn_id", "part", (F.length(line) + 1).alias("c")))}
    got = rows(packing.plan_windows(df, 900, 4, overlap))
    for m in (1, 2, 3, 4):
        own = sorted((r for r in table if r[0] == m), key=lambda r: (r[4], r[5], r[1], r[2]))
        want = plain_windows([(r[1], costs[r[0], r[1], r[2]], r[6], r[4], r[5]) for r in own], 900, 4, overlap)
        mine = sorted((r["win"], r["first_no"], r["last_no"]) for r in got if r["meeting_id"] == m)
        assert mine == [(i + 1, a, b) for i, (a, b) in enumerate(want)]
