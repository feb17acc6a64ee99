"""Corpus operators against brute force on small fixtures, held-out accuracy, round trips and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import queries, words
from chronoloom.llm.chat_format import escape, fold_events, unescape
from chronoloom.llm.common import connected_components
from chronoloom.llm.license_scan import PHRASES, scan_licenses
from chronoloom.llm.maxent_lm import score_texts
from chronoloom.llm.ngram_jaccard import ngram_jaccard_components

DIR = "/root/testdata/sf0.001"
Q = queries.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, spans string, score string, stats string"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def rows(df):
    return [r.asDict() for r in df.collect()]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark.read.parquet(f"{DIR}/documents.parquet"))


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def check_jaccard(got, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links.append((i, j))
    want = components(ids, links)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}


def test_op1_brute_force(spark, docs):
    check_jaccard(rows(Q["op1_ngram_jaccard_join"](spark, DIR)), {r["doc_id"]: r["text"] for r in docs})


def test_op1_large_tiles(spark):
    # many near copies that share their rarest shingles, more than a tile gives pairs for, in several groups
    import random

    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    texts = {}
    for g in range(3):
        own = [f"g{g}w{i}" for i in range(50)]
        for i in range(60):
            w = common + own
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_jaccard(rows(ngram_jaccard_components(df)), texts)


def test_op2_brute_force(spark, docs):
    bench = rows(spark.read.parquet(f"{DIR}/benchmark.parquet"))
    windows = {}
    for b in bench:
        w = plain(b["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(b["item_id"])
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in rows(Q["op2_benchmark_decontamination"](spark, DIR))}
    dirty = 0
    for d in docs:
        w, hit, items = plain(d["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        r = got[d["doc_id"]]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), digest, bool(hit))
        dirty += bool(hit)
    assert dirty > 0


def test_op3_base_score_and_gain(spark, docs):
    got = {r["doc_id"]: r for r in rows(Q["op3_lm_scoring"](spark, DIR))}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs}
    c = Counter(w for d in docs if not held[d["doc_id"]] for w in [*spaced(d["text"]), None])
    n, v = sum(c.values()), len(c)
    for d in docs:
        w, r = [*spaced(d["text"]), None], got[d["doc_id"]]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-6)
    apart = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_op3_class_factors_sum_to_one():
    import numpy as np

    from chronoloom.llm import maxent_lm as lm

    own = np.arange(1, lm.OWN_CLASSES + 1, dtype=np.uint64) << np.uint64(40)
    model = lm.Model(lm.WordTable(own, np.arange(len(own))), np.arange(1, lm.N_CLASSES + 1, dtype=float))
    for w in model.weights:
        w[:] = np.random.default_rng(1).standard_normal(w.shape)
    # one word of each class in the same context
    pool = np.concatenate([own, np.random.default_rng(2).integers(1, 2**63, 400_000, dtype=np.uint64)])
    leaf = lm.classes(pool, model.own)
    first = {int(c): int(i) for i, c in reversed(list(enumerate(leaf)))}
    h = pool[[first[c] for c in range(lm.N_CLASSES)]]
    one, two = np.full(len(h), 7, np.uint64), np.full(len(h), 9, np.uint64)
    assert np.power(10, model.gains(h, one, two) + model.log_mass[lm.classes(h, model.own)]).sum() == pytest.approx(1, abs=1e-3)


def test_op3_frequent_words_have_own_classes():
    import numpy as np

    from chronoloom.llm import maxent_lm as lm

    words = np.random.default_rng(5).integers(1, 2**63, 40_000, dtype=np.uint64)
    leaf = lm.classes(words, lm.WordTable(words[: lm.OWN_CLASSES], np.arange(lm.OWN_CLASSES)))
    n = Counter(leaf.tolist())
    assert lm.OWN_CLASSES >= 768 and lm.N_CLASSES >= 1024 and all(n[leaf[i]] == 1 for i in range(lm.OWN_CLASSES))


def test_op3_rows_grow_with_the_corpus():
    from chronoloom.llm.maxent_lm import ROW_BITS, row_bits

    assert row_bits(10**6) == ROW_BITS and row_bits(2**24) == tuple(b + 1 for b in ROW_BITS) and row_bits(2**26) == tuple(b + 2 for b in ROW_BITS)
    more = [row_bits(2**k)[0] for k in range(10, 60)]
    assert more == sorted(more) and len(set(more[20:])) > 4  # no size at which the growth stops


@pytest.mark.parametrize("name, label, least", [("op4_quality_classifier", "quality", 0.8), ("op9_toxicity", "toxic", 0.8)])
def test_op4_op9_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    got = Q[name](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label))).first()
    assert n > 50 and right / n >= least


def test_op9_words_that_stand_once(spark):
    from chronoloom.llm.toxicity_chain import score_toxicity

    texts = [(i, f"text {i} says that n{i % 7} are " + ("scum" if i % 4 == 0 else "kind") + " in few words") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    got = [r for r in score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect() if r["held_out"]]
    assert sum(r["doc_id"] % 4 == 0 for r in got) > 10
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)


def test_op9_recall_and_precision(spark):
    d = "/root/testdata/sf0.01"
    got = Q["op9_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    toxic, found, right = got.agg(F.sum("toxic"), F.sum("predicted"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1))).first()
    assert right / toxic >= 0.6 and right / found >= 0.9


def test_op5_brute_force(spark):
    vectors = rows(spark.read.parquet(f"{DIR}/embeddings.parquet"))
    good = [(r["vec_id"], r["embedding"]) for r in vectors if r["embedding"] and any(r["embedding"]) and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in good}
    links = [(i, j) for i in unit for j in unit if i < j and sum(a * b for a, b in zip(unit[i], unit[j])) >= 0.9]
    want, n = components([r["vec_id"] for r in vectors], links), Counter(x for p in links for x in p)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(Q["op5_embedding_near_dedup"](spark, DIR))}
    assert got == {r["vec_id"]: (n[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"]) for r in vectors}


def test_op6_digests(spark):
    talks = {}
    for r in rows(spark.read.parquet(f"{DIR}/conversations.parquet")):
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in rows(Q["op6_chat_formatting"](spark, DIR))}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op6_escape_round_trip_and_fold(spark):
    texts = ["\\", "\\l", "\\s<", "<turn:user>", "</turn>\n", "a\\\\l<s", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("back"))
    assert all(r.t == r.back for r in df.collect())
    log = [(1, 1, 1, "delta", "assistant", "Hel"), (1, 1, 2, "delta", None, "lo"), (1, 1, 3, "edit", "assistant", "Bye"), (1, 1, 4, "delta", "assistant", "!"), (1, 2, 5, "delta", "user", "x"), (1, 2, 6, "regenerate", "user", None)]
    got = fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert {(r["message"], r["text"]) for r in rows(got)} == {(1, "Bye!"), (2, "")}


def test_op7_base_places(spark, docs):
    got = {r["doc_id"]: r for r in rows(Q["op7_license_scan"](spark, DIR))}
    for d in docs:
        w = plain(d["text"])
        at = sorted((i, lab) for p, lab in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r["labels"].split(","))


def test_op7_notice_without_base_phrase(spark):
    text = "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"
    got = scan_licenses(spark.createDataFrame([(1, text), (2, "permission to use software")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["base_labels"], got[0]["labels"], got[1]["labels"]) == ("", "mit", "")


def test_op7_published_wordings(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
    cc = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    mozilla = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    texts = {1: mit, 2: "Our text is licensed under a Creative Commons Attribution 4.0 International License", 3: cc, 4: mozilla, 5: "creative people use commons with no license or attribution", 6: cc.replace("Attribution", "Attribution-NonCommercial")}
    texts |= {7: "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"}
    texts |= {10 + i: mit.replace("(the", "x " * i + "(the") for i in range(4)} | {20: "permission is hereby granted to speak in this hall", 21: "creative commons are a nice idea"}
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all("mit" in got[i] for i in (1, 10, 11, 12, 13))
    assert "cc" in got[2] and "cc" in got[3] and "mpl" in got[4] and "cc-by-nc" in got[6] and "lgpl" in got[7]
    assert got[5] == got[20] == got[21] == {""} and "cc-by-nc" not in got[3]


def test_op8_targets(spark, docs):
    got = rows(Q["op8_source_mixing"](spark, DIR))
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(spaced(d["text"]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}
    target, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            break
        for s in over:
            target[s] = cap[s]
            rest -= cap[s]
            open_.remove(s)
    target |= share
    source, taken = {d["doc_id"]: d["source"] for d in docs}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, rows(Q["op8_source_mixing"](spark, DIR))))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_op10_base_spans(spark, docs):
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn(re.sub("[^0-9]", "", t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
    ]
    got, total = {r["doc_id"]: r for r in rows(Q["op10_pii"](spark, DIR))}, 0
    for d in docs:
        spans = [(k, m.start(), m.end()) for k, p, ok in patterns for m in re.finditer(p, d["text"] or "") if ok(m[0])]
        r, joined = got[d["doc_id"]], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k, _, _ in patterns] == [sum(s[0] == k for s in spans) for k, _, _ in patterns]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))
        total += len(spans)
    assert total > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


ODD = [
    (1, None, "en", "a", 0, 1, 1, "s", "q", "z"), (2, "", None, None, 0, 1, 1, "s", "q", "z"), (3, " \t\n ", "en", "a", 3, None, 1, "s", "q", "z"),
    (4, "the same words stand here twice or more", "en", "a", 9, 1, None, "s", "q", "z"), (4, "the same words stand here twice or more", "en", "a", 9, 1, None, "s", "q", "z"),
    (None, "a text without an id that says something of its own", "en", None, 9, 1, 1, None, None, None), (5, "lone", "en", "b", 4, 1, 1, "s", "q", "z"),
    (6, "word " * 200_000, "en", "b", 1_000_000, 1, 1, "s", "q", "z"), (7, "mail a@b.co or 10.0.0.1 é 🙂 +1 234 567 8901", "de", "b", 9, 1, 1, "s", "q", "z"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    made = {}
    for kind, some in (("odd", ODD), ("empty", [])):
        d = tmp_path_factory.mktemp(kind)
        made[kind] = str(d)
        spark.createDataFrame(some, DOCS).write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark", "embeddings", "conversations"):
            df = spark.read.parquet(f"{DIR}/{t}.parquet")
            extra = df.limit(0 if kind == "empty" else 40).withColumn("size", F.lit(1)).withColumn("c", F.lit("x"))
            nulls = extra.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in extra.schema])
            extra.union(nulls).write.parquet(f"{d}/{t}.parquet")
    return made


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("name", sorted(Q))
def test_edges(spark, odd, kind, name):
    got = rows(Q[name](spark, odd[kind]))
    assert kind == "odd" or not got or name == "op6_chat_formatting"
    by = {r.get("doc_id"): r for r in got}
    if kind == "odd":
        check = {
            "op1_ngram_jaccard_join": lambda: [(by[i]["n_shingles"], by[i]["component_id"]) for i in (1, 2, 3, 4, 5, 6)] == [(0, 1), (0, 2), (0, 3), (4, 4), (1, 5), (1, 6)],
            "op2_benchmark_decontamination": lambda: [by[i]["n_words"] for i in (1, 2, 3, 5, 6)] == [0, 0, 0, 1, 200_000] and not by[1]["contaminated"],
            "op3_lm_scoring": lambda: [by[i]["n_tokens"] for i in (1, 2, 3, 5, 6)] == [1, 1, 1, 2, 200_001] and not by[None]["held_out"],
            "op4_quality_classifier": lambda: len({by[i]["score"] for i in (1, 2)}) == 1,
            "op7_license_scan": lambda: [(by[i]["n_words"], by[i]["labels"], by[i]["score"]) for i in (1, 2, 6)] == [(0, "", 0.0), (0, "", 0.0), (200_000, "", 0.0)],
            "op8_source_mixing": lambda: [by[i]["size"] for i in (1, 2, 3, 5, 6)] == [0, 0, 0, 1, 200_000] and by[1]["taken"] == 0,
            "op9_toxicity": lambda: all(0 <= r["score"] <= 1 for r in got),
            "op10_pii": lambda: (by[7]["n_email"], by[7]["n_ip"], by[7]["n_phone"], by[1]["spans"]) == (1, 1, 1, ""),
            "op5_embedding_near_dedup": lambda: len(got) == 41 and sum(r["vec_id"] is None and not r["kept"] and r["n_links"] == 0 for r in got) == 1,
            "op6_chat_formatting": lambda: any(r["conv_id"] == -7 and r["n_turns"] == 2 for r in got),
            "op11_document_fingerprints": lambda: [by[i]["n_chars"] for i in (1, 2, 3, 5, 6)] == [0, 0, 4, 4, 1_000_000] and by[1]["fingerprint"] == "" and by[4]["near_next"] in (0, 1),
            "op12_conversation_prefix_trie": lambda: [r["n_convs"] for r in got if r["depth"] == 0] == [max(r["n_convs"] for r in got)] and all(len(r["ends_sha256"]) == 64 for r in got),
            "op13_merkle_manifest": lambda: len({r["root"] for r in got}) == 1 and by[None]["verified"] and len({r["leaf"] for r in got}) == len(got) - 1,
        }
        assert check[name]()
    if name not in ("op5_embedding_near_dedup", "op6_chat_formatting", "op12_conversation_prefix_trie"):
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in (ODD if kind == "odd" else []))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_edges(spark, odd, kind):
    docs = spark.read.parquet(f"{odd[kind]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd[kind])
        assert out.columns == docs.columns
        assert out.count() == len([r for r in out.collect()]) <= docs.count()
    assert corpus_pipeline.run(spark, odd[kind]).count() <= docs.count()


def test_pipeline_decisions(spark, docs):
    texts = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = corpus_pipeline.quality(spark, texts, DIR)
    n, kept = labels.where("quality = 1").count(), good.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    assert kept >= 0.85 * n
    one = {r["doc_id"] for r in rows(corpus_pipeline.near_duplicates(spark, texts, DIR))}
    assert one == {r["component_id"] for r in rows(Q["op1_ngram_jaccard_join"](spark, DIR))}
    clean = {r["doc_id"]: r["text"] for r in rows(corpus_pipeline.decontamination(spark, texts, DIR))}
    hit = {r["doc_id"] for r in rows(Q["op2_benchmark_decontamination"](spark, DIR)) if r["contaminated"]}
    assert all((clean[d["doc_id"]] == d["text"]) == (d["doc_id"] not in hit) for d in docs)


def test_scores_grow_with_likely_order(spark):
    docs = [(i, "one two three four five six seven") for i in range(200)] + [(1000, "one two three four five six seven"), (1001, "seven five three one two six four")]
    got = {r["doc_id"]: r["score"] for r in rows(score_texts(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[1000] > got[1001]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]

    def normal(found):
        return sorted([tuple((k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())) for r in found], key=repr)

    want = normal(dict(zip(names, r)) for r in cur.fetchall())
    assert want and normal(rows(Q[name](spark, DIR))) == want


def test_op1_parts_of_tiles_and_shared_digests(spark, monkeypatch):
    """Tiles dealt as many parts, and sets that share their first digest, give the same components."""
    import random

    import numpy as np

    from chronoloom.llm import ngram_jaccard as nj

    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {200 + i: " ".join(f"own{i}{j}" for j in range(20)) for i in range(20)} | {300: "", 301: None, 302: texts[0]}
    monkeypatch.setattr(nj, "TILE", 8)
    counted, told = [], nj.hot_shingles
    monkeypatch.setattr(nj, "hot_shingles", lambda *a: counted.append(told(*a)) or counted[-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_jaccard(rows(nj.ngram_jaccard_components(df)), texts)
    assert (counted[0][2] > 1).any()
    few = spark.createDataFrame([(1, 1, 5, 7), (2, 1, 5, 8), (3, 1, 6, 9)], "doc_id long, n long, d long, d2 long")
    named, twice = nj._named(few)
    assert twice is not None and len({r["d"] for r in rows(named)}) == 3 and {r["d1"] for r in rows(named)} == {5, 6}
    assert np.array_equal(nj.set_digests(np.arange(3, dtype=np.uint64), np.array([0, 1, 3])), nj.set_digests(np.arange(3, dtype=np.uint64), np.array([0, 1, 3])))


def test_op2_blocks_of_the_benchmark(spark, docs, monkeypatch):
    """Many small blocks, items cut into pieces and items without an id give what one block gives."""
    from chronoloom.llm import fm_decontam as fm

    d, b = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    b = b.union(spark.createDataFrame([(None, "three short words"), (None, docs[0]["text"])], "item_id long, text string"))
    one = sorted(rows(fm.find_contamination(d, b)), key=lambda r: r["doc_id"])
    cut = {r["doc_id"]: r["text"] for r in rows(fm.decontaminate(d, b))}
    monkeypatch.setattr(fm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(fm, "PIECE", 25)
    assert fm._blocks(b, 10, "item_id", "text")[1] > 3
    assert sorted(rows(fm.find_contamination(d, b)), key=lambda r: r["doc_id"]) == one
    assert {r["doc_id"]: r["text"] for r in rows(fm.decontaminate(d, b))} == cut
    assert any(r["removal_spans"] for r in one) and "" in {i for r in one for i in r["item_ids"]}


def planted_vectors(rng, groups, dim):
    import numpy as np

    out = []
    for _ in range(groups):
        x = rng.standard_normal(dim)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(dim)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = rng.uniform(0.9005, 0.93)
        out += [x, c * x + math.sqrt(1 - c * c) * y]
    return out


def test_op5_planted_pairs(spark):
    """Recall of pairs near the threshold, copies, odd vectors and two lengths that are equal modulo 4,096."""
    import numpy as np

    from chronoloom.llm.embedding_dedup import embedding_components

    rng = np.random.default_rng(4)
    vectors = [v.tolist() for v in planted_vectors(rng, 1500, 24)]
    pairs = {(2 * i, 2 * i + 1) for i in range(1500)}
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, vectors[0], (np.array(vectors[2]) * 3).tolist()]
    long = [v.tolist() for v in rng.standard_normal((40, 4096 + 24))]
    table = list(enumerate([*vectors, *odd, *long, long[0]]))
    got = {r["vec_id"]: r for r in rows(embedding_components(spark.createDataFrame(table, "vec_id long, embedding array<double>")))}
    assert len(got) == len(table)
    found = sum(got[a]["component_id"] == got[b]["component_id"] for a, b in pairs)
    assert found / len(pairs) >= 0.99
    n = len(vectors)
    for i in range(n, n + 5):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 5]["component_id"] == 0 and got[n + 6]["component_id"] == 2 and got[len(table) - 1]["component_id"] == n + 7
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))}
    assert sum(got[i]["n_links"] for i in range(10, n)) >= 0.99 * sum((a >= 10) + (b >= 10) for a, b in links)


def test_op6_role_named_once(spark):
    log = [(1, 1, 1, "delta", "assistant", "Hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "delta", "user", "x"), (1, 2, 4, "edit", None, "y"), (1, 3, 5, "delta", None, "z")]
    got = fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert {(r["message"], r["role"], r["text"]) for r in rows(got)} == {(1, "assistant", "Hello"), (2, "user", "y"), (3, "", "z")}


def test_op8_equal_rows_and_reruns(spark, monkeypatch):
    """Rows that share id and size, whole copies and hot sources: the same words each run, however rows are dealt, and exact budgets."""
    from chronoloom.llm import source_mix as sm

    table = [(1, f"{'a b c d'} {i % 7} e", "hot") for i in range(300)] + [(None, "one", "hot")] * 500 + [(i, "w " * (i % 40), "cold") for i in range(200)] + [(5, "x y z", None)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    runs = []
    for fanout, parts in ((20_000, 1), (20_000, 5), (3, 4)):
        monkeypatch.setattr(sm, "SORTED", fanout)
        got = rows(sm.mix_documents(df.repartition(parts)))
        runs.append(sorted(map(str, ({k: r[k] for k in ("doc_id", "text", "taken", "target")} for r in got))))
        for s in ("hot", "cold", None):
            own = [r for r in got if r["source"] == s]
            assert sum(r["taken"] for r in own) == round(own[0]["target"]) and all(r["taken"] <= 3 * r["size"] for r in own)
    assert runs[0] == runs[1] == runs[2]


def test_op10_bytes_and_long_tokens(spark):
    from chronoloom.llm.pii_weak import candidates, redact

    df = spark.createDataFrame([(1, bytearray(b"bad \xff\xfe byte, mail joe@site.org now")), (2, bytearray(b"plain"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = {r["doc_id"]: bytes(r["b"]) for r in redact(df).selectExpr("doc_id", "cast(text as binary) as b").collect()}
    assert got == {1: b"bad \xff\xfe byte, mail <email> now", 2: b"plain"}
    plain, mixed = "a1" + "bcdefgh" * 12, "Zq8" * 3 + "x7Kd9Lm2Np4" * 9  # what decides stands behind the first 64 bytes, too
    assert [c[4][6] for c in candidates(f"{plain} {mixed}".encode()) if c[0] == "secret"] == [-1, 1]


@pytest.mark.parametrize("name, label", [("op4_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_op4_op9_recall_of_both_classes(spark, name, label):
    d = "/root/testdata/sf0.01"
    got = Q[name](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    for value, least in ((0, 0.6), (1, 0.6)):
        n, right = got.where(F.col(label) == value).agg(F.count("*"), F.count_if(F.col("predicted") == value)).first()
        assert n > 10 and right / n >= least


def test_pipeline_stages_take_effect(spark, docs):
    texts, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r["doc_id"] for r in rows(corpus_pipeline.quality(spark, texts, DIR))}
    bad = [r["doc_id"] for r in rows(labels.where("quality = 0"))]
    assert sum(i not in good for i in bad) >= 0.6 * len(bad) > 0
    clean = {r["doc_id"]: r["text"] for r in rows(corpus_pipeline.personal_data(spark, texts, DIR))}
    spans = {r["doc_id"]: r["spans"] for r in rows(Q["op10_pii"](spark, DIR))}
    kinds = re.compile("<(email|ip|card|phone|secret|number)>")
    for d in docs:
        assert (clean[d["doc_id"]] == d["text"]) == (not spans[d["doc_id"]])
        if spans[d["doc_id"]]:
            assert kinds.search(clean[d["doc_id"]]) and not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", clean[d["doc_id"]])
    mixed = rows(corpus_pipeline.mixing(spark, texts, DIR))
    want = {r["doc_id"]: r["taken"] for r in rows(Q["op8_source_mixing"](spark, DIR)) if r["taken"] > 0}
    assert {r["doc_id"]: r["taken"] for r in mixed} == want and set(docs[0]) < set(mixed[0])


@pytest.mark.parametrize("block_bytes", [1, 7, 64, 1 << 19])
def test_words_of_a_shard_are_those_of_its_blocks(block_bytes):
    for texts in ([], [""], ["", None, "a b"], ["Ab, c" * (i % 9) + " é x" for i in range(50)]):
        raw, at = words.text_buffers(pa.array(texts, pa.string()))
        want, got = words.Words(raw, at, words.PLAIN), words.ShardWords(raw, at, words.PLAIN, block_bytes)
        for part in ("hash", "start", "end", "at"):
            assert getattr(got, part).tolist() == getattr(want, part).tolist()


CLASH = "_slot, _bits, _word, _maybe, _ROW, Score, Stats, Spans, SIZE, Target, N_Words, Removal_Spans, HELD, _TEXT, c0, maybe"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_keep_their_values(spark, stage):
    """Extra columns that are called like an operator's own, or differ from them in case only, come out as they went in."""
    own = {"mixing": ("size", "target", "source_size", "taken")}.get(stage, ())
    d = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in CLASH.split(", ")])
    got = rows(dict(corpus_pipeline.STAGES)[stage](spark, d, DIR))
    assert got
    for r in got:
        for c in CLASH.split(", "):
            assert c.lower() in own or r[c] == f"{c}{r['doc_id']}"


def test_clashing_columns_of_operators(spark):
    from chronoloom.llm.common import sift, without
    from chronoloom.llm.pii_weak import find_personal_data
    from chronoloom.llm.quality_qda import score_quality

    d = spark.createDataFrame([(i, f"text {i} a@b.org", f"s{i}", f"t{i}", f"w{i}", i % 2) for i in range(30)], "doc_id long, text string, Stats string, Spans string, _Text string, Score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert all(r["_Text"] == f"w{r['doc_id']}" and 0 <= r["score"] <= 1 for r in rows(score_quality(d, labels)))
    assert all(r["_Text"] == f"w{r['doc_id']}" and r["spans"] for r in rows(find_personal_data(d)))
    ids = spark.createDataFrame([(3,), (4,)], "doc_id long")
    marked = d.selectExpr("doc_id", "7 as slot", "8 as Bits", "9 as word", "1 as maybe", "2 as k")
    kept = rows(without(marked, ids, "doc_id"))
    assert len(kept) == 28 and all((r["slot"], r["Bits"], r["word"], r["maybe"], r["k"]) == (7, 8, 9, 1, 2) for r in kept)
    assert {3, 4} <= {r["doc_id"] for r in rows(sift(marked, ids, "doc_id"))}


def test_op2_items_that_differ_in_a_nul(spark):
    from chronoloom.llm.fm_decontam import find_contamination

    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("a", text), ("a\0", text), (None, text)], "item_id string, text string")
    got = rows(find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench))
    assert sorted(got[0]["item_ids"]) == ["", "a", "a\0"]
