"""Fingerprints, prefix trie and manifest against brute force, with edge cases."""

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from chronoloom.llm import merkle_manifest as mm
from chronoloom.llm import prefix_trie as pt
from chronoloom.llm import queries
from chronoloom.llm import syncmers as sy
from chronoloom.llm.words import text_buffers

DIR = "/root/testdata/sf0.001"
Q = queries.queries()


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# ---- syncmers

def inner_hashes(text):
    """Hashes of all s-mers of a text by themselves, from the operator's own hash of a run of K code points."""
    import pyarrow as pa

    raw, at = text_buffers(pa.array([text]))
    return sy.Codes(raw, at).codes


def plain_anchors(text):
    """Closed syncmers by definition, one k-mer at a time."""
    codes = inner_hashes(text)
    if 0 < len(codes) < sy.K:
        return [0]
    found = []
    for i in range(len(codes) - sy.K + 1):
        places, _ = sy._windows(codes[i : i + sy.K])
        if len(places):
            found.append(i)
    return found


def own_anchors(text):
    import pyarrow as pa

    raw, at = text_buffers(pa.array([text]))
    codes = sy.Codes(raw, at)
    return sy.anchors_of(codes.codes, codes.at)[0]


def test_op11_anchors_depend_on_nothing_around_them(monkeypatch):
    rng = random.Random(1)
    texts = ["", "kurz", "a" * 31, "ab" * 16, "x" * 400, "é😀" * 90, "".join(rng.choice("abcde é😀\n") for _ in range(900))]
    for text in texts:
        places, hashes = own_anchors(text)
        assert places.tolist() == plain_anchors(text)
        assert len(text) < sy.K or max(np.diff(places, prepend=-1), default=0) <= sy.K - sy.S + 1
        p, h = sy.read_fingerprint(sy.fingerprint(places, hashes))
        assert p.tolist() == places.tolist() and h.tolist() == hashes.tolist()
    whole = own_anchors(texts[-1])
    monkeypatch.setattr(sy, "PIECE", 100)
    cut = own_anchors(texts[-1])
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_op11_closed_syncmer_rule():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 101, 300).astype(np.uint64)
    places, _ = sy._windows(codes)
    small = []  # the hash of each s-mer by itself
    for i in range(len(codes) - sy.S + 1):
        run = codes[i : i + sy.S]
        part = sy.mix(run + np.uint64(0x9E37)) * sy._power(sy._P, sy.S)
        small.append(int(sy.mix(np.array([part.sum(dtype=np.uint64)]))[0]))
    want = [i for i in range(len(codes) - sy.K + 1) if min(small[i : i + sy.K - sy.S + 1]) in (small[i], small[i + sy.K - sy.S])]
    assert places.tolist() == want


def check_fingerprints(got, table):
    """Against edited texts built in Python, whose fingerprints are computed from the whole edited text."""
    table = sorted(table, key=lambda d: (d[0] is None, d[0] or 0))
    got = {r["doc_id"]: r for r in got}
    for i, (doc_id, text) in enumerate(table):
        text, after = text or "", table[(i + 1) % len(table)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, mine, other, new = got[doc_id], own_anchors(text), own_anchors(after), own_anchors(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert r["fingerprint"] == sy.fingerprint(*mine) and r["edited_fingerprint"] == sy.fingerprint(*new)
        assert r["near_edited"] == pytest.approx(sy.likeness(mine[1], new[1])) and r["near_next"] == pytest.approx(sy.likeness(mine[1], other[1]))
        if len(text) > 400 and text != after:
            assert 0.3 <= r["near_edited"] <= 1
        if text == after:
            assert r["near_next"] == 1


def test_op11_brute_force(spark):
    docs = rows(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))
    got = rows(Q["op11_document_fingerprints"](spark, DIR))
    assert len(got) == len(docs)
    check_fingerprints(got, [(d["doc_id"], d["text"]) for d in docs])


def test_op11_many_blocks_and_edges(spark):
    rng = random.Random(5)
    table = [(i * 3 - 20, rng.choice([None, "", "kurz", "é" * 40, "".join(rng.choice("abc dé") for _ in range(rng.randrange(300)))])) for i in range(120)] + [(None, "the last one " * 9)]
    table[50] = (table[50][0], table[51][1])
    df = spark.createDataFrame([(t, i, "x") for i, t in table], "text string, doc_id long, row string").repartition(5)
    df = df.sortWithinPartitions("doc_id")
    df.write.parquet(path := tempfile.mkdtemp() + "/docs")
    check_fingerprints(rows(sy.compare_with_next(spark.read.parquet(path), block_bytes=700)), table)


def test_op11_repeats_and_small_tables(spark):
    same = [(7, "one text that repeats " * 4)] * 40 + [(3, "before " * 9), (9, "behind " * 9)]
    spark.createDataFrame(same, "doc_id long, text string").write.parquet(path := tempfile.mkdtemp() + "/docs")
    got = rows(sy.compare_with_next(spark.read.parquet(path), block_bytes=300))
    assert len(got) == 42 and sum(r["near_next"] == 1 for r in got) == 39
    assert len({r["fingerprint"] for r in got}) == 3
    assert len({(r["edited_sha256"]) for r in got if r["doc_id"] == 7}) == 2
    alone = rows(sy.compare_with_next(spark.createDataFrame([(1, "only this text, and it is its own next one")], "doc_id long, text string")))
    assert alone[0]["near_next"] == 1 and alone[0]["n_chars"] == 42
    assert rows(sy.compare_with_next(spark.createDataFrame([], "doc_id long, text string"))) == []
    shown = rows(sy.fingerprints(spark.read.parquet(path)))
    assert len(shown) == 42 and len({r["fingerprint"] for r in shown}) == 3


def test_op11_likeness():
    a = np.arange(100, dtype=np.uint32)
    assert sy.likeness(a, a) == 1 and sy.likeness(a, a + 1000) == 0 and sy.likeness(a[:0], a[:0]) == 1 and sy.likeness(a, a[:0]) == 0
    assert sy.likeness(a, np.concatenate([a[:50], a[:50] + 1000])) == 0.5
    moved = np.concatenate([a[:30], np.arange(500, 520, dtype=np.uint32), a[30:]])
    assert sy.likeness(a, moved) == pytest.approx(200 / 220) == sy.likeness(moved, a)
    assert sy.likeness(a, a[::-1]) == pytest.approx(0.01)


# ---- prefix trie

def plain_trie(table):
    """Nodes of rows (conv_id, turn, role, text), one prefix at a time."""
    talks = {}
    for c, turn, role, text in table:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        talks.setdefault(c, []).append(((turn is not None, turn or 0), role, digest[:30], text))
    talks = {c: [(r, t) for _, r, _, t in sorted(rows)] for c, rows in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    for node, own in members.items():
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
            todo += kids.get(x, [])
        ends = sorted(c for c in own if len(built[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids.get(node, [])), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def check_trie(spark, table):
    got = sorted(tuple(r[c] for c in TRIE) for r in rows(pt.prefix_trie(spark.createDataFrame(table, TURNS))))
    assert got == plain_trie(table)


def test_op12_brute_force(spark):
    table = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows(spark.read.parquet(f"{DIR}/conversations.parquet"))]
    got = sorted(tuple(r[c] for c in TRIE) for r in rows(Q["op12_conversation_prefix_trie"](spark, DIR)))
    assert got == plain_trie(table)


def test_op12_snapshots_copies_and_ties(spark, monkeypatch):
    """Conversations logged after every turn hang on one another in a long path; copies, prefixes, nulls, ties and blocks of few turns."""
    monkeypatch.setattr(pt, "BLOCK", 3)
    rng = random.Random(6)
    table = [(20 * i, d, "user", f"word {d} said") for i in range(1, 14) for d in range(i)]  # each is one turn longer
    table += [(1000 + i, d, rng.choice(["user", None]), rng.choice(["yes", "no", None])) for i in range(60) for d in range(rng.randrange(6))]
    table += [(2000 + i % 7, None, "user", "tie") for i in range(20)] + [(3000, 1, "a", "b c"), (3000, 1, "a", "b c"), (3000, 1, "a", "d")]
    table += [(41, 5, "user", "first"), (-3, 0, "user", "x"), (-25, 0, "user", "x")]
    check_trie(spark, table)


def test_op12_empty_and_null_ids(spark):
    assert rows(pt.prefix_trie(spark.createDataFrame([], TURNS))) == []
    got = rows(pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "a b"), (None, 2, "user", "c"), (5, 1, "user", "a b")], TURNS)))
    root = next(r for r in got if r["depth"] == 0)
    assert root["n_convs"] == 2 and root["parent_conv_id"] is None and root["conv_id"] == 5


def test_op12_totals_by_doubling(spark):
    rng = random.Random(7)
    up = {0: None} | {i: i - 1 if i < 70 else rng.randrange(i) for i in range(1, 200)}
    got = {r["c"]: r["x"] for r in rows(pt.subtree_totals(spark.createDataFrame([(c, u, c + 1) for c, u in up.items()], "c long, up long, x long"), ("x",)))}
    want = {c: c + 1 for c in up}
    for c in sorted(up, reverse=True):
        if up[c] is not None:
            want[up[c]] += want[c]
    assert got == want


# ---- manifest

def plain_manifest(table):
    def leaf(d, source, lang, n, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    by = {}
    for row in table:
        by.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([r[2] for r in sorted(by[lang], key=lambda r: r[:3])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, (_, _, own, row) in enumerate(sorted(by[lang], key=lambda r: r[:3])):
            changed = row[3] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            acc, proof = leaf(*row[:3], row[3] + 1, row[4]) if changed else own, ""
            for place, tree in ((i, trees[lang]), (at, top)):
                for level in tree[:-1]:
                    sibling = level[place ^ 1] if place ^ 1 < len(level) else ""
                    proof += sibling
                    acc = sha(sibling + acc if place % 2 else acc + sibling)
                    place //= 2
            out.append((row[0], own, trees[lang][-1][0], top[-1][0], sha(proof), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op13_brute_force(spark):
    table = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows(spark.read.parquet(f"{DIR}/documents.parquet"))]
    got = sorted((tuple(r[c] for c in MANIFEST) for r in rows(Q["op13_merkle_manifest"](spark, DIR))), key=repr)
    assert got == plain_manifest(table)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_op13_small_buckets_and_edges(spark, monkeypatch, levels):
    """Several tiers of buckets, lone leaves, null languages, nulls, repeats."""
    monkeypatch.setattr(mm, "LEVELS", levels)
    monkeypatch.setattr(mm, "BUCKET", 1 << levels)
    rng = random.Random(levels)
    table = [(rng.choice([None, *range(60)]), rng.choice(["web", None, "bücher"]), "hot", rng.choice([None, 5]), rng.choice([None, "", "text é"])) for _ in range(53)]
    table += [(i, "s", lang, i, "t") for lang, n in ((None, 3), ("", 1), ("é", 2), ("z", 4), ("aa", 5)) for i in range(n)] + [(1, "s", "z", 1, "t")]
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, source string, lang string, n_chars long, text string, root string")
    got = sorted((tuple(r[c] for c in MANIFEST) for r in rows(mm.manifest(df))), key=repr)
    assert got == plain_manifest(table)


def test_op13_empty_and_lone(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert rows(mm.manifest(spark.createDataFrame([], kind))) == []
    one = rows(mm.manifest(spark.createDataFrame([(8, None, None, None, None)], kind)))[0]
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:8----") and one["proof_sha256"] == sha("") and one["verified"]


# ---- earlier operators against plain versions

def test_op4_scores_by_brute_force(spark):
    """Means, shrunk covariances and densities computed anew with numpy's general routines from the statistics of single texts."""
    from chronoloom.llm import quality_qda as qq

    docs = rows(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{DIR}/labels.parquet"))}
    x = {}
    for d in docs:
        raw = np.frombuffer((d["text"] or "").encode(), np.uint8)
        x[d["doc_id"]] = np.nan_to_num(qq.document_statistics(raw, np.array([0, len(raw)])))[0]
    train = [i for i in x if i in labels and labels[i] is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    part = {c: np.array([x[i] for i in train if labels[i] == c]) for c in (0, 1)}
    cov = {c: np.cov(p.T, bias=True) for c, p in part.items()}
    pooled = sum(len(p) * cov[c] for c, p in part.items()) / len(train)
    density = {}
    for c, p in part.items():
        s = (1 - qq.POOL) * cov[c] + qq.POOL * pooled
        s = (1 - qq.DIAGONAL) * s + qq.DIAGONAL * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(len(s))
        inverse, (_, log_det) = np.linalg.inv(s), np.linalg.slogdet(s)
        density[c] = {i: np.log(len(p) / len(train)) - 0.5 * ((v - p.mean(axis=0)) @ inverse @ (v - p.mean(axis=0)) + log_det) for i, v in x.items()}
    got = rows(Q["op4_quality_classifier"](spark, DIR))
    assert len(got) == len(docs)
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(density[0][i] - density[1][i], -700, 700))), abs=1e-5)


def test_op4_statistics_of_single_texts():
    from chronoloom.llm import quality_qda as qq

    text = "One two, two.\nOne two, two.\nTHREE 44 ééé!"
    raw = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(qq.FEATURES, qq.document_statistics(raw, np.array([0, len(raw)]))[0]))
    w = text.split()
    size = [len(x.encode()) for x in w]
    n = len(text.encode())
    assert got["log_words"] == pytest.approx(np.log1p(len(w))) and got["word_length"] == pytest.approx(np.log1p(sum(size) / len(w)))
    assert got["upper"] == pytest.approx(np.sqrt(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / n)) and got["digit"] == pytest.approx(np.sqrt(2 / n)) and got["space"] == pytest.approx(sum(c.isspace() for c in text) / n)
    assert got["distinct_words"] == pytest.approx((len({x.lower() for x in w}) / len(w)) ** 2) and got["repeated_lines"] == pytest.approx(np.sqrt(1 - 2 / 3)) and got["end_stops"] == pytest.approx(np.sqrt(sum(c in ".!?" for c in text) / n))


def test_op10_added_spans_recall(spark):
    """Secrets planted among hashes, hyphenated words and prose: most are found, prose is left alone.

    Where hashes and hyphenated words are as frequent as secrets, the classifier takes most of them too; the README tells how many.
    """
    from chronoloom.llm.pii_weak import find_personal_data

    rng = random.Random(3)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    table, planted = [], {}
    for i in range(400):
        words = [rng.choice("some plain words about nothing at all".split()) for _ in range(30)]
        secret = "".join(rng.choice(alphabet) for _ in range(32))
        if i % 4 == 0:
            words.insert(10, f"password: {secret}")
            planted[i] = secret
        elif i % 4 == 1:
            words.insert(10, f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(40))}")
        elif i % 4 == 2:
            words.insert(10, "word-with-many-parts-2024-and-more")
        if i % 5 == 0:
            words.insert(3, "mail joe@site.org or call +1 234 567 8901")
        table.append((i, " ".join(words)))
    got = {r["doc_id"]: r for r in rows(find_personal_data(spark.createDataFrame(table, "doc_id long, text string")))}
    found = {i: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "secret"] for i, r in got.items()}
    hit = sum(planted[i] in found[i] for i in planted)
    # secrets of fewer than three digits look like words to the labeler of shapes
    assert hit / len(planted) >= 0.75 and not any(found[i] for i in found if i % 4 == 3)
    assert all(({"email", "phone"} <= {s["kind"] for s in r["spans"]}) == (i % 5 == 0) for i, r in got.items())


def test_op9_links_do_not_restate_the_label(spark):
    """A document that holds words of a category is of that link whatever its label; terms that go with them are learned."""
    from chronoloom.llm import toxicity_chain as tc

    rng = random.Random(4)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(25)]
        kind = i % 6
        if kind == 0:  # threats, half of them labelled
            w[3:6] = ["kill", "blade", "tonight"]
        elif kind == 1:  # what threats say besides their words
            w[3:5] = ["blade", "tonight"]
        elif kind == 2:
            w[3] = "idiot"
        texts.append((i, " ".join(w)))
        labels.append((i, int(kind in (0, 2) and i % 4 < 3)))
    got = {r["doc_id"]: r for r in rows(tc.score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))}
    apart = [r for r in got.values() if r["held_out"]]
    threat = [r["threat"] > 0.5 for r in apart if r["doc_id"] % 6 in (0, 1)]
    assert sum(threat) / len(threat) > 0.95
    assert sum(r["threat"] > 0.5 for r in apart if r["doc_id"] % 6 > 1) == 0 and all((r["insult"] > 0.5) == (r["doc_id"] % 6 == 2) for r in apart)
