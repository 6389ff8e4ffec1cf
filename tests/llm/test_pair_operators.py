"""Near-duplicate, passage and leak operators, against brute force on small tables."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import components, contamination, jaccard, passages, queries, rtree
from quillon.llm import words as W

from .texts import TEXTS, clashing, rows, table

SPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, words, text, n):
    parts = text.split(" ")
    for _ in range(n):
        k = rng.randrange(len(parts))
        parts[k : k + 1] = rng.choice([[], [rng.choice(words)], [parts[k], rng.choice(words)]])
    return " ".join(parts)


# ---------------------------------------------------------------- components


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_components_of_a_chain(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = [(order[k], order[k + 1]) for k in range(n - 1)]
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()
    assert len(got) == n and {r["root"] for r in got} == {0}


# ---------------------------------------------------------------- op4


def shingles(text, n=3):
    w = SPACE.findall(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, num=90, den=100):
    ids = list(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed, size=60):
    """Groups of copies, near copies at and about the threshold, chains and unrelated texts."""
    rng, words, texts = random.Random(seed), vocabulary(seed), []
    for _ in range(6):
        base = sentence(rng, words, rng.choice([12, 25, 60, 150, 400]))
        texts += [base, base]
        chain = base
        for _ in range(size // 8):
            texts.append(edited(rng, words, base, rng.randint(1, max(1, len(base.split()) // 40))))
            chain = edited(rng, words, chain, max(1, len(base.split()) // 60))
            texts.append(chain)
    texts += [sentence(rng, words, rng.randint(1, 40)) for _ in range(20)] + ["one two", "one  TWO", "one two one two one two", "x", "x y", "X", "", None, "   "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    texts = dict(enumerate(near_copies(seed)))
    got = rows(jaccard.jaccard_components(clashing(spark, list(texts.values()))))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts) and len(got) == len(texts)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(clashing(spark).limit(0)).count() == 0
    texts = dict(enumerate(TEXTS))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(clashing(spark)).collect()} == brute_components(texts)
    got = rows(jaccard.jaccard_components(table(spark, ["a b c d", "a b c d", "a b c d", "z", None], [7, 7, None, None, 3])), "doc_id")
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(None, 7), (None, None), (3, 3), (7, 7), (7, 7)] or [(r["doc_id"], r["component_id"]) for r in got] == [(None, None), (None, 7), (3, 3), (7, 7), (7, 7)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 80), st.integers(0, 9))
def test_routing_keys_meet(seed, n, r):
    """Any two sets that link and differ share a key."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[: max(1, len(a) - r // 2)], rng.integers(0, 2**64, r - r // 2, dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    ranks = rng.integers(0, 4, 1 << jaccard.RANK_BITS).astype(np.uint8)
    if 100 * common >= 90 * (len(a) + len(b) - common) and len(a):
        assert len(np.intersect1d(jaccard.routing_keys(a, ranks, 90, 100), jaccard.routing_keys(b, ranks, 90, 100)))


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(5)
    base = [set(rng.integers(0, 3000, 120).tolist()) for _ in range(40)]
    sets = base + [set(list(s)[: len(s) - 4]) | set(rng.integers(0, 3000, 3).tolist()) for s in base for _ in range(3)]
    points = np.array([np.bincount([x % 32 for x in s], minlength=32) for s in sets])
    sizes = np.array([len(s) for s in sets])
    q, p = rtree.CountTree(points, sizes, fan=4).search(points, sizes, 90, 100)
    found = set(zip(q.tolist(), p.tolist()))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= 90 * len(a | b):
                assert (i, j) in found
            low = np.minimum(points[i], points[j]).sum()
            assert ((i, j) in found) == (100 * min(sizes[i], sizes[j]) >= 90 * max(sizes[i], sizes[j]) and 190 * low >= 90 * (sizes[i] + sizes[j]))
    assert len(found) < len(sets) ** 2 / 4
    wanted = rng.random((len(sets), len(sets))) < 0.5
    for fan in (4, 10**6):  # a tree, and a leaf alone
        q, p = rtree.CountTree(points, sizes, fan=fan).search(points, sizes, 90, 100, wanted)
        assert set(zip(q.tolist(), p.tolist())) == {(i, j) for i, j in found if wanted[i, j]}


def test_near_copies_of_the_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(queries.op4_jaccard_join(spark, sf))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


# ---------------------------------------------------------------- op7


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=14), min_size=1, max_size=3), st.integers(1, 5))
def test_compact_windows(texts, width):
    texts = [[x << 40 for x in t] for t in texts]
    h = np.array([x for t in texts for x in t], np.uint64)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    left, centre, right = passages.compact_windows(h, own, width)
    got = sorted(zip(left.tolist(), centre.tolist(), right.tolist()))
    for lo, c, hi in got:
        assert hi - lo + 1 >= width and own[lo] == own[hi] and h[lo : hi + 1].min() == h[c]
    at = 0
    for t in texts:  # every wide run lies in a window of its minimum
        for i in range(len(t)):
            for j in range(i + width - 1, len(t)):
                low = min(t[i : j + 1])
                assert any(lo <= at + i and at + j <= hi and h[c] == low for lo, c, hi in got)
        at += len(t)


def planted(seed):
    rng, words = random.Random(seed), vocabulary(seed, 3000)
    shared = [sentence(rng, words, n) for n in (51, 60, 90, 200)]
    near = sentence(rng, words, 120)
    texts = {}
    for i in range(60):
        parts = [sentence(rng, words, rng.randint(5, 120)), sentence(rng, words, rng.randint(5, 120))]
        if i < 24:
            parts.insert(1, shared[i % 4])
        elif i < 30:
            parts.insert(1, edited(rng, words, near, 2))
        texts[i] = " ".join(parts)
    texts[60] = texts[61] = sentence(rng, words, 80)
    texts[62] = sentence(rng, words, 49)
    texts[63] = texts[62]
    texts[64] = " ".join([sentence(rng, words, 55)] * 2)
    texts[65], texts[66], texts[67] = None, "", "w " * 300
    texts[68] = "w " * 300
    return texts


def test_repeated_passages(spark, monkeypatch):
    texts = planted(3)
    docs = clashing(spark, list(texts.values()))
    got = rows(passages.repeated_passages(docs), "doc_id")
    hit = {r["doc_id"] for r in got} | {r["match_id"] for r in got}
    assert hit >= set(range(24)) and {60, 61} <= hit and not hit & ({62, 63, 64, 65, 66} | set(range(30, 60)))
    assert len(hit & set(range(24, 30))) >= 5
    later = {r["doc_id"] for r in got}
    assert later >= set(range(4, 24)) | {61} and not later & {0, 1, 2, 3}
    for r in got:
        a, b = SPACE.findall(texts[r["doc_id"]]), SPACE.findall(texts[r["match_id"]])
        x = a[r["start_word"] : r["start_word"] + r["n_words"]]
        y = b[r["match_start_word"] : r["match_start_word"] + r["match_n_words"]]
        five = [{tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in (x, y)]
        assert r["match_id"] < r["doc_id"] and r["n_words"] >= 50
        assert abs(r["similarity"] - len(five[0] & five[1]) / len(five[0] | five[1])) < 1e-9 and r["similarity"] >= 0.8
        assert texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().split() == x
    cut = {r["doc_id"]: r for r in passages.without_passages(docs, passages.repeated_passages(docs)).collect()}
    assert len(cut) == len(texts)
    for i, r in cut.items():
        if i not in later:
            assert r["text"] == texts[i]
        assert r["n_words"] == "clash"
    assert cut[61]["text"].strip() == "" and all(len(cut[i]["text"]) < len(texts[i]) for i in later)


def test_second_round_parts_a_shared_shingle(spark):
    """Documents that share one phrase with a smaller one, and a whole passage with one another."""
    rng, words = random.Random(9), vocabulary(9, 3000)
    phrase = sentence(rng, words, 30)
    passage = phrase + " " + sentence(rng, words, 25)
    texts = [f"{sentence(rng, words, 60)} {phrase} {sentence(rng, words, 60)}"] + [f"{sentence(rng, words, 40)} {passage} {sentence(rng, words, 40)}" for _ in range(6)]
    got = rows(passages.repeated_passages(table(spark, texts)))
    assert {r["doc_id"] for r in got} == {2, 3, 4, 5, 6} and {r["match_id"] for r in got} == {1}


def near_windows(a, b, width=46, num=80, den=100):
    """First places of the windows of a's shingles whose Jaccard with some window of b of the same width is at least num / den, by trying all."""
    at = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    found = []
    for s in range(len(a) - width + 1):
        own = set(a[s : s + width])
        reach = {}
        for x in own:
            for t in {t for j in at.get(x, ()) for t in range(max(0, j - width + 1), min(j, len(b) - width) + 1)}:
                reach[t] = reach.get(t, 0) + 1
        for t, common in reach.items():
            if den * common >= num * len(own) and den * common >= num * (len(own) + len(set(b[t : t + width])) - common):
                found.append(s)
                break
    return found


def test_passages_of_the_table(spark, sf):
    """Of all 50-word windows that nearly stand in an earlier document, by brute force over all pairs of documents, nine in ten are in a reported passage at least by half."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grams = {}
    for i, t in texts.items():
        w = SPACE.findall(lower(t))
        grams[i] = [hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)]
    sets = {i: set(g) for i, g in grams.items()}
    got = rows(passages.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")))
    inside = {}
    for r in got:
        inside.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    want = hit = 0
    ids = sorted(texts)
    for k, i in enumerate(ids):
        near = set()
        for j in ids[:k]:
            if len(grams[i]) >= 46 and len(grams[j]) >= 46 and len(sets[i] & sets[j]) >= 30:
                near.update(near_windows(grams[i], grams[j]))
        want += len(near)
        hit += sum(len(inside.get(i, set()) & set(range(s, s + 50))) >= 25 for s in near)
    assert want > 500 and hit >= 0.9 * want, (hit, want)


def test_passages_edges(spark):
    assert passages.repeated_passages(clashing(spark).limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(70))
    got = rows(passages.repeated_passages(table(spark, [long, long, long, None], [None, 5, 5, 6])))
    assert got == []
    assert {(r["doc_id"], r["match_id"]) for r in rows(passages.repeated_passages(table(spark, [long, long, long + " x"], [4, 5, 5])))} == {(5, 4)}
    assert passages.repeated_passages(clashing(spark)).count() == 0


# ---------------------------------------------------------------- op6


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert contamination.common_subsequence(contamination._masks(a), len(a), b) == best[-1][-1]


def leaky(seed):
    rng, words = random.Random(seed), vocabulary(seed, 2500)
    items = [sentence(rng, words, rng.randint(15, 60)) for _ in range(40)]
    texts, want = [], set()
    for i in range(240):
        parts = [sentence(rng, words, rng.randint(10, 300)) for _ in range(2)]
        if i % 6 == 0:
            k = rng.randrange(40)
            item = items[k].split()
            if i % 12 == 0:  # a paraphrase: a quarter of the words replaced, the answer kept
                for _ in range(len(item) // 4):
                    item[rng.randrange(len(item) - 5)] = rng.choice(words)
            parts.insert(1, " ".join(item))
            want.add((i, k))
        texts.append(" ".join(parts))
    return texts, items, want


def test_leaks_and_recall(spark):
    texts, items, want = leaky(4)
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, ""), (None, items[0])], "item_id int, text string")
    docs = clashing(spark, [*texts, None, "", "  "])
    got = {(r["doc_id"], r["item_id"]) for r in rows(contamination.find_leaks(docs, benchmark))}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert contamination.find_leaks(docs.limit(0), benchmark).count() == 0
    assert contamination.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_of_the_table(spark, sf):
    """Every item that stands word by word in a text, found by brute force, is reported."""
    alnum = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: f" {' '.join(alnum.findall(lower(r['text'])))} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: f" {' '.join(alnum.findall(lower(r['text'])))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]): r for r in rows(queries.op6_decontamination(spark, sf))}
    assert want and want <= set(got)
    assert {d for d, _ in got} == {d for d, _ in want}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_verify_finds_long_runs(seed):
    """A verbatim run of width shingles is part of some match, whatever stands around it."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 40, rng.integers(0, 60)) for _ in range(2))
    run = rng.integers(100, 10**6, 12)
    x, y = (np.concatenate([p, run, q]).astype(np.uint64) for p, q in ((a, b), (b, a)))
    got = passages.verify(x, y, 10, 80, 100)
    assert all(0 <= s and s + n <= len(x) and 0 <= s2 and s2 + n2 <= len(y) and sim >= 0.8 for s, n, s2, n2, sim in got)
    assert any(s < len(a) + 12 and s + n > len(a) for s, n, *_ in got)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_verify_sees_every_place_of_a_shingle(seed):
    """Where b repeats parts of the passage before or behind it, all places of equal runs (brute force) are in matches."""
    rng = np.random.default_rng(seed)
    run = rng.integers(100, 10**6, int(rng.integers(12, 40)))
    parts = [rng.integers(0, 30, rng.integers(0, 15)) for _ in range(5)]
    cuts = [run[: rng.integers(0, len(run))], run[rng.integers(0, len(run)) :]]
    x = np.concatenate([parts[0], run, parts[1]]).astype(np.uint64)
    y = np.concatenate([parts[2], cuts[0], parts[3], run, parts[4], cuts[1]]).astype(np.uint64)
    there = {tuple(y[k : k + 12].tolist()) for k in range(len(y) - 11)}
    want = {k + n for k in range(len(x) - 11) if tuple(x[k : k + 12].tolist()) in there for n in range(12)}
    got = passages.verify(x, y, 12, 80, 100)
    assert want and want <= {k for s, n, *_ in got for k in range(s, s + n)}
    for s, n, s2, n2, sim in got:
        u, v = set(x[s : s + n].tolist()), set(y[s2 : s2 + n2].tolist())
        assert n >= 12 and abs(sim - len(u & v) / len(u | v)) < 1e-9 and sim >= 0.8


def _grams(texts):
    return passages._shingles(" ".join(texts).encode(), 5)[0]


def test_verify_of_repetitive_texts():
    """One word, or one phrase, as often as a million times: seconds, not hours."""
    phrase = [f"w{k}" for k in range(37)]
    began = time.time()
    for n, one in ((1_000_000, ["spam"]), (300_000, phrase)):
        many = (one * (n // len(one) + 1))[:n]
        a, b = _grams([*many, "x", "y"]), _grams(["z", "q", *many, "u"])
        found = passages.verify(a, b, 46, 80, 100)
        inside = np.zeros(len(a), bool)
        for s, k, *_ in found:
            inside[s : s + k] = True
        assert inside[: n - 4].all()
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_those_of_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(passages, "EVERY_PAIR", [0, 0, 1, 4, 99][seed])
    rng = np.random.default_rng(seed)
    for _ in range(200):
        a, b = (W.mix(rng.integers(0, rng.integers(1, 6), rng.integers(0, 30)).astype(np.uint64)) for _ in range(2))
        want = []
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    want.append((i, j, n))
        assert list(zip(*(x.tolist() for x in passages._matches(a, b)))) == want


def test_verify_with_a_teaser():
    """b has the first half of the passage as a teaser before the whole."""
    run, other = np.arange(56), np.arange(1000, 1040)
    x, y = (np.concatenate(p).astype(np.uint64) for p in ((other, run), (run[:26], other + 500, run)))
    assert passages.verify(x, y, 46, 80, 100) == [(40, 56, 66, 56, 1.0)]


def test_verify_over_phrase_edits():
    """Passages with phrases of 2 or 3 words changed, put in or left out are found whole where their shingles' Jaccard is at least 0.8."""
    rng, tried = random.Random(5), 0
    grams = lambda v: W.ngram_hashes(W.mix(np.array(v, np.uint64)), 5)
    for _ in range(600):
        n, new = rng.randint(55, 200), lambda k: [rng.randrange(10**6, 10**9) for _ in range(k)]
        passage = new(n)
        other = passage[:]
        for at in sorted(rng.sample(range(5, n - 8), rng.randint(1, 3)), reverse=True):
            k = rng.randint(2, 3)
            other[at : at + rng.choice([0, k])] = new(rng.choice([0, k]))
        u, v = (set(grams(p).tolist()) for p in (passage, other))
        if len(u & v) < 0.8 * len(u | v) or len(other) < 50:
            continue
        tried += 1
        head, tail = new(30), new(30)
        got = passages.verify(grams(head + other + tail), grams(new(11) + passage + new(50)), 46, 80, 100)
        assert any(s <= 30 and s + k >= 30 + len(other) - 4 for s, k, *_ in got), (n, len(other), got)
    assert tried > 200
    x, y = list(range(90)), list(range(90))
    x[44:46] = 1000, 1001
    assert [(s, k) for s, k, *_ in passages.verify(grams(x), grams(y), 46, 80, 100)] == [(0, 86)]


def test_fragments_do_not_keep_copies_apart(spark):
    """Smaller documents with the first and the last words of a passage take its keys; the full copies still meet."""
    rng, words = random.Random(21), vocabulary(21, 3000)
    texts = [[], [], [], []]
    for _ in range(40):
        passage = sentence(rng, words, 60).split()
        for t, part in zip(texts, (passage[:49], passage[-49:], passage, passage)):
            t.append(f"{sentence(rng, words, 20)} {' '.join(part)} {sentence(rng, words, 20)}")
    got = {(r["doc_id"], r["match_id"]) for r in rows(passages.repeated_passages(table(spark, sum(texts, []))))}
    assert {(120 + k, 80 + k) for k in range(40)} <= got


def test_leak_copied_into_a_third_of_the_rows(spark):
    """Copies of a leak make its words common; they are found all the same, and so is an item of common words in every row."""
    rng, words = random.Random(31), vocabulary(31, 2500)
    items = [sentence(rng, words, 30) for _ in range(12)]
    hot = f"{sentence(rng, words, 40)} {items[0]} {sentence(rng, words, 40)}"
    texts = [hot if i % 3 == 0 else sentence(rng, words, 400) for i in range(240)]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(contamination.find_leaks(table(spark, texts), benchmark))}
    assert got == {(i, 0) for i in range(0, 240, 3)}
    texts = [f"{sentence(rng, words, 100)} {items[1]} {sentence(rng, words, 100)}" for _ in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in rows(contamination.find_leaks(table(spark, texts), benchmark))}
    assert got == {(i, 1) for i in range(60)}


@pytest.mark.parametrize("docs, holding", [(1, 1), (150, 30), (150, 150)])
def test_verbatim_leaks_in_few_and_in_all(spark, docs, holding):
    rng, words = random.Random(docs + holding), vocabulary(41, 2500)
    items = [sentence(rng, words, 30) for _ in range(5)]
    texts = [f"{sentence(rng, words, 50)} {items[2] if i < holding else ''} {sentence(rng, words, 50)}" for i in range(docs)]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id smallint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(contamination.find_leaks(table(spark, texts), benchmark))}
    assert got == {(i, 2) for i in range(holding)}


def test_leaks_of_long_short_and_paraphrased_items(spark):
    """Every pair that brute force accepts (whole texts against items), of items from 6 to 600 words, verbatim or with up to half of the words replaced."""
    rng, words = random.Random(51), vocabulary(51, 2500)
    items = [sentence(rng, words, n) for n in (6, 8, 12, 20, 30, 45, 60, 90, 150, 330, 600) for _ in range(4)]
    texts = []
    for k, item in enumerate(items * 3):
        w = item.split()
        for _ in range((0, len(w) // 5, int(len(w) * 0.42))[k // len(items)]):
            w[rng.randrange(max(1, len(w) - 5))] = rng.choice(words)
        texts.append(f"{sentence(rng, words, rng.randint(5, 150))} {' '.join(w)} {sentence(rng, words, rng.randint(5, 150))}")
    texts += [sentence(rng, words, 300) for _ in range(60)]
    ids = [None, *range(1, len(texts) - 1), 1]  # a null id and a repeated one
    found = rows(contamination.find_leaks(table(spark, texts, ids), spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")))
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = set()
    for i, text in zip(ids, texts):
        t = text.split()
        for k, item in enumerate(items):
            w, best = item.split(), (0, 0)
            for at in range(0, len(t), max(1, len(w) // 8)):  # stretches a little longer than the item
                part = t[at : at + len(w) + len(w) // 4]
                masks = contamination._masks
                best = max(best, (contamination.common_subsequence(masks(w), len(w), part) / len(w), contamination.common_subsequence(masks(w[-5:]), min(5, len(w)), part) / min(5, len(w))))
            if best[0] >= 0.8 or (best[0] >= 0.5 and best[1] >= 0.75 and len(w) >= 10):
                want.add((i, f"i{k}"))
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want)
    assert got <= {(i, f"i{k % len(items)}") for k, i in enumerate(ids[: 3 * len(items)])} | want
    assert {r["item_id"] for r in found if r["doc_id"] is None} == {"i0"}


def test_open_buckets_join_nodes_once(spark, monkeypatch):
    """Buckets of one component are closed, the others' nodes are told from the pivot's component; the one outer join has a row a node."""
    rows = [(1, n, 10) for n in (10, 11, 12)] + [(2, n, 10) for n in (10, 11, 20, 21, 30)] + [(3, 20, 20), (3, 30, 20)]
    members = spark.createDataFrame(rows, "key long, node long, pivot long")
    roots = spark.createDataFrame([(10, 10), (11, 10), (12, 10), (20, 20), (21, 20)], "node long, root long")
    plans, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = {(r["key"], r["node"], r["root"], r["outside"], r["s"], r["t"]) for r in jaccard._open(members, roots).collect()}
    assert got == {(2, 11, 10, False, 3, 1), (2, 20, 20, True, 3, 1), (2, 21, 20, True, 3, 1), (2, 30, 30, True, 3, 1)}
    assert sum("Join LeftOuter" in line for p in plans for line in p.splitlines()) == 1


def test_space_of_all_passages(spark):
    """Every passage of every document is in the rows that the space is fitted on, however tasks are dealt, once for each row of the table."""
    rng, words = random.Random(61), vocabulary(61, 4000)
    texts = [sentence(rng, words, rng.randint(1, 40)) for _ in range(5000)] + [None, "", sentence(rng, words, 500)]
    docs = table(spark, texts)
    df, passages = contamination.document_frequencies(docs)
    assert passages == 5000 + 8
    idf = contamination.place_weights(df, passages)
    one, many = (contamination.passage_rows(docs.repartition(k), idf) for k in (1, 7))
    assert one.shape == (contamination.SKETCH, 1 << contamination.BITS)
    assert np.allclose(sorted(one.sum(1)), sorted(many.sum(1)), atol=1e-3)
    assert ((np.abs(one).sum(0) > 1e-6) == (df > 0)).all()
    # passages have length 1, so the rows' squares are about their number
    assert abs((one**2).sum() / passages - 1) < 0.15
    again = contamination.passage_rows(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").union(docs.select("doc_id", "text")), idf)
    assert abs((again**2).sum() / (2 * passages) - 1) < 0.15


def test_a_node_meets_its_point_once(spark):
    """However many open buckets a node is in, the joins of the search have a row a node; its buckets are laid out behind them."""
    from quillon.llm.store import scratch

    one, other = (np.unique(np.random.default_rng(k).integers(0, 2**64, 100, np.uint64)) for k in (1, 2))
    sets = {1: one, 2: one, 3: other, 4: other}
    reps = spark.createDataFrame([(n, n, 100, bytearray(jaccard._counts(s, jaccard.GROUPS)), bytearray(jaccard._counts(s, jaccard.GROUPS))) for n, s in sets.items()], "node long, id long, n long, vec binary, fine binary")
    rows = spark.createDataFrame([(key, n, n, n > 2, 2, 2) for key in range(9) for n in sets], "key long, node long, root long, outside boolean, s long, t long")
    with scratch(spark):
        found = jaccard._searched(rows, reps, 90, 100)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"inline\(in#\d+\).*Join", plan, re.S) and "inline" not in plan[plan.index("Join"):]
        assert [tuple(r) for r in found.collect()] == [(4, 3)]
