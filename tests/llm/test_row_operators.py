"""Operators that judge each text for itself, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import licenses, quality, queries, rules, tokens
from quillon.llm import words as W

from .texts import TEXTS, clashing, rows, table

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---------------------------------------------------------------- words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\t Zé0.-　", max_size=30), max_size=6))
def test_words(texts):
    import pyarrow as pa

    for classes, low, pattern in ((W.SPACE_WORDS, False, SPACE), (W.ALNUM_WORDS, True, ALNUM)):
        found, seen = [], {}
        for i, j, w in W.batches_of(pa.array(texts, pa.string()), classes, low, limit=16):
            h = w.hashes()
            for k in range(j - i):
                own = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.ptr[k] : w.ptr[k + 1]], w.ends[w.ptr[k] : w.ptr[k + 1]])]
                found.append(own)
                for x, v in zip(own, h[w.ptr[k] : w.ptr[k + 1]]):
                    assert seen.setdefault(x, v) == v
        assert found == [pattern.findall(lower(t) if low else t) for t in texts]
        assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- op1


def test_quality_contract(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in rows(queries.op1_quality_classifier(spark, sf))}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == set(docs_of(spark, sf))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_of_repeated_and_null_ids(spark):
    """An id counts once in the fit, however often it stands; a null id has a score and no side."""
    texts = [f"good plain text number {k}" for k in range(20)] + [f"BAD!!! $$$ {k} BAD!!!" for k in range(20)]
    labels = spark.createDataFrame([(k, int(k < 20), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    once = quality.fit_quality(table(spark, texts), labels)
    more = quality.fit_quality(table(spark, texts * 3 + ["x"], [*range(40)] * 3 + [None]), labels)
    assert np.allclose(once.weights, more.weights) and once.bias == more.bias
    got = rows(quality.score_quality(table(spark, ["good plain text", "BAD!!! $$$"], [None, 7]), once), "doc_id")
    assert got[0]["held_out"] is None and got[0]["score"] > got[1]["score"]
    few = quality.fit_quality(table(spark, texts), labels, most=6)
    assert np.isfinite(few.weights).all()


def test_dual_coordinate_descent_is_exact():
    """The same weights as the dual's solution by projected gradient over the whole kernel matrix."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 36)
    made = [np.unique(np.concatenate([rng.integers(8, 60, 6), [k] if rng.random() < 0.7 else [5]])) for k in y]
    scale = rng.normal(size=64)
    w, b = quality.dual_coordinate_descent(made, y, scale, c=0.7, rounds=3000)
    x = np.zeros((36, 65))
    for i, r in enumerate(made):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 64] = 1
    sign = np.where(y == 1, 1.0, -1.0)
    top = 0.7 * np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum()) * 36 / 2
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    a, step = np.zeros(36), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        a = np.clip(a - step * (q @ a - 1), 0, top)
    exact = (a * sign) @ x
    assert np.abs(np.append(w, b) - exact).max() < 1e-2
    cost = lambda v: 0.5 * v @ v + (top * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert cost(np.append(w, b)) <= cost(exact) * 1.0005


def test_quality_edges(spark):
    docs = clashing(spark)
    model = quality.Model(np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS), 0.0, 1.0, 0.0)
    got = rows(quality.score_quality(docs, model), "doc_id")
    assert [r["doc_id"] for r in got] == list(range(len(TEXTS))) and {r["score"] for r in got} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    fitted = quality.fit_quality(docs, labels)
    assert np.isfinite(fitted.scores(next(W.batches_of(__import__("pyarrow").array(["", "x y"]), lower=True))[2])).all()
    assert quality.fit_quality(docs, labels.limit(0)).slope == 1.0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    made = [np.unique(np.concatenate([rng.integers(10, 500, 20), [k] if rng.random() < 0.9 else [5]])) for k in y]
    scale = quality.log_count_ratio(made, y, 512)
    w, b = quality.dual_coordinate_descent(made, y, scale, c=1.0, rounds=50)
    assert np.mean([(float(w[r] @ scale[r]) + b > 0) == v for r, v in zip(made, y)]) > 0.95


# ---------------------------------------------------------------- op2


def places_of(words, phrase):
    p = phrase.split()
    return [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]


def brute_licenses(text):
    words = ALNUM.findall(lower(text or ""))
    found = {phrase: places_of(words, phrase) for phrase in licenses.BASE_PHRASES}
    places = sum(found.values(), [])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({licenses.BASE_PHRASES[p] for p in found if found[p]}))


def met(expression):
    """(identifiers, whether the expression can be met), by recursive descent; None where it does not parse whole."""
    tokens, at = re.findall(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*", expression), 0

    def word():
        return tokens[at].lower() if at < len(tokens) else None

    def one():
        nonlocal at
        if word() in (None, "or", "and", "with", ")"):
            raise ValueError
        at += 1
        if tokens[at - 1] == "(":
            got = chain("or")
            if word() != ")":
                raise ValueError
            at += 1
            return got
        name = tokens[at - 1].lower().rstrip(".:-")
        return {name}, licenses.family(name) in licenses.PERMISSIVE

    def excepted():
        nonlocal at
        got = one()
        while word() == "with":
            at += 1
            one()
        return got

    def chain(op):
        nonlocal at
        below = excepted if op == "and" else lambda: chain("and")
        got = below()
        while word() == op:
            at += 1
            more = below()
            got = got[0] | more[0], (got[1] or more[1]) if op == "or" else (got[1] and more[1])
        return got

    try:
        got = chain("or")
        return got if at == len(tokens) else None
    except ValueError:
        return None


def brute_labels(text):
    """(labels, permissive): every phrase place by place, every tag's expression by recursive descent."""
    words = ALNUM.findall(lower(text or ""))
    labels, verdicts = set(), []
    for phrase, label in {**licenses.NOTICES, **licenses.BASE_PHRASES}.items():
        if places_of(words, phrase):
            labels.add(label)
    notices = set(labels)
    for line in re.findall(r"spdx-license-identifier:[ \t]*([^\r\n]*)", text or "", re.IGNORECASE):
        got = met(line)
        if got is None:
            return None
        labels |= got[0]
        verdicts.append(got[1])
    return ",".join(sorted(labels)), all(verdicts) if verdicts else notices <= licenses.PERMISSIVE if notices else None


def test_licenses(spark, sf):
    for df, texts in ((clashing(spark), dict(enumerate(TEXTS))), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(spark, sf))):
        got = rows(licenses.scan_licenses(df))
        assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
        for r in got:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(texts[r["doc_id"]])
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
            want = brute_labels(texts[r["doc_id"]])
            assert want is None or (r["labels"], r["permissive"]) == want
    assert licenses.scan_licenses(clashing(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, labels, ok",
    [
        ("MIT", {"mit"}, True),
        ("GPL-2.0-only OR MIT", {"gpl-2.0-only", "mit"}, True),
        ("GPL-2.0-only AND MIT", {"gpl-2.0-only", "mit"}, False),
        ("MIT OR GPL-3.0 AND GPL-2.0", {"gpl-3.0", "gpl-2.0", "mit"}, True),
        ("(MIT OR GPL-3.0) AND GPL-2.0", {"gpl-3.0", "gpl-2.0", "mit"}, False),
        ("Apache-2.0 WITH LLVM-exception", {"apache-2.0"}, True),
        ("CC-BY-4.0", {"cc-by-4.0"}, True),
        ("CC-BY-NC-4.0", {"cc-by-nc-4.0"}, False),
        ("CC-BY-ND-4.0 OR GPL-2.0-only", {"cc-by-nd-4.0", "gpl-2.0-only"}, False),
        ("CC-BY-SA-4.0 OR CC-BY-4.0", {"cc-by-sa-4.0", "cc-by-4.0"}, True),
        ("((MIT", {"mit"}, True),
        ("MIT AND", {"mit"}, True),
        ("MIT AND (", {"mit"}, True),
        ("(MIT OR (", {"mit"}, True),
        ("MIT OR ( WITH", {"mit"}, True),
        ("Apache-2.0 WITH (", {"apache-2.0"}, True),
        ("OR MIT", set(), None),
        ("(", set(), None),
        ("", set(), None),
    ],
)
def test_expressions(text, labels, ok):
    assert licenses.read_expression(text) == (labels, ok)


def test_all_short_expressions():
    """Every sequence of up to six tokens: no crash, and the value of recursive descent where it parses whole."""
    from itertools import product

    parsed = 0
    for n in range(7):
        for tokens_ in product(("mit", "gpl", "or", "and", "with", "(", ")")[: 7 if n < 6 else 6], repeat=n):
            text = " ".join(tokens_)
            got, want = licenses.read_expression(text), met(text)
            if want is not None:
                assert got == want, text
                parsed += 1
    assert parsed > 100


def test_clauses_of_notices():
    for text, ok in (("cc by", True), ("licensed cc by nc nd", False), ("CC BY-SA 4.0", False), ("Creative Commons Attribution NonCommercial", False), ("Creative Commons Attribution 4.0", True), ("nothing", None)):
        assert licenses.scan_text(text)[-1] is ok


def test_postfix():
    assert licenses.to_postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]


# ---------------------------------------------------------------- op3


def test_token_counts(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for df, texts in ((clashing(spark), dict(enumerate(TEXTS))), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(spark, sf))):
        got = {r["doc_id"]: r for r in rows(tokens.count_tokens(df, BPE))}
        assert set(got) == set(texts)
        for i, text in texts.items():
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)
    assert tokens.count_tokens(clashing(spark).limit(0), BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stlve0<|>endoftx, 　é漢１"), st.characters(codec="utf-8")), max_size=60))
def test_fast_encoder_is_the_library(text):
    e = tokens.encoder(BPE)
    want = e.library.encode(text, add_special_tokens=False).ids
    assert next(e.encode([text])).tolist() == want and e.lengths([text], 1)[0] == len(want)


def test_long_texts_split_safely(monkeypatch):
    monkeypatch.setattr(tokens, "SPLIT_CHARS", 7)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        e = tokens.Encoder(public_tokenizers.path(name))
        texts = [t[:5000] for t in TEXTS if t] + ["", "a  b   c \n d 's x's <|endoftext|> y"]
        want = [list(e.library.encode(x)) if e.kind == "model" else e.library.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in e.encode(texts)] == want
        assert e.lengths(texts, len(texts)).tolist() == list(map(len, want))


# ---------------------------------------------------------------- op5


def brute_rules(text):
    text = text or ""
    words = SPACE.findall(text)

    def marks(n):
        c = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        hit = set()
        for k in range(len(words) - n + 1):
            if c[tuple(words[k : k + n])] > 1:
                hit |= set(range(k, k + n))
        return hit

    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    repeat = len(marks(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    chars = sum(map(len, words))
    share = {n: sum(len(words[k]) for k in marks(n)) / max(chars, 1) for n in rules.NGRAM_SHARE}
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed), share


def test_quality_rules(spark, sf):
    for df, texts in ((clashing(spark), dict(enumerate(TEXTS))), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(spark, sf))):
        got = {r["doc_id"]: r for r in rows(rules.quality_rules(df))}
        assert set(got) == set(texts)
        for i, text in texts.items():
            r, (want, share) = got[i], brute_rules(text)
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, i
            assert all(abs(r[f"share_{n}"] - s) < 1e-12 for n, s in share.items())
            assert r["kept"] == (not want[5] and all(s <= rules.NGRAM_SHARE[n] for n, s in share.items()) and r["share_lines"] <= rules.LINE_SHARE)
    assert rules.quality_rules(clashing(spark).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \né", max_size=40), max_size=5))
def test_rules_small(texts):
    import pyarrow as pa

    for i, j, w in W.batches_of(pa.array(texts, pa.string()), limit=20):
        m = rules.measure(w)
        for k in range(j - i):
            want, share = brute_rules(texts[i + k])
            assert tuple(int(m[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[:5]
            assert all(abs(m[f"chars_{n}"][k] / max(want[1], 1) - s) < 1e-12 for n, s in share.items())


def test_repeated_and_null_ids(spark):
    df = table(spark, ["one two", "one two", None], [7, 7, None])
    for made in (licenses.scan_licenses(df), tokens.count_tokens(df, BPE), rules.quality_rules(df)):
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in made.collect()) == [(False, 7), (False, 7), (True, None)]


def test_every_repetition_rule_decides(spark):
    """Texts that the base rules keep and one measure of repetition alone drops; what repeats once and shortly stays."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    five, eight, ten, line = fresh(5), fresh(8), fresh(10), fresh(4)
    texts = [
        " ".join(sum(([*fresh(45), *five] for _ in range(3)), []) + five * 0 + sum(([*fresh(9), *five] for _ in range(3)), [])),
        " ".join(fresh(90) + eight + fresh(9) + eight),
        " ".join(fresh(150) + ten + fresh(9) + ten),
        "\n".join([" ".join(fresh(12)), " ".join(line), " ".join(fresh(12)), " ".join(line), " ".join(fresh(12)), " ".join(line), " ".join(fresh(12)), " ".join(line)]),
        " ".join(fresh(200) + five + fresh(9) + five),
    ]
    got = {r["doc_id"]: r for r in rows(rules.quality_rules(table(spark, texts)))}
    assert not any(r["base_failed"] for r in got.values())
    over = [(r["share_5"] > rules.NGRAM_SHARE[5], r["share_8"] > rules.NGRAM_SHARE[8], r["share_10"] > rules.NGRAM_SHARE[10], r["share_lines"] > rules.LINE_SHARE) for _, r in sorted(got.items())]
    assert over == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (False, False, False, True), (False,) * 4]
    assert [got[k]["kept"] for k in range(5)] == [False] * 4 + [True]


def test_repetition_goes_with_bad_labels(spark):
    """Of what the base rules keep, the method drops documents labelled bad at over twice the rate of good ones, and few good ones."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    dropped = {0: [], 1: []}
    for r in rows(queries.op5_quality_rules(spark, sf)):
        if not r["base_failed"] and labels.get(r["doc_id"]) in dropped:
            dropped[labels[r["doc_id"]]].append(not r["kept"])
    bad, good = np.mean(dropped[0]), np.mean(dropped[1])
    assert sum(dropped[0]) >= 7 and bad > 2 * good and good < 0.01
