"""Byte-level BPE against the library, the band join and collocations against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bands, bpe, collocations, queries

from .texts import TEXTS, clashing, rows, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sql(sf, name):
    con = duckdb.connect()
    for n in ("documents", "items", "sale_lines"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    return columns, got.fetchall()


def same(df, columns, want):
    assert sorted(df.columns) == sorted(columns)
    assert sorted([tuple(r) for r in df.select(*columns).collect()], key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- op11


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(RANKS, PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(library, vocabulary, text):
    made = vocabulary.encode(text)
    assert ids(made) == library.encode_ordinary(text)
    assert vocabulary.decode(made) == text.encode()


def test_every_code_point(library, vocabulary):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} 1{c}{c}.  {c} x" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for text, made in zip(texts, vocabulary.encode_all(texts)):
        assert ids(made) == library.encode_ordinary(text)


def test_a_model_of_few_ranks(tmp_path):
    """Ranks with holes; a piece that no merges lead to is taken where it is a whole match."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 290, b"abc": 400, b"xyz": 500, b" x": 600}
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    own = bpe.vocabulary(str(path), PATTERN)
    library = tiktoken.Encoding("few", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "ab", "xyz", "xyzz", " xyz", "aabcc abc  ab", "é\0"):
        assert ids(own.encode(text)) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    assert own.decode(np.array([1, 7000], "<u4").tobytes()) is None and own.decode(b"123") is None and own.decode(b"") == b""
    with pytest.raises(ValueError):
        bpe.serialised_model({b"a": 0})
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialised_model(ranks))
    assert model.vocab_size() == len(ranks) + 1 and model.unk_id() == len(ranks)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    monkeypatch.setattr(bpe, "MATCHES", 5)
    own = bpe.ByteBPE(RANKS, PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé\n12 ") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", "z" * 500]
    assert [ids(x) for x in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_round_trip(spark, library):
    for df in (table(spark), clashing(spark)):
        got = {r["doc_id"]: r for r in rows(bpe.round_trip(df, RANKS))}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            # the library's own splitter overflows on very long runs of white space
            if not re.search(r"\s{1000}", t or ""):
                want = library.encode_ordinary(t or "")
                assert got[i]["n_tokens"] == len(want)
                assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    made = bpe.encode_texts(table(spark, ["a b", "a b", None], [None, 3, 3]), RANKS)
    assert Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in made.collect()) == Counter({(None, np.array(library.encode_ordinary("a b"), "<u4").tobytes(), 2): 1, (3, np.array(library.encode_ordinary("a b"), "<u4").tobytes(), 2): 1, (3, b"", 0): 1})
    assert bpe.round_trip(table(spark).limit(0), RANKS).count() == 0
    assert [r["decoded"] for r in bpe.decode_ids(spark.createDataFrame([(None,)], "ids binary"), RANKS).collect()] == [None]


def test_op11_over_a_table(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(queries.op11_byte_bpe(spark, sf))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == {i: (len(x := library.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, t in texts.items()}


# ---------------------------------------------------------------- op12


def paired(left, right, width, num, den, top):
    """Every left row against every right row."""
    out = Counter()
    for i, p in left:
        near = []
        for owner, a, b, u, w in right:
            if None in (i, p, owner, a, u, w) or owner == i:
                continue
            gap = abs(u - p)
            if gap <= width or den * gap <= num * min(u, p):
                near.append(((gap, u, a, b is not None, b or 0, owner), b, w))
        near.sort()
        sums = (len(near), sum(k[0][0] for k in near), sum(k[2] for k in near))
        for r, ((gap, u, a, _, _, owner), b, _) in enumerate(near[:top], 1):
            out[(i, r, gap, u, a, b, owner, *sums)] += 1
        if not near:
            out[(i, 0, None, None, None, None, None, 0, 0, 0)] += 1
    return out


def band_rows(spark, left, right, **how):
    a = spark.createDataFrame(left, "id long, p long").withColumn("rank", F.lit("clash"))
    b = spark.createDataFrame(right, "owner long, a long, b long, u long, weight long").withColumn("key", F.lit("clash")).withColumn("n", F.lit("clash"))
    return Counter(tuple(r) for r in bands.band_join(a.repartition(3), b.repartition(4), **how).collect())


@pytest.mark.parametrize("seed", range(4))
def test_band_join(spark, monkeypatch, seed):
    monkeypatch.setattr(bands, "BLOCK", [1024, 3, 1, 7][seed])
    monkeypatch.setattr(bands, "HELD", [1 << 20, 20, 5, 50][seed])
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.randint(-60, 60), rng.randint(0, 900), rng.randint(9_000, 11_000), rng.randint(0, 2_000_000), 700, 701])
    maybe = lambda x: None if rng.random() < 0.04 else x
    left = [(maybe(i), maybe(value())) for i in range(60)] + [(3, 700), (3, 700), (4, 2_000_000)]
    # one owner and one value hold a third each, and rows repeat
    right = [(maybe(rng.choice([3, rng.randint(0, 60)])), maybe(rng.randint(0, 9)), maybe(rng.randint(0, 3)), maybe(rng.choice([700, value(), value()])), maybe(rng.randint(0, 2**32))) for _ in range(400)]
    right += right[:40] + [(3, k, 0, 699, 1) for k in range(30)]
    how = [dict(width=50, num=5, den=1000, top=10), dict(width=3, num=0, den=1, top=2), dict(width=0, num=1, den=10, top=1), dict(width=50, num=5, den=1000, top=3)][seed]
    assert band_rows(spark, left, right, **how) == paired(left, right, **how)


@pytest.mark.parametrize("look", [1, 2, 16])
def test_tiles(monkeypatch, look):
    """A tile's entries are those of all its comparisons, however few places are looked at first."""
    monkeypatch.setattr(bands, "LOOK", look)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n, top = int(rng.integers(1, 120)), int(rng.integers(1, 5))
        flat = {c: rng.integers(0, 6, n) for c in ("a", "b", "owner")} | {"n": np.ones(n, np.int64), "gaps": np.zeros(n, np.int64), "weight": rng.integers(0, 99, n)}
        flat["key"] = flat["u"] = rng.choice([rng.integers(-50, 300, n), rng.integers(0, 12_000, n)][seed % 2], n)
        entries = bands._reduced(dict(flat), top)
        p = np.unique(rng.choice(flat["u"], 9) + rng.integers(-60, 60, 9))
        made = bands._tile(p, entries, 50, 5, 1000, top)
        pairs = {c: [] for c in flat}
        for v in p:
            _, near = bands._near(flat["u"], v, 50, 5, 1000)
            for c in flat:
                pairs[c].append(flat[c][near] if c not in ("key", "gaps") else np.full(near.sum(), v) if c == "key" else np.abs(flat["u"][near] - v))
        want = bands._reduced({c: np.concatenate(x) for c, x in pairs.items()}, top)
        if made is None:
            assert not len(want["key"])
        else:
            assert all(np.array_equal(made[c], want[c]) for c in want)


def test_band_join_of_empty_tables(spark):
    assert band_rows(spark, [], [(1, 1, 1, 1, 1)]) == Counter()
    assert band_rows(spark, [(1, 5), (None, None)], []) == Counter({(1, 0, *[None] * 5, 0, 0, 0): 1, (None, 0, *[None] * 5, 0, 0, 0): 1})


def test_cells_never_fall(spark):
    values = [*range(-30_000, 30_000, 7), 10**6, 10**6 + 1, 10**9, 10**15, -(10**12)]
    got = [r[1] for r in sorted(tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", bands._cell(F.col("v"), 50)).collect())]
    assert all(x <= y for x, y in zip(got, got[1:]))


def test_prices(spark):
    """Cents are rounded half up, u in exact integers; lines without a number never pair."""
    lines = spark.createDataFrame([(1, 1, 7, 3, 10.0), (1, 2, 7, 0, 10.0), (None, 1, 7, 1, 3.33), (2, None, 8, 2, 6.67), (3, 1, 8, 1, float("nan")), (4, 1, 9, None, 3.33), (5, 1, 9, -3, -9.99)], "sale_id long, line_no int, item_id long, quantity int, amount double")
    items = spark.createDataFrame([(9, 3.33), (10, None), (11, 1e20)], "item_id long, price double").withColumn("name", F.lit("x"))
    got = {(r["item_id"], r["rank"]): r for r in rows(bands.near_prices(lines, items))}
    assert set(got) == {(9, 1), (9, 2), (10, 0), (11, 0)}
    assert (got[9, 1]["gap"], got[9, 1]["u"], got[9, 1]["sale_id"]) == (0, 333, 1) and (got[9, 2]["gap"], got[9, 2]["u"], got[9, 2]["line_no"]) == (1, 334, None)
    assert got[9, 1]["lines_crc"] == zlib.crc32(b"1,1,7") + zlib.crc32(b"2,,8") and got[9, 1]["gap_sum"] == 1


def test_op12_is_its_sql(spark, sf):
    same(queries.op12_band_join(spark, sf), *sql(sf, "op12_band_join"))


# ---------------------------------------------------------------- op13


def counted(docs, least, longest, first, share=(100, 100)):
    """Plain counts of every phrase, and exact scores."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in many.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) < 2 or any(len(q) > len(p) and share[0] * c >= share[1] * a and inside(q) for q, c in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (many[p[:k]] * many[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), many[p[:k]], many[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "a", "zürich", "x y", "b", " c", "dd"]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60)))
        texts.append((rng.choice(["en", "de", None]), t if rng.random() < 0.95 else None))
    return texts + texts[:20] + [("en", "new york times of the day " * 30), ("fr", "rare words only"), ("und", "the of the of")]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(*x, "clash", 1) for x in texts], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=8, longest=5, first=40).collect())
    assert got == counted(texts, 8, 5, 40) and len(got) > 60
    short = sorted(tuple(r) for r in collocations.collocations(df, least=8, longest=2, first=5, share=(10, 9)).collect())
    assert short == counted(texts, 8, 2, 5, (10, 9))


def test_a_full_map_loses_nothing(spark):
    """Bits that are set by chance only add phrases that counts then leave out."""
    texts = corpus(4)
    df = spark.createDataFrame(texts, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(df, least=8, first=40, map_bits=6).collect()) == counted(texts, 8, 5, 40)


def test_collocations_edges(spark):
    for df in (table(spark).limit(0), table(spark, [None, "", "  \n "])):
        assert collocations.collocations(df).count() == 0
    got = rows(collocations.collocations(clashing(spark), least=500))
    assert {r["phrase"] for r in got} == set() or all(r["a"] >= 500 for r in got)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_stretches_hold_every_phrase_once(monkeypatch, k):
    monkeypatch.setattr(collocations, "CHUNK", 10)
    rng = random.Random(k)
    for _ in range(200):
        texts = ["".join(rng.choice("ab  .") for _ in range(rng.choice([0, 5, 60]))) for _ in range(4)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        found = Counter()
        for part, places, of in collocations._stretches(data, offsets, k):
            p = collocations._Pieces(part, places)
            at = np.flatnonzero(p.inside(k))
            found.update(zip(of[p.of[at]].tolist(), p.phrases(at, k).to_pylist()))
        want = Counter()
        for i, t in enumerate(texts):
            for piece in t.split("."):
                w = piece.split()
                want.update((i, " ".join(w[j : j + k])) for j in range(len(w) - k + 1))
        assert found == want


def test_op13_is_its_sql(spark, sf):
    same(queries.op13_collocations(spark, sf), *sql(sf, "op13_collocations"))
