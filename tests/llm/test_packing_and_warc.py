import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import packing, queries, sequences, store, warc

from .texts import LONG, TEXTS, clashing, rows, table

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["even", "hot", "short", "long", "one", "none"])
def test_plan_places_every_piece(kind):
    rng = np.random.default_rng(1)
    lengths = {"even": rng.integers(1, 129, 5000), "hot": np.where(np.arange(3000) % 3, rng.integers(1, 129, 3000), 90), "short": rng.integers(1, 9, 4000), "long": rng.integers(100, 129, 500), "one": np.array([5]), "none": np.zeros(0, int)}[kind]
    hist = np.bincount(lengths, minlength=129)
    plan = packing.Plan(hist)
    if not len(lengths):
        assert plan.n_sequences == 0
        return
    rank = np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths):
        rank[lengths == n] = np.arange((lengths == n).sum())
    where, offset = plan.place(lengths.astype(np.int64), rank)
    _, _, best = packing.BestFit(128).pack(lengths)
    assert plan.n_sequences <= best * 1.05 + 1 and plan.n_sequences == len(set(where))
    _gapless(where, offset, lengths, 128)


def _gapless(where, offset, lengths, size):
    for b in set(where):
        own = sorted((o, n) for w, o, n in zip(where, offset, lengths) if w == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= size


def test_best_fit_takes_the_tightest_bin():
    where, offset, bins = packing.BestFit(10).pack(np.array([7, 6, 3, 4, 10, 2, 1]))
    assert bins == 4 and where[0] == where[2] and where[1] == where[3]
    _gapless(where, offset, [7, 6, 3, 4, 10, 2, 1], 10)
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 700)
    where, offset, bins = packing.BestFit(64).pack(lengths)
    rooms = []
    for n in sorted(lengths, reverse=True):  # plain best fit
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert bins == len(rooms)
    _gapless(where, offset, lengths, 64)


def check_packing(got, texts, size=1024, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // size)
        for k, r in enumerate(own):
            assert r["start"] == at and (r["length"] == size or k == 0) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    where, offset, lengths = (np.array([r[c] for r in got]) for c in ("sequence_id", "offset", "length"))
    order = np.lexsort((offset, where))
    where, offset, lengths = where[order], offset[order], lengths[order]
    first = np.r_[True, where[1:] != where[:-1]]
    assert (offset[first] == 0).all() and ((offset[1:] == offset[:-1] + lengths[:-1]) | first[1:]).all() and (offset + lengths <= size).all()
    return first.sum(), -(-lengths.sum() // size)


def test_pattern_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    used, least = check_packing(rows(sequences.pattern_pack(docs, BPE)), texts)
    assert used <= least * 1.1 + 1
    check_packing(rows(sequences.pattern_pack(clashing(spark), BPE)), dict(enumerate(TEXTS)))
    assert sequences.pattern_pack(clashing(spark).limit(0), BPE).count() == 0
    assert rows(sequences.pattern_pack(table(spark, [None, ""]), BPE, end_id=None)) == []


def test_packed_ids_round_trip(spark, sf):
    got = rows(queries.op9_packed_ids(spark, sf))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(got, texts)
    assert all(r["positions_reset"] for r in got) and used <= least * 1.15 + 2
    to = store.new_path(spark, "t")
    sequences.write_packed(clashing(spark), BPE, to, block=5, wide=True)
    packed = spark.read.parquet(to)
    check_packing(rows(sequences.read_segments(packed, wide=True)), dict(enumerate(TEXTS)))
    for r in packed.collect():
        ids, at = np.frombuffer(r["ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == 1024 and at[0] == 0 and (ids[at[-1] :] == 0).all() and len(at) == len(r["segment_ids"]) + 1
    to = store.new_path(spark, "t")
    sequences.write_packed(clashing(spark).limit(0), BPE, to)
    assert sequences.read_segments(spark.read.parquet(to)).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    """Every row is packed for itself, whatever its id."""
    df = table(spark, ["one two", "one two", None, LONG, LONG], [7, 7, None, None, 7])
    to = store.new_path(spark, "t")
    sequences.write_packed(df, BPE, to, wide=True)
    for got in (rows(sequences.pattern_pack(df, BPE)), rows(sequences.read_segments(spark.read.parquet(to), wide=True))):
        short = [r for r in got if r["length"] < 10]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["length"]) for r in short) == [(False, 7, 0, 3), (False, 7, 0, 3), (True, 0, 0, 1)]
        long = [r for r in got if r["length"] >= 10]
        total = {i: sum(r["length"] for r in long if r["doc_id"] == i) for i in (7, None)}
        assert total[7] == total[None] > 1024
        filled = {}
        for r in got:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024


# ---------------------------------------------------------------- WARC


def pages(spark, payloads, ids=None):
    ids = ids or range(len(payloads))
    return spark.createDataFrame([(i, f"http://x/{i}\r\nX-Bad: 1", p, "x", "y") for i, p in zip(ids, payloads)], "page_id long, url string, html string, id string, first string").repartition(3)


PAYLOADS = ["a" * 100, "a" * 99, None, "", "a" * 100, "a" * 99, "é" * 60, "é" * 60, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, "a" * 100, "line\n" * 50_000, "end\r\n\r\n" + "z" * 200]


def want(payloads):
    out, first = [], {}
    for i, p in enumerate(payloads):
        raw = (p or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        f = first.setdefault(d, i) if len(raw) >= 100 else i
        out.append({"page_id": i, "payload_bytes": len(raw), "payload_digest": d, "record_type": "response" if f == i else "revisit", "refers_to": None if f == i else f})
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, PAYLOADS), to, compress)
    back = warc.read_warc(spark, to)
    assert rows(warc.archive_index(back), "page_id") == want(PAYLOADS)
    payload = {r["record_id"]: r["payload"] for r in back.collect()}
    for r in want(PAYLOADS):
        assert bytes(payload[f"<urn:page:{r['page_id']}>"]) == (b"" if r["refers_to"] is not None else (PAYLOADS[r["page_id"]] or "").encode())


def test_warc_pushdown_and_headers(spark):
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, PAYLOADS), to, False)
    n = sum(r["record_type"] == "revisit" for r in want(PAYLOADS))
    back = warc.read_warc(spark, to, payload=False)
    assert back.filter("record_type = 'revisit'").count() == n
    assert back.filter(F.col("record_type").isin("revisit", "metadata")).count() == n
    assert back.filter("record_type = 'revisit' and record_id = 'x'").count() == 0
    assert back.filter("payload is not null").count() == 0
    plan = back.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan.split("BatchScan")[0]  # the reader has taken it
    assert spark.read.format("warc").option("partBytes", "1").load(to).rdd.getNumPartitions() == len({r["f"] for r in spark.read.text(to).select(F.input_file_name().alias("f")).collect()})


def files_of(spark, to):
    from pathlib import Path

    return sorted(Path(to.removeprefix("file:")).glob("part-*"))


def test_warc_members(spark):
    """Each record is a gzip member that any reader inflates; members that no predicate wants are passed over, not inflated."""
    import gzip

    rng = np.random.default_rng(1)
    large = ["".join(map(chr, rng.integers(97, 123, 300_000))) for _ in range(12)]
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, large + large[:2]), to)
    assert rows(warc.archive_index(warc.read_warc(spark, to)), "page_id") == want(large + large[:2])
    made = kept = 0
    for f in files_of(spark, to):
        assert f.name.endswith(".warc.gz")
        raw = f.read_bytes()
        whole, n, at = gzip.decompress(raw), 0, 0
        while at < len(raw):
            size = warc.member_length(raw[at : at + 24])
            assert gzip.decompress(raw[at : at + size]).startswith(b"WARC/1.1\r\n")
            at, n = at + size, n + 1
        assert at == len(raw) and n == whole.count(b"WARC/1.1\r\n")
        assert whole.count(b"WARC-Profile: ") == whole.count(b"WARC-Type: revisit")
        for wanted, payload in (({"record_type": frozenset(["revisit"])}, True), ({}, False)):
            with open(f, "rb") as file:
                source = warc.Inflated(file)
                found = list(warc.read_members(file, wanted, payload, source))
                assert source.inflated <= n * 4096
                kept += len(found) if wanted else 0
                made += 0 if wanted else len(found)
    assert (made, kept) == (14, 2)
    assert not [x for x in __import__("os").listdir(to.removeprefix("file:")) if x.startswith("_temporary")]


def test_warc_foreign_members(tmp_path):
    """Files of members without a told length, one member a record or one a file, and without compression."""
    import gzip

    record = lambda k, p: f"WARC/1.0\r\nWARC-Type: {'response' if k % 2 else 'metadata'}\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n".encode()
    parts = [record(k, "x" * (k * 40_000)) for k in range(5)]
    for name, data in (("each", b"".join(map(gzip.compress, parts))), ("one", gzip.compress(b"".join(parts))), ("own", b"".join(map(warc.member, parts)))):
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        with open(path, "rb") as file:
            assert [(r[0], len(r[-1])) for r in warc.read_members(file, {}, True)] == [(f"<{k}>", k * 40_000) for k in range(5)]
        with open(path, "rb") as file:
            assert [r[0] for r in warc.read_members(file, {"record_type": frozenset(["response"])}, False)] == ["<1>", "<3>"]


def test_warc_headers_are_checked(spark):
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, ["q" * 200, "r" * 200]), to, False)
    for f in files_of(spark, to):
        f.write_bytes(f.read_bytes().replace(b"q" * 200, b"p" * 200))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="unlike its headers"):
        warc.archive_index(warc.read_warc(spark, to)).collect()


def test_warc_edges(spark):
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, PAYLOADS).limit(0), to)
    assert warc.archive_index(warc.read_warc(spark, to)).count() == 0
    to = store.new_path(spark, "w")
    warc.write_warc(pages(spark, ["q" * 200, "q" * 200, "r" * 200, "q" * 200, "r" * 200], [None, 5, 5, 5, 9]), to)
    got = rows(warc.archive_index(warc.read_warc(spark, to)), "page_id", "payload_digest")
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(None, "response", None)] + [(5, "response", None)] * 3 + [(9, "revisit", 5)]


def test_warc_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    sql = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()['op10_warc']})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in rows(queries.op10_warc(spark, sf))) == sql
