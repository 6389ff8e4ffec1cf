"""The pipeline, stage by stage, against what each stage may and must do."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import contamination, quality

from .test_pair_operators import edited, sentence, shingles, vocabulary
from .test_packing_and_warc import check_packing
from .texts import SCHEMA, TEXTS, clashing, rows, table

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return [{r["doc_id"]: r for r in df.collect()} for df in out[:-1]] + [rows(out[-1])]


def test_stages_filter_and_keep_columns(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert set(after) <= set(before) and all(list(r.asDict()) == DOCS for r in after.values())
    for k in (1, 2, 4):
        assert all(stages[k][i] == stages[k - 1][i] for i in stages[k])


def test_quality_stage(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score_quality(docs, model).collect() if r["predicted"]}
    assert set(stages[1]) == kept


def test_near_copies_stage(stages):
    sets = {i: shingles(r["text"], 5) for i, r in stages[1].items()}
    linked = lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ids = sorted(sets)
    root = {i: i for i in ids}
    for _ in range(5):
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    assert set(stages[2]) == {i for i in ids if root[i] == i}


def test_passages_stage(stages):
    before, after = stages[2], stages[3]
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[i]["text"] or len(r["text"]) < len(before[i]["text"]))
    seen = {}
    for i, r in sorted(after.items()):  # no verbatim run of 60 words stays in two documents
        w = r["text"].split()
        for k in range(len(w) - 59):
            assert seen.setdefault(tuple(w[k : k + 60]), i) == i


def test_leaks_stage(spark, sf, stages):
    left = spark.createDataFrame([tuple(r) for r in stages[4].values()], SCHEMA)
    assert contamination.find_leaks(left, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0


def test_packing_stage(stages):
    used, least = check_packing(stages[5], {i: r["text"] for i, r in stages[4].items()})
    assert used <= least * 1.15 + 2


def test_run_is_its_stages(spark, sf, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows(corpus_pipeline.run(spark, sf)))) == sorted(map(key, stages[5]))


def test_edges(spark, sf):
    for texts in (TEXTS, []):
        docs = table(spark, texts)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, sf)
            assert made.count() >= (len(texts) > 0 and k > 0)


def test_clashing_columns_and_ids(spark, sf):
    """Null and repeated ids and columns of any name go through every stage but the last, which returns its own."""
    docs = clashing(spark).withColumn("_hash", F.lit("clash")).withColumn("_spans", F.lit(1)).withColumn("component_id", F.lit(2))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") < 4, 3).otherwise(F.col("doc_id")))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        got = made.collect()
        if k < 4:
            assert made.columns == docs.columns and len(got) <= len(TEXTS)
            assert all(r["_hash"] == "clash" and r["_spans"] == 1 and r["component_id"] == 2 and r["n_words"] == "clash" for r in got)
        if k == 3:
            assert len(got) == len(TEXTS)


def test_planted(spark, sf):
    import random

    rng, words = random.Random(8), vocabulary(8, 3000)
    base, shared = sentence(rng, words, 300), sentence(rng, words, 70)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    texts = [sentence(rng, words, 150) for _ in range(10)] + [base, base, edited(rng, words, base, 3)] + [f"{sentence(rng, words, 80)} {shared} {sentence(rng, words, 80)}" for _ in range(3)] + [f"{sentence(rng, words, 90)} {item} {sentence(rng, words, 30)}"]
    docs = table(spark, texts)
    near = {r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, docs, sf).collect()}
    assert near == set(range(17)) - {11, 12}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, docs, sf).collect()}
    assert shared in cut[13] and shared not in cut[14] and shared not in cut[15] and all(cut[i] == texts[i] for i in range(10))
    clean = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert clean == set(range(16))
