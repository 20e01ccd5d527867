"""The pipeline's stages one by one against brute force, on rows with nulls, repeats and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgersift.llm import langid
from tests.llm import brute
from tests.llm.test_operators import DOCS, VOCAB

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    plain = spark.read.parquet(f"{BASE}/documents.parquet").withColumns({"rate": F.lit("r"), "copies": F.lit(None).cast("int"), "fp": F.lit(1)})
    extra = spark.createDataFrame([(i + 10_000 if i is not None else None, t, l, s, n, "r", None, 1) for i, t, l, s, n in DOCS + DOCS[:1]], plain.schema)
    path = str(tmp_path_factory.mktemp("p") / "docs")
    plain.unionByName(extra).write.parquet(path)
    return spark.read.parquet(path)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _ids(rows):
    return sorted([r[0] for r in (rows if isinstance(rows, list) else rows.collect())], key=repr)


def test_stages_keep_the_columns_and_agree(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]

    known = stages["language_id"](spark, docs, BASE)
    assert known.columns == docs.columns
    kept, whole = _rows(known), _rows(docs)
    gone = [r for r in whole if r not in kept]
    assert all(any(map(str.isalpha, r[1] or "")) for r in kept) and len(gone) < 0.02 * len(whole)
    model = langid.train(docs)
    assert kept == _rows(langid.predict(docs, model).filter("not language.rejected").drop("language"))

    single = stages["near_duplicates"](spark, docs, BASE)
    assert single.columns == docs.columns
    assert _ids(single) == _ids(brute.one_of_each(whole)) and all(r in whole for r in _rows(single))

    clean = stages["decontamination"](spark, docs, BASE)
    assert clean.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").select("item_id", "text").collect()]
    hits = [n for _, _, n, _ in brute.decontaminate([r[:2] for r in whole], items)]
    assert _rows(clean) == [r for r, n in zip(whole, hits, strict=True) if not n]

    mixed = stages["mixing"](spark, docs, BASE)
    assert mixed.columns == docs.columns
    assert _rows(mixed) == sorted(brute.mix(whole), key=repr)

    shards = stages["sharding"](spark, docs, BASE).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == len(whole) and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_empty_documents(spark, docs):
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, BASE)
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert _rows(out) == _rows(again) and len(VOCAB) > 10


def test_run_equals_the_stages_by_brute_force(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    model = langid.train(docs)
    rows = [r for r in map(tuple, docs.collect()) if brute.language(model, r[1])[0] != "und" and brute.language(model, r[1])[1] >= model.reject_below]
    rows = brute.one_of_each(rows)
    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").select("item_id", "text").collect()]
    clean = brute.decontaminate([r[:2] for r in rows], items)
    rows = brute.mix([r for r, (_, _, n, _) in zip(rows, clean, strict=True) if not n])
    out = corpus_pipeline.run(spark, base).collect()
    assert _ids([(r.doc_id,) for r in out]) == _ids(rows)
    counts = [sum(r.shard == s for r in out) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_without_languages_all_documents_stay(spark, docs):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, none, BASE).count() == docs.count()
