"""The corpus pipeline stage by stage against brute force, and on hard rows."""

from __future__ import annotations

import collections

import corpus_pipeline
from bytelake.llm import mixing, quality
from tests.llm.test_operators import SCHEMA, brute_components, fold, hard_rows, word_list

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact", "near", "mix", "pack"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        rows[name] = docs.collect()
        if name != "pack":
            assert docs.dtypes == before.dtypes
    scores = quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(r.doc_id for r in rows["quality"]) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())
    first = {}
    for r in rows["quality"]:
        first[fold(r.text)] = min(r.doc_id, first.get(fold(r.text), r.doc_id))
    assert sorted(r.doc_id for r in rows["exact"]) == sorted(first.values())
    near = brute_components([(r.doc_id, r.text) for r in rows["exact"]])
    assert sorted(r.doc_id for r in rows["near"]) == sorted(i for i, _, c in near if i == c)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(rows["near"], before_schema(spark))).collect()}
    got = collections.Counter()
    for r in rows["mix"]:
        got[r.doc_id] += len(word_list(r.text))
        assert r.n_chars == len(r.text)
    assert dict(got) == {i: n for i, n in taken.items() if n}
    pieces = collections.Counter((r.doc_id, r.doc_tokens) for r in rows["pack"] for _ in range(r.length))
    assert {d for d, _ in pieces} == set(got) and all(n % size == 0 for (_, size), n in pieces.items())
    run = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()}
    assert run == set(pieces)


def before_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_hard_rows(spark, tmp_path):
    for rows in (hard_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{len(rows)}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "pack" or docs.columns == columns
            assert bool(docs.count()) == bool(rows)
