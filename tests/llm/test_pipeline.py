import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import _common, decontam, packing, quality, secrets, simhash
from fathom.llm._common import table


def test_pipeline_runs_each_stage_on_what_the_last_kept(spark, sf_dir, monkeypatch):
    given = {}

    def spied(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = docs
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, spied(n, f)) for n, f in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect()
    documents = table(spark, sf_dir, "documents")
    assert list(given) == ["quality", "near_dedup", "decontamination", "secrets", "packing"] and all(d.columns == documents.columns for d in given.values())
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in given.items()}
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    net = quality.train(*quality.training_rows(documents, labels))
    assert ids["near_dedup"] == sorted(r.doc_id for r in quality.scored(documents, net).where("score >= 0.7").collect()) and len(ids["near_dedup"]) < documents.count()
    groups = simhash.near_duplicates(given["near_dedup"]).select("component_id").distinct().collect()
    assert ids["decontamination"] == sorted(r.component_id for r in groups)
    bad = {r.doc_id for r in decontam.contaminated(given["decontamination"], items).collect()}
    assert bad and ids["secrets"] == [i for i in ids["decontamination"] if i not in bad]
    assert ids["packing"] == ids["secrets"]
    assert secrets.scanned(given["packing"], keep=["doc_id"]).where("exists(secrets, s -> s.ord > 0)").count() == 0
    encode = packing.public()
    for r in given["packing"].collect():
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces if p.doc_id == r.doc_id])
        assert got.tolist() == [*encode(r.text).tolist(), 0]


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "one", "en", "s", 3), (5, "é " * 9_000, "fr", "s", None), (6, "x" * 50_000, "en", "s", None),
    (7, "a b c d e f g", "en", "s", 13), (7, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", None, "s", 13), (9, "password=hunter2222", "en", "s", 19),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    extra = ["row", "file", "at", "page", "hash", "score", "secrets", "_text", "_metadata"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in extra})
    spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            assert len({r.doc_id for r in got}) == len({r[0] for r in rows})
            continue
        assert out.columns == docs.columns and all(r.row == "clash" for r in got)
        ids = [r.doc_id for r in got]
        if name == "near_dedup":
            assert sorted(ids) == ([1, 4, 5, 6, 7, 9] if rows else [])
        if name == "decontamination":
            assert sorted(ids) == ([1, 2, 3, 4, 5, 6, 9] if rows else [])
        if name == "secrets":
            assert len(got) == len(rows) and all("hunter" not in (r.text or "") for r in got)


def test_pipeline_leaves_only_its_stages_results(spark, sf_dir):
    before = list(_common._SCRATCH)
    corpus_pipeline.run(spark, sf_dir)
    left = [p.split("/")[-1].rsplit("-", 1)[0] for p in _common._SCRATCH if p not in before]
    assert left == ["stage-quality", "stage-near_dedup", "stage-decontamination", "stage-secrets"]


def test_pipeline_query_is_registered():
    from fathom.llm.queries import queries

    assert [k.split("_")[0] for k in queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
