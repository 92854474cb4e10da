"""The pipeline's stages against plain versions, each on its own input, and its whole run."""

from __future__ import annotations

from brute import base_spans, text_stats
from test_near_text import least_of_groups

import corpus_pipeline
from sheetloom.llm import catalog, pii

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def without_spans(text, spans):
    """The text with its spans (kind:start:end, comma-joined) replaced by their kinds, overlapping ones together."""
    found = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, after = rows_of(docs), stage(spark, docs, DATA)
        after.write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        got = rows_of(after)
        if name == "quality_rules":
            assert set(got) == {i for i, r in before.items() if not text_stats(r["text"])[5]}
        elif name == "near_duplicates":
            assert set(got) == least_of_groups((i, r["text"]) for i, r in before.items())
        elif name == "benchmark_decontamination":
            assert set(got) == {i for i, r in before.items() if not any(x in r["text"] for x in items)}
        elif name == "personal_data":
            assert set(got) == set(before)
            assert not any(base_spans(r["text"]) for r in got.values())
            told = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
            assert all(got[i]["text"] == without_spans(r["text"], told[i]) and got[i]["n_chars"] == len(got[i]["text"]) for i, r in before.items())
            assert all({**got[i], "text": 0, "n_chars": 0} == {**r, "text": 0, "n_chars": 0} for i, r in before.items())
        else:
            assert set(got) == set(before)
        docs = after
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_catalog():
    names = set(catalog.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(catalog.oracle_sql()) <= names


def test_stages_on_edge_cases(spark, edge_documents, no_documents, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, and an empty table go through every stage."""
    for kind, docs in (("edge", edge_documents), ("none", no_documents)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, DATA)
            after.write.parquet(path := str(tmp_path / kind / name))
            after = spark.read.parquet(path)
            if name != "best_fit_packing":
                assert after.columns == docs.columns and after.dtypes == docs.dtypes
                assert after.count() <= docs.count()
                docs = after
            else:
                assert sorted({str(r.doc_id) for r in after.collect()}) == sorted({str(r.doc_id) for r in docs.collect()})
        assert docs.count() == 0 if kind == "none" else docs.count() > 0


def test_each_stage_alone_on_edge_cases(spark, edge_documents):
    rows = edge_documents.count()
    counts = {name: stage(spark, edge_documents, DATA).count() for name, stage in corpus_pipeline.STAGES}
    assert counts["benchmark_decontamination"] == counts["personal_data"] == rows
    assert 0 < counts["quality_rules"] < rows and 0 < counts["near_duplicates"] < rows and counts["best_fit_packing"] >= rows
