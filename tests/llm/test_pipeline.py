"""The five stages: columns, what goes, awkward rows, and the whole run."""

from __future__ import annotations

import importlib.util
import os

import pytest

import corpus_pipeline
from veilframe.llm.queries import table

PATH = "/root/testdata/sf0.01"
ORDER = ["quality_classifier", "language_id", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Documents after each stage, as the run writes them."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs, found = table(spark, PATH, "documents"), [table(spark, PATH, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, PATH).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    return found


def test_order_and_columns(passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER
    for docs in passed[:-1]:
        assert docs.columns == passed[0].columns
    sizes = [d.count() for d in passed]
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0


def test_stages_do_what_they_say(spark, passed):
    labels = {r.doc_id: r.quality for r in table(spark, PATH, "labels").collect()}
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for d in passed]
    good = {i for i, q in labels.items() if q == 1} & kept[0]
    assert len(good & kept[1]) > 0.95 * len(good)
    assert len(kept[2]) >= 0.98 * len(kept[1])
    texts = [r.text for r in passed[3].select("text").collect()]
    assert len(set(texts)) == len(texts)
    assert {r.text for r in passed[2].select("text").collect()} >= set(texts)
    items = [r.text for r in table(spark, PATH, "benchmark").collect()]
    assert not any(b in r.text for r in passed[4].select("text").collect() for b in items)
    clean = {r.doc_id for r in passed[3].collect() if not any(b in r.text for b in items)}
    assert clean == kept[4] == kept[5]


def test_run_equals_the_stages(spark, passed):
    assert sorted(map(tuple, corpus_pipeline.run(spark, PATH).collect())) == sorted(map(tuple, passed[5].collect()))


def test_awkward_rows(spark, awkward, no_docs):
    for docs in (awkward, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, PATH)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_queries_are_registered():
    path = os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_of_the_driver", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries().keys()
    assert "pipeline" in names
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{n}" for n in range(1, 14))
    assert entry.oracle_sql().keys() <= names
