"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, differences
from pulseline.llm import codec, queries
from tests.llm import test_mixing, test_near_dup, test_quality, test_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    mine = queries.registered()[name](spark, FOLDER).toPandas()
    assert differences(mine, connect(FOLDER).execute(queries.oracle_sql()[name]).df()) is None


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.registered()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    def after(name, df):
        stages[name](spark, df, FOLDER).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    good = after("quality", docs)
    wanted = {r[0] for r in test_quality.brute(rows, labels) if r[-1]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == wanted and 0.6 * len(rows) < len(wanted) < len(rows)

    single = after("near_duplicates", good)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {(r.doc_id, r.text) for r in single.collect()} == {(i, t) for i, t in rows if i in {b[0] for b in test_near_dup.brute(rows, 5, 80) if b[3]}}

    cut = after("repeats", single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    wanted = {i: kept for i, n, gone, kept in test_repeats.brute(rows, 50) if gone < n or gone == 0}
    assert {r.doc_id: " ".join(test_repeats.WORD.findall(r.text or "")) for r in cut.collect()} == wanted

    mixed = after("mixing", cut)
    before, sizes, taken = {r.doc_id: r for r in cut.collect()}, Counter(), Counter()
    for r in before.values():
        sizes[r.source] += test_mixing.size(r.text)
    for r in mixed.collect():
        taken[r.source] += test_mixing.size(r.text)
        assert r.text in before[r.doc_id].text or " ".join(test_repeats.WORD.findall(before[r.doc_id].text)).startswith(r.text)
    for source, target in test_mixing.brute_targets(sizes).items():
        assert math.isclose(taken[source], target, abs_tol=0.5)

    last = after("sequences", mixed)
    assert last.columns == [*columns, "n_tokens", "round_trip", "ids"] and last.count() == mixed.count()
    assert all(r._text == r.text for r in codec.decoded(last, "ids").collect())


def test_stages_take_awkward_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "w " * 12, "en", "b", 24), (3, "w " * 12, "en", "b", 24),
                                  (3, "w " * 12, "en", "b", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("doc_id < 0")):
            got = stage(spark, df, FOLDER)
            got.collect()
            assert got.columns[:5] == docs.columns
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()) == [0, 1, 2, 3]


CLASHES = ["_words", "_hashes", "_n", "_kept", "_score", "_base_failed", "_kept_id", "_spans", "_n_words", "_n_removed", "_ids", "_exact", "_n_tokens",
           "rest", "row", "text_key", "group", "node", "long_id", "size", "key", "copy", "_"]


def test_stages_take_clashing_columns(spark):
    """Whatever extra columns are called, their values come through; the last stage replaces those it adds."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {name: docs for name, _ in corpus_pipeline.STAGES}
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES}
    for name, stage in corpus_pipeline.STAGES:
        plain, got = stage(spark, before[name], FOLDER), stage(spark, before[name].withColumns(extra), FOLDER)
        assert got.columns[:len(docs.columns) + len(CLASHES)] == [*docs.columns, *CLASHES]
        rows = got.collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect())
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)
    named = docs.limit(5).withColumns({"n_tokens": F.lit("own"), "ids": F.lit(1), "round_trip": F.lit("x")})
    last = corpus_pipeline.sequences(spark, named, FOLDER)
    assert last.columns == [*docs.columns, "n_tokens", "round_trip", "ids"] and all(r.n_tokens == len(r.ids) for r in last.collect() if r.text)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
