"""The pipeline's stages on the smallest tables: order, effects, and rows that must stay."""

import corpus_pipeline
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], FOLDER).cache())
    return tables


def test_stages_keep_the_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "secrets", "packing"]
    assert all(sorted(t.columns) == sorted(kept[0].columns) for t in kept[1:-1])


def test_near_copies_leave_one_of_each_group(kept):
    from test_documents import linked

    texts = {r.doc_id: r.text for r in kept[1].collect()}
    _, root = linked(texts, 5, 80)
    assert {r.doc_id for r in kept[2].collect()} == set(root.values())


def test_passages_and_secrets(kept):
    from test_documents import base_spans, cut

    expected = cut({r.doc_id: r.text for r in kept[2].collect()}, 50)
    for row in kept[3].collect():
        assert " ".join((row.text or "").split()) == expected[row.doc_id][2]
    assert kept[4].count() == kept[3].count()
    assert not any(base_spans(r.text or "") for r in kept[4].collect())


def test_all_tokens_are_packed(kept):
    ids = {r.doc_id for r in kept[4].collect()}
    pieces = kept[5].collect()
    assert {p.doc_id for p in pieces} == ids
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in ids)


def test_run_gives_the_same_rows(spark, kept):
    made = corpus_pipeline.run(spark, FOLDER)
    own = ["doc_id", "start", "length"]
    assert sum(r.length for r in made.collect()) == sum(r.length for r in kept[5].collect()) and set(own) < set(made.columns)
