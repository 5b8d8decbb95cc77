"""The pipeline's stages, each against what it must keep and drop on its own input."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline


def prose(rng, words):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(words))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("tables"))
    question = prose(rng, 40)
    rows, labels = [], []
    for i in range(200):
        bad = i % 6 == 0
        text = f"a common line\n{prose(rng, 120)}"
        if bad:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        rows.append((i, text, "en", "s"))
        labels.append((i, int(not bad), 0))
    rows += [(500 + k, rows[k][1], "en", "s") for k in (1, 2, 3)]
    rows += [(800, prose(rng, 20_000), "en", "s")]  # a very long text
    rows += [(600, f"{question} {prose(rng, 30)}", "en", "s"), (700, None, None, None), (None, prose(rng, 50), "en", "s")]
    names = "score row __row lines dropped __lines __dropped __score gone whole_row"  # as the stages name columns of their own
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["kept"] * 10) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names.split()))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_clean_documents_and_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = {i for i in range(200) if i % 6} | {600, 800}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.common.materialize(stage(spark, docs, tables), f"test-{name}")
        assert docs.columns == before.columns
        assert {v for r in docs.select(*docs.columns[5:]).collect() for v in r} <= {"kept"}
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality":
            assert len(clean - ids) <= 2 and len(ids & {i for i in range(0, 200, 6)}) <= 2
            clean &= ids
        elif name == "lines":
            assert not any("a common line" in (r.text or "") for r in docs.collect()) and ids >= clean
        elif name == "copies":
            assert not ids & {501, 502, 503} and ids >= clean
        else:
            assert 600 not in ids and ids >= clean - {600}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, tables).count() == packed.count()


def test_rows_without_id_and_of_one_id_are_judged_by_their_own_text(spark, tables):
    rng = random.Random(2)
    question = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    a, b, c, clean, other = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, a), (1, b), (1, b), (None, b), (2, clean), (2, b), (3, question), (3, other), (None, question), (4, c)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    once = corpus_pipeline.drop_copies(spark, docs, tables)
    assert once.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in once.collect()) == sorted([(0, a), (1, b), (2, clean), (3, question), (3, other), (4, c)])
    left = corpus_pipeline.decontaminated(spark, docs, tables)
    assert left.schema.names == docs.schema.names and sorted(r.n for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 10]


def test_an_empty_table_stays_empty_in_every_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, tables)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0
