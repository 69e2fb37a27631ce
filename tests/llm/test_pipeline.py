import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.test_minhash import brute

import corpus_pipeline
from labspark.llm.decontamination import LEAST_WORDS, edit_distance_within
from labspark.llm.line_templates import ORACLE
from labspark.llm.quality import quality_scores
from labspark.llm.words import plain_words_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")
def test_equals_plain_python(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scores = quality_scores(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scores if r.predicted == 0}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    rows = [(i, text) for i, _, dropped, text in con.execute(ORACLE).fetchall() if not dropped or text.strip()]
    near = brute(rows, 80, 5)
    rows = [(i, text) for i, text in rows if near[i][1] == i]
    items = [w for (t,) in con.execute(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall() if len(w := plain_words_of(t)) >= LEAST_WORDS]
    rows = [(i, t) for i, t in rows if not any(edit_distance_within(w, plain_words_of(t))[0] <= len(w) // 5 for w in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == {i for i, _ in rows} and 0 < len(rows) < docs.count()
    for i, text in rows:
        assert list(got[i].ids) == library.encode(text) and got[i].exact


def test_stages_take_nulls_and_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs([(1, None), (2, ""), (None, "text without id"), (None, None), (4, "a b c"), (4, "a b c"), (5, "x One, two three four five six y")])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        assert stage(spark, table.where("false"), str(tmp_path)).count() == 0
        rows = out.collect()
        if name != "encoding":
            assert out.columns == table.columns
            assert sum(r.doc_id is None for r in rows) == (2 if name != "quality_filter" else sum(r.doc_id is None for r in rows))
        if name == "decontamination":
            assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 4, 4]
