"""The pipeline on the smallest tables: each stage against what it must do."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids), name
        ids, docs = kept, out
    final = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert set(final.doc_id) == ids
    assert (final.start.to_numpy()[1:] == (final.start + final.n_tokens).to_numpy()[:-1]).all()


def test_near_duplicates_are_dropped_by_row(spark):
    text = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abcd"}
    rows = [(1, text["a"]), (1, text["a"]), (2, text["a"] + " more"), (None, text["a"]), (3, text["b"]), (3, text["c"]), (0, text["b"])]
    rows += [(None, text["d"]), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(1, text["a"]), (3, text["c"]), (0, text["b"]), (None, text["d"]), (4, None), (5, ""), (5, "")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, want))


def test_near_duplicates_in_files_are_not_written_again(spark, tmp_path, monkeypatch):
    text = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abc"}
    rows = [(1, text["a"]), (1, text["a"]), (2, text["a"] + " more"), (None, text["b"]), (3, text["c"]), (4, None), (5, ""), (5, "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, written, staged = spark.read.parquet(str(tmp_path / "docs")), [], corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", lambda df, *rest: written.append(df.columns) or staged(df, *rest))
    want = sorted(map(str, [(1, text["a"]), (None, text["b"]), (3, text["c"]), (4, None), (5, ""), (5, "")]))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want
    assert not any("row" in columns for columns in written)
    # Two rows at one place of a file are two rows.
    twice = docs.where("text <> ''").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.drop_near_duplicates(spark, twice, SF).collect()) == [w for w in want if "0" in w]
