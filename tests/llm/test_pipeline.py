"""The pipeline where little or nothing is there."""

from __future__ import annotations

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None), (2, "", "aa", "s", 0, "h"), (None, "12 34 !", "aa", None, 7, None)]])
def test_no_document_stays(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
