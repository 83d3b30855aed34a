"""Batches cut by bytes, folders that are released, and what a worker keeps."""

from __future__ import annotations

import pyarrow as pa
import pytest

from churnlens.llm import bpe_replay, frames


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(frames, "SLICE", 100)
    texts = ["a" * 40, None, "b" * 70, "c" * 500, "", "d" * 10, "é" * 45]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(7)), "ids": pa.array([[1], None, [], [2], [3], [4], [5]])})
    parts = list(frames.slices(batch))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 1, 2, 1]
    assert list(frames.slices(batch.slice(0, 0))) == []


def test_rows_keep_their_columns(spark, docs_of, monkeypatch):
    docs = docs_of([(k, None if k == 3 else f"text {k}") for k in range(30)])
    kept = frames.rows_where(docs, "text", lambda texts: [t is not None and t[-1] in "02468" for t in texts])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 2))


def test_folders_are_released(spark):
    first, second = frames.stored(spark.range(5)), frames.stored(spark.range(7))
    assert frames.release(spark, kept=second) >= 1
    assert second.count() == 7
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|FileNotFound"):
        first.count()
    assert frames.release(spark) == 1 and frames.release(spark) == 0


def test_a_worker_drops_what_other_operators_kept():
    bpe_replay._CODERS["x"] = "coder"
    frames._only("churnlens.llm.bpe_replay")
    assert "x" in bpe_replay._CODERS
    frames._only("churnlens.llm.token_counts")
    assert not bpe_replay._CODERS
    frames._returned()


def test_a_free_name(docs_of):
    docs = docs_of([(1, "a")]).selectExpr("*", "1 AS Copy", "2 AS copy_")
    assert frames.fresh("copy", docs) == "copy__" and frames.fresh("other", docs) == "other"
