"""The scoring stream's sink: no input, replays, repeats, compaction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from churnlens.operators import scoring
from churnlens.session import scratch_path
from churnlens.streaming import scoring_stream as stream
from helpers import make_requests


def _run(spark, root, **kw):
    stream.start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck", **kw).awaitTermination()
    return sorted(r.customerID for r in stream.read_scored(spark, f"{root}/out").collect())


def test_no_input(spark):
    root = scratch_path(spark, "t-stream")
    assert stream.read_scored(spark, f"{root}/out").collect() == []  # before any batch
    make_requests(spark, []).write.parquet(f"{root}/in")
    assert _run(spark, root) == []
    found = stream.read_scored(spark, f"{root}/out")
    assert found.columns == stream.SCORED_COLUMNS and stream.read_rejected(spark, f"{root}/out").count() == 0
    make_requests(spark, [{}, {"tenure": None}]).write.mode("append").parquet(f"{root}/in")
    assert _run(spark, root) == ["R0000"]
    assert [r.reason for r in stream.read_rejected(spark, f"{root}/out").collect()] == ["tenure: missing"]


def test_a_replayed_batch_counts_once(spark):
    root = scratch_path(spark, "t-stream")
    batch = make_requests(spark, [{}, {}])
    write = stream._write_batch(f"{root}/out")
    write(batch, 0)
    write(batch.limit(1), 1)
    write(batch, 0)  # as after a failure between the sink and the checkpoint
    assert stream.read_scored(spark, f"{root}/out").count() == 3
    # written and not published: the writer died
    stream._scored_rows(batch).write.parquet(f"{root}/out/data/half")
    assert stream.read_scored(spark, f"{root}/out").count() == 3
    assert stream.clean_up(spark, f"{root}/out") == 1


def test_compaction(spark):
    root = scratch_path(spark, "t-stream")
    for k in range(6):
        make_requests(spark, [{"customerID": f"C{k}"}, {"customerID": f"D{k}", "complaints": -1}]).coalesce(1).write.mode(
            "append").parquet(f"{root}/in")
    before = _run(spark, root, max_files_per_trigger=2)
    assert before == [f"C{k}" for k in range(6)] and len(stream.live_entries(spark, f"{root}/out")) == 3
    assert stream.compact(spark, f"{root}/out") == 3 and stream.clean_up(spark, f"{root}/out") == 3
    assert len(stream.live_entries(spark, f"{root}/out")) == 1
    assert _run(spark, root, max_files_per_trigger=2) == before
    assert stream.read_rejected(spark, f"{root}/out").count() == 6
    make_requests(spark, [{"customerID": "Z"}]).write.mode("append").parquet(f"{root}/in")
    assert _run(spark, root) == [*before, "Z"]


def test_repeated_requests_are_dropped(spark):
    root = scratch_path(spark, "t-stream")

    def send(ids, day):
        rows = make_requests(spark, [{"customerID": f"{i}-{k}"} for k, i in enumerate(ids)])
        rows.withColumn(stream.REQUEST_ID, F.nullif(F.split("customerID", "-")[0], F.lit("None"))).withColumn(
            stream.REQUESTED_AT, F.lit(dt.datetime(2024, 1, day))).coalesce(1).write.mode("append").parquet(f"{root}/in")

    send(["a", "a", "b", None, None], 1)
    first = _run(spark, root, dedupe_within="2 days")
    assert [x[0] for x in first] == ["N", "N", "a", "b"]  # requests without an id are all scored
    send(["a", "c", "b"], 2)
    assert [x[0] for x in _run(spark, root, dedupe_within="2 days")] == ["N", "N", "a", "b", "c"]


def test_unreadable_lines_are_rejected_with_their_text(spark):
    root = scratch_path(spark, "t-stream")
    lines = [r.j for r in make_requests(spark, [{}]).select(F.to_json(F.struct("*")).alias("j")).collect()] + ['{"customerID":']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{root}/in")
    assert _run(spark, root, source_format="json") == ["R0000"]
    assert [tuple(r) for r in stream.read_rejected(spark, f"{root}/out").collect()] == [(None, scoring.UNREADABLE, lines[1])]
