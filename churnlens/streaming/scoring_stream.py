"""Scoring requests as a stream: the batch ``score`` applied to each micro-batch.

Each micro-batch is split into scored and rejected rows, written to a folder of its own and then
published in a log (``manifest/``, one small file per batch).  Readers take what the log names, one
entry per batch, so a batch that died before it was published is not seen, and one that was
replayed is seen once.  :func:`compact` merges the files of many small batches into one folder and
publishes an entry that covers them.

Scoring is stateless.  Requests that may be delivered twice can be told apart by an id: with
``dedupe_within`` the ids of that span of event time are kept as state, and repeats are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..operators.scoring import REJECT_COLUMN, score, tag_requests
from ..schema import CORRUPT, REQUEST_SCHEMA
from ..session import delete_path
from ..sources.snapshots import publish, read_log

SCORED_COLUMNS = ["customerID", "tenure", "voice_usage", "data_usage", "complaints", "contract_type",
                  "monthly_charges", "internet_service", "online_security", "tech_support",
                  "streaming_tv", "raw_score", "score", "probability", "risk_level", "factors",
                  "factor_map", "recommendations"]


# Files of a micro-batch at most: bounds the first run over a backlog.
FILES_PER_BATCH = 256
STATUS = "status"
# Further columns of requests that may be repeated.
REQUEST_ID, REQUESTED_AT = "request_id", "requested_at"
_LOG = "first_batch long, last_batch long, data string, published timestamp"


def _scored_rows(batch: DataFrame) -> DataFrame:
    if CORRUPT not in batch.columns:
        batch = batch.withColumn(CORRUPT, F.lit(None).cast("string"))
    tagged = tag_requests(batch)
    rejected = F.col(REJECT_COLUMN).isNotNull()
    return score(tagged).select(
        *SCORED_COLUMNS, F.col(REJECT_COLUMN).alias("reason"), F.col(CORRUPT).alias("raw"),
        F.when(rejected, "rejected").otherwise("scored").alias(STATUS)).withColumn(
        "customerID", F.when(F.col("raw").isNull(), F.col("customerID")))


def _put(rows: DataFrame, sink_dir: str, first: int, last: int) -> None:
    """Write ``rows`` to a new folder, then publish it as the content of these batches."""
    data = f"{sink_dir}/data/{uuid.uuid4().hex}"
    rows.write.parquet(data)
    entry = rows.sparkSession.range(1).select(
        F.lit(first).cast("long").alias("first_batch"), F.lit(last).cast("long").alias("last_batch"),
        F.lit(data).alias("data"), F.current_timestamp().alias("published"))
    publish(entry, f"{sink_dir}/manifest")


def _write_batch(sink_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # one pass a batch: scored and rejected rows side by side, told apart by status
        _put(_scored_rows(batch), sink_dir, batch_id, batch_id)
    return write


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         available_now: bool = True, processing_time: str | None = None,
                         source_format: str = "parquet", max_files_per_trigger: int = FILES_PER_BATCH,
                         dedupe_within: str | None = None) -> StreamingQuery:
    """Score request files arriving in ``source_dir`` (``source_format`` parquet or json,
    schema ``REQUEST_SCHEMA``).  ``max_files_per_trigger`` bounds each micro-batch.  JSON lines that
    cannot be read are rejected with their text.

    With ``dedupe_within`` (an interval such as ``"2 days"``) requests also carry ``request_id`` and
    ``requested_at``; of requests with one id that arrive while event time moves on by no more than
    the interval the first is scored.  Requests without an id are all scored; those older than the
    interval are late and dropped, as the ids that would tell are gone."""
    schema = REQUEST_SCHEMA
    if dedupe_within:
        schema = StructType([*schema.fields, StructField(REQUEST_ID, StringType()), StructField(REQUESTED_AT, TimestampType())])
    if source_format == "json":
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    requests = (spark.readStream.schema(schema).format(source_format)
                .option("maxFilesPerTrigger", str(max_files_per_trigger))
                .option("columnNameOfCorruptRecord", CORRUPT)).load(source_dir)
    if dedupe_within:
        key = F.coalesce(F.col(REQUEST_ID), F.concat(F.lit("none-"), F.expr("uuid()")))
        requests = (requests.withColumn(REQUEST_ID, key).withWatermark(REQUESTED_AT, dedupe_within)
                    .dropDuplicatesWithinWatermark([REQUEST_ID]))
    writer = (requests.writeStream.foreachBatch(_write_batch(sink_dir))
              .option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def live_entries(spark: SparkSession, sink_dir: str) -> list:
    """The published folders that make up the sink, in order of batches: of entries that cover the
    same batches the newest, and none that a wider entry covers.  There is an entry for each batch
    since the last compaction, whatever the rows."""
    found = read_log(spark, f"{sink_dir}/manifest", _LOG).groupBy("first_batch", "last_batch").agg(
        F.max(F.struct("published", "data")).alias("e")).select("first_batch", "last_batch", "e.data").collect()
    live, upto = [], -1
    for entry in sorted(found, key=lambda e: (e.first_batch, -e.last_batch)):
        if entry.last_batch > upto:
            live.append(entry)
            upto = entry.last_batch
    return live


def compact(spark: SparkSession, sink_dir: str, files: int = 1) -> int:
    """Merge all published batches into one folder of ``files`` files; how many entries it
    replaces.  Run between batches or beside the stream; readers see the batches or their merger."""
    live = live_entries(spark, sink_dir)
    if len(live) > 1:
        _put(_read(spark, live).repartition(files), sink_dir, live[0].first_batch, live[-1].last_batch)
    return len(live)


def clean_up(spark: SparkSession, sink_dir: str) -> int:
    """Delete the folders that compaction or a replay has replaced, once no reader uses them."""
    live = {e.data for e in live_entries(spark, sink_dir)}
    gone = [r.data for r in read_log(spark, f"{sink_dir}/manifest", _LOG).select("data").distinct().collect()
            if r.data not in live]
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def _read(spark: SparkSession, entries: list) -> DataFrame:
    # the schema is known, so that no batch, or batches without rows, give an empty table
    schema = _scored_rows(spark.createDataFrame([], REQUEST_SCHEMA)).schema
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[e.data for e in entries])


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The scored requests of all published batches."""
    return _read(spark, live_entries(spark, sink_dir)).where(F.col(STATUS) == "scored").select(*SCORED_COLUMNS)


def read_rejected(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(customerID, reason, raw) of the rejected requests of all published batches; ``raw`` is the
    text of a request that could not be read, which has no id."""
    return _read(spark, live_entries(spark, sink_dir)).where(F.col(STATUS) == "rejected").select("customerID", "reason", "raw")
