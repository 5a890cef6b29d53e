"""Continuous intake: uploads arrive as files, each once processed."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import config
from ..sources.documents import IDENTITY, parse_plain_text, reject_reason, scratch_dir
from .state import DECISIONS, MOVES, KnownUploads, StatusMoves, rocksdb

SCHEMA = (
    "document_id string, owner_id string, document_type string, original_filename string, mime_type string, file_size long, content binary, "
    "file_hash string, status string, created_at timestamp"
)


def current_documents(stored: DataFrame) -> DataFrame:
    """The newest row of each document: a document that failed once may have been read again."""
    order = Window.partitionBy("document_id").orderBy(F.desc("batch"))
    return stored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def stream_documents(
    spark: SparkSession, path: str, target: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, files_a_batch: int = 1000
) -> StreamingQuery:
    """Append valid uploads below ``path`` that still need processing to the table at ``target``, by batch.

    Uploads are checked and parsed for their status; whether one is known, keyed
    state says (an identity's stored id and status), so nothing that was stored is
    read again, however large the target. Only narrow rows pass the state; the contents
    of what is to be stored are then read from the batch's own files. An
    upload that was stored but failed is processed again, under the stored id.
    Uploads that break a rule go to ``target``-rejected with the reason.
    ``path`` holds Parquet files of SCHEMA; see ``current_documents`` for reading.
    """
    uploads = reject_reason(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path))
    parsed, _ = parse_plain_text(uploads)
    narrow = parsed.select(*IDENTITY, "document_id", "status", "reject_reason", F.col("_metadata.file_path").alias("file"))
    decided = narrow.groupBy(*IDENTITY).transformWithStateInPandas(KnownUploads(), DECISIONS, "Append", "None")

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        told = scratch_dir(session)
        batch.write.parquet(told)
        told = session.read.schema(batch.schema).parquet(told)
        files = [unquote(r["file"]) for r in told.select("file").distinct().collect()]  # ``files_a_batch`` at most
        schema = session.createDataFrame([], SCHEMA).schema
        rows = session.read.schema(schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("file")) if files else session.createDataFrame([], schema).withColumn("file", F.lit(""))
        rows, told = reject_reason(rows), told.withColumnsRenamed({"document_id": "_id", "file": "_file", "reject_reason": "_reason"})
        met = rows.join(told, (rows["document_id"] == told["_id"]) & (rows["file"] == told["_file"]) & rows["reject_reason"].eqNullSafe(told["_reason"]))
        met = met.select(*schema.names, "file", "stored_id", "reject_reason", F.lit(number).cast("long").alias("batch"))
        put = lambda df, place: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(place)
        put(met.filter("reject_reason is not null").drop("file", "stored_id"), f"{target}-rejected")
        accepted = met.filter("reject_reason is null")
        once = Window.partitionBy("stored_id").orderBy("document_id", "file")
        chosen = accepted.withColumn("_r", F.row_number().over(once)).filter("_r = 1").withColumn("document_id", F.col("stored_id"))
        stored, _ = parse_plain_text(chosen.select(*schema.names, "batch"))
        put(stored, target)
        if then is not None:
            try:
                written = session.read.schema(StructType([x for x in stored.schema if x.name != "batch"])).parquet(f"{target}/batch={number}")
            except AnalysisException:  # the batch stored nothing
                written = session.createDataFrame([], StructType([x for x in stored.schema if x.name != "batch"]))
            then(written.withColumn("batch", F.lit(number).cast("long")), number)

    with rocksdb(spark):
        return decided.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(uploads: DataFrame, time: str = "created_at", within: str = "1 hour") -> DataFrame:
    """First copy of an upload within a time bound; the state is bounded by the watermark."""
    return uploads.withWatermark(time, within).dropDuplicatesWithinWatermark(list(IDENTITY))


def is_legal_move(before: Column, status: Column) -> Column:
    """The first status of a document is legal, and so is no change."""
    legal = F.lit(False)
    for was, next_ones in config.STATUS_MOVES.items():
        legal = legal | ((before == was) & status.isin(*next_ones))
    return F.coalesce(before.isNull() | (before == status) | legal, F.lit(False))


def check_status_transitions(events: DataFrame, key: str = "document_id", time: str = "ts", tie: str | None = None) -> DataFrame:
    """Events with previous_status and is_legal."""
    order = Window.partitionBy(key).orderBy(time, *([tie] if tie else []), "status")
    told = events.withColumn("previous_status", F.lag("status").over(order))
    return told.withColumn("is_legal", is_legal_move(F.col("previous_status"), F.col("status")))


def stream_status_transitions(events: DataFrame, key: str = "document_id", time: str = "ts", tie: str = "event_id", within: str = "1 hour") -> DataFrame:
    """``check_status_transitions`` of a stream: ``key``, ``tie`` (a long), ``time``, status, previous_status, is_legal.

    An event is judged once the watermark (``within`` behind the newest event) has passed it, in its
    place in time; events that come later than that are dropped. Start the stream inside ``state.rocksdb``.
    """
    at = F.col(time).cast("timestamp")
    narrow = events.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), at.alias("at"), F.unix_micros(at).alias("us"), "status").withWatermark("at", within)
    moves = narrow.groupBy("key").transformWithStateInPandas(StatusMoves(), MOVES, "Append", "EventTime")
    told = moves.withColumn("is_legal", is_legal_move(F.col("previous_status"), F.col("status")))
    return told.select(F.col("key").cast(events.schema[key].dataType).alias(key), F.col("tie").alias(tie), F.timestamp_micros("us").cast(events.schema[time].dataType).alias(time), "status", "previous_status", "is_legal")
