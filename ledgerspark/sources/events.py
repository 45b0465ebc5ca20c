"""Posted event batches, JSON documents ``{"events": [...]}``, one per file.

Each event is parsed with every field as STRING; a nested ``metadata`` object comes back as
its raw JSON text with key order intact (the sanitizer relies on that order). A document whose
``events`` is not a list is rejected into a separate frame; with analytics disabled a batch is
accepted and dropped (the caller simply does not write it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_FIELDS = ["eventId", "event_id", "userId", "user_id", "sessionId", "session_id", "eventType", "event_type",
              "page", "component", "metadata", "ts", "timestamp"]
RAW_EVENT = "struct<" + ", ".join(f"`{f}`: string" for f in RAW_FIELDS) + ">"


def read_event_batches(spark: SparkSession, path, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """-> (raw events with RAW_FIELDS + file + seq, rejected documents). One document a file, or with
    ``lines`` one a line, in files that are split over tasks."""
    docs = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    return events_of(docs)


def events_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    events_json = F.get_json_object("value", "$.events")
    as_list = F.from_json(events_json, "array<string>")
    ok = events_json.isNotNull() & F.trim(events_json).startswith("[") & as_list.isNotNull()
    good = docs.filter(ok).select("file", F.posexplode(as_list).alias("seq", "event"))
    parsed = good.select("file", F.col("seq").cast("bigint").alias("seq"), F.from_json("event", RAW_EVENT).alias("e"))
    rejected = docs.filter(~ok | ok.isNull()).select("file", F.lit("events must be a list").alias("reason"))
    return parsed.select("file", "seq", "e.*"), rejected
