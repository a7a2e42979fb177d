"""Schemas of the log pipeline's tables."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_LINE = T.StructType([T.StructField("path", T.StringType()), T.StructField("generation", T.IntegerType()), T.StructField("line_offset", T.LongType()), T.StructField("line", T.BinaryType())])
LOG_RECORD = T.StructType([T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("level", T.StringType()), T.StructField("message_key", T.StringType()), T.StructField("latency_ms", T.IntegerType()), T.StructField("is_malformed", T.BooleanType())])
FS_EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("old_path", T.StringType()), T.StructField("observed_at", T.TimestampType()), T.StructField("processable", T.BooleanType())])

#: Levels in ordinal order, file event kinds and read statuses (fixed values).
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "OTHER")
KINDS = ("Created", "Modified", "Deleted", "Renamed")
STATUSES = ("NoData", "ReadSome", "FileNotFound", "AccessDenied", "IoError", "TruncatedReset")
