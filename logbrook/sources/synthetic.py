"""Deterministic log lines and file events: from an events table, or from nothing but a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import is_processable

#: Made-up messages.
MESSAGES = ("Opened session", "Closed session", "Wrote segment", "Merged segments", "Slow disk", "Lost peer")
PLAIN_LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")


def path_of(user: Column) -> Column:
    extension = F.when(user % 4 == 1, ".TXT").when(user % 4 == 3, ".tmp").otherwise(".log")
    return F.concat(F.lit("/logs/"), (user % 8).cast("string"), extension)


def log_lines(events: DataFrame) -> DataFrame:
    """(event_id, ts, path, line): a log line for each event, some of them malformed or without latency."""
    stamp = F.when(F.col("event_id") % 37 == 0, "not-a-ts").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    level = F.when(F.col("event_type") == "click", "INFO").when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "WARN").otherwise("TRADE")
    message = F.when(F.col("event_id") % 53 == 0, "").otherwise(F.concat("event_type", F.lit("_"), (F.col("user_id") % 7).cast("string")))
    v = F.floor(F.col("value") * 40).cast("int").cast("string")
    suffix = F.when(F.col("event_id") % 11 == 0, " latency_ms=abc").when(F.col("event_id") % 13 == 0, "").when(F.col("event_id") % 17 == 0, F.concat(F.lit(" LATENCY_MS="), v, F.lit("ms"))).otherwise(F.concat(F.lit(" latency_ms="), v))
    return events.select("event_id", "ts", path_of(F.col("user_id")).alias("path"), F.concat(F.concat_ws(" ", stamp, level, message), suffix).alias("line"))


def fs_events(events: DataFrame) -> DataFrame:
    """A file event for each event, in order of event_id."""
    kind = F.when(F.col("event_type") == "click", "Created").when(F.col("event_type").isin("view", "signup"), "Modified").when(F.col("event_type") == "error", "Deleted").otherwise("Renamed")
    renamed = F.col("event_type") == "purchase"
    path = F.when(renamed, path_of(F.col("user_id") + 1)).otherwise(path_of(F.col("user_id")))
    rows = events.select(F.col("event_id").alias("seq"), kind.alias("kind"), path.alias("path"), F.when(renamed, path_of(F.col("user_id"))).alias("old_path"), F.col("ts").alias("observed_at"))
    return rows.withColumn("processable", is_processable("path"))


def length_observations(events: DataFrame) -> DataFrame:
    """(path, seq, length) of files that grow, shrink and become empty."""
    return events.select(path_of(F.col("user_id")).alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 29 == 0, 0).otherwise(F.floor(F.col("value") * 40)).cast("long").alias("length"))


def contents(events: DataFrame) -> DataFrame:
    """(event_id, content) of file contents with both line ends, single \\r, empty lines and mostly an unended last line."""
    end = F.when(F.col("event_id") % 3 == 0, "\r\n").otherwise("\n")
    empty = F.when(F.col("event_id") % 5 == 0, "\n\r\n").otherwise("")
    inner = F.when(F.col("event_id") % 7 == 0, "a\rb\r\r\n").otherwise("")
    last = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("rest "), F.col("event_id").cast("string")))
    return events.select("event_id", F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), end, empty, inner, last).alias("content"))


def read_statuses(events: DataFrame) -> DataFrame:
    """(path, status): how a read of each event's file went."""
    r = F.col("event_id") % 11
    status = F.when(r == 0, "FileNotFound").when(r == 1, "AccessDenied").when(r == 2, "IoError").when(r == 3, "TruncatedReset").when(r == 4, "NoData").otherwise("ReadSome")
    return events.select(path_of(F.col("user_id")).alias("path"), status.alias("status"))


def generate(spark: SparkSession, lines: int, files: int = 100, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(path, line) of made-up logs: time, level, message and a latency of 1 to 9999, spread over numbered files."""
    rows = spark.range(0, lines, 1, partitions) if partitions else spark.range(lines)
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    choose = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    stamp = F.date_format(F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat_ws(" ", stamp, choose(PLAIN_LEVELS, pick("level", 4)), choose(MESSAGES, pick("message", len(MESSAGES))), F.concat(F.lit("latency_ms="), (pick("latency", 9999) + 1).cast("string")))
    file = pick("file", files) + 1
    return rows.select(F.concat(file.cast("string"), F.when(file % 2 == 0, ".log").otherwise(".txt")).alias("path"), line.alias("line"))
