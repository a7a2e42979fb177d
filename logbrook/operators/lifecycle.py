"""File lifecycle from file events: routing, finalised deletes, epochs, generations and tail ranges.

All are windows over the events of one path, in order. A path's events are handled each before the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import is_processable


def routed(events: DataFrame, processable: Column | None = None) -> DataFrame:
    """(seq, sub, op, path): what each event does. A rename deletes its old path, then writes its new one.

    Writes pass only for processable paths; deletes always pass.
    """
    passes = F.col("processable") if processable is None else processable
    write = lambda sub: F.struct(F.lit(sub).alias("sub"), F.lit("W").alias("op"), F.col("path").alias("path"), passes.alias("passes"))
    delete = lambda path: F.struct(F.lit(0).alias("sub"), F.lit("D").alias("op"), path.alias("path"), F.lit(True).alias("passes"))
    steps = F.when(F.col("kind").isin("Created", "Modified"), F.array(write(0))).when(F.col("kind") == "Deleted", F.array(delete(F.col("path")))).when(F.col("kind") == "Renamed", F.array(delete(F.col("old_path")), write(1)))
    return events.select("seq", F.explode(steps).alias("x")).where("x.passes AND x.path IS NOT NULL AND x.path <> ''").select("seq", "x.sub", "x.op", "x.path")


def generations(operations: DataFrame) -> DataFrame:
    """Each operation with finalized (a delete of a path that has state), the path's epoch after it and generation."""
    order = Window.partitionBy("path").orderBy("seq", "sub")
    marked = operations.withColumn("finalized", (F.col("op") == "D") & F.coalesce(F.lag("op").over(order) == "W", F.lit(False)))
    epoch = F.sum(F.col("finalized").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("epoch", epoch).withColumn("generation", F.col("epoch") + 1)


def epochs(operations: DataFrame) -> DataFrame:
    """Finalised deletes of each path, which is its current epoch."""
    return generations(operations).groupBy("path").agg(F.sum(F.col("finalized").cast("long")).alias("epoch"))


def tail_ranges(lengths: DataFrame, by: tuple[str, ...] = ("path",), keep_offset_at_zero: bool = False) -> DataFrame:
    """(offset_before, truncated, start, bytes) for length observations (by, seq, length).

    A shorter file is read from its start. keep_offset_at_zero leaves the old offset in place
    where a file was cut to no bytes, which counts a truncation again at each later observation below it.
    """
    order = Window.partitionBy(*by).orderBy("seq")
    before = F.last(F.nullif("length", F.lit(0)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) if keep_offset_at_zero else F.lag("length").over(order)
    found = lengths.withColumn("offset_before", F.coalesce(before, F.lit(0)))
    found = found.withColumn("truncated", F.col("length") < F.col("offset_before"))
    found = found.withColumn("start", F.when(F.col("truncated"), 0).otherwise(F.col("offset_before")))
    return found.withColumn("bytes", F.col("length") - F.col("start"))


def truncation_counts(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("path").agg(F.count_if("truncated").alias("truncation_reset"), F.sum("bytes").alias("bytes_read"))


def with_processable(events: DataFrame) -> DataFrame:
    """Whether content may be read, decided on the new path."""
    return events.withColumn("processable", is_processable("path"))
