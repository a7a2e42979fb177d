"""The continuous query: tail a folder and report every interval."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parse import with_parsed
from ..operators import aggregate
from ..sources.files import read_ranges
from ..sources.tail import TailDataSource

#: Counters of races between threads, which a micro-batch doesn't have; reported as 0.
RACES = ("coalesced_busy", "delete_pending_set", "skipped_delete_pending")


def report_of(batch: DataFrame, elapsed: float, k: int) -> DataFrame:
    """The interval's one row of all counters, from the source's rows of a trigger."""
    events = batch.where("kind <> 'Tick'")
    records = with_parsed(read_ranges(events.where("processable AND end > start")))
    one = F.lit(1).alias("one")
    records = records.select("*", one)
    levels = aggregate.level_counts(records).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "n"))), lambda x: x["n"]).alias("level_counts"))
    best = aggregate.top_k(aggregate.message_counts(records), max(k, 1))
    top = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("message_key").alias("key"), F.col("n").alias("count")))).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))).alias("top_k"))
    removed = F.count_if((F.col("kind") == "Deleted") | (F.col("kind") == "Renamed")).alias("file_state_removed")
    totals = batch.agg(F.coalesce(F.max("published"), F.lit(0)).alias("bus_published"), F.coalesce(F.max("dropped"), F.lit(0)).alias("bus_dropped"))
    parts = [aggregate.line_counters(records), levels, aggregate.latency_percentiles(records), top, aggregate.fs_event_counts(events), events.agg(removed), aggregate.io_counts(events), totals]
    row = parts[0]
    for part in parts[1:]:  # each is one row
        row = row.crossJoin(part)
    fs = F.col("fs_created") + F.col("fs_modified") + F.col("fs_deleted") + F.col("fs_renamed")
    seconds = F.lit(float(elapsed))
    return row.select("*", *[F.lit(0).cast("long").alias(c) for c in RACES], F.lit(0).cast("long").alias("bus_depth"), seconds.alias("elapsed_s"), fs.alias("fs_events"), aggregate.rate(F.col("lines_processed"), seconds).alias("lines_per_s"), aggregate.rate(fs, seconds).alias("fs_per_s"))


def shown(bin: int | None) -> str:
    """A percentile for the console."""
    return "-" if bin is None else f">{aggregate.LARGEST_BIN}" if bin == aggregate.OVERFLOW_BIN else str(bin)


def formatted(row) -> str:
    """The console's report. Memory and collection figures of the process are not Spark's to give and stay 0."""
    line = (
        f"[REPORT] elapsed={row['elapsed_s']:.2f}s lines={row['lines_processed']} lines/s={row['lines_per_s']:.2f} malformed={row['malformed_lines']} "
        f"fs-events={row['fs_events']} fs/s={row['fs_per_s']:.2f} busDropped={row['bus_dropped']} busPublished={row['bus_published']} busDepth={row['bus_depth']} "
        f"allocatedDelta=0 allocated=0 gen0Delta=0 gen1Delta=0 gen2Delta=0 p50={shown(row['p50'])} p95={shown(row['p95'])} p99={shown(row['p99'])}"
    )
    return "\n".join([line, *(["TopK:"] if row["top_k"] else []), *[f"  {t['key']}: {t['count']}" for t in row["top_k"]]])


def start_monitor(spark: SparkSession, folder: str, checkpoint: str, interval: float = 2.0, k: int = 10, queue_capacity: int = 10000, starting: str = "earliest", sink: Callable = None, once: bool = False) -> StreamingQuery:
    """Start the query; sink gets each interval's report row (by default it is printed). once: all there is, then stop."""
    if k < 1 or queue_capacity < 1 or interval <= 0:
        raise ValueError("k and queue_capacity must be at least 1, the interval positive")
    spark.dataSource.register(TailDataSource)
    last = [time.monotonic()]
    give = sink or (lambda row: print(formatted(row), flush=True))

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()  # several aggregates read the trigger's few rows
        try:
            now = time.monotonic()
            elapsed, last[0] = (0.0 if once else now - last[0]), now
            give(report_of(batch, elapsed, k).first())
        finally:
            batch.unpersist()

    stream = spark.readStream.format("log_tail").option("queueCapacity", str(queue_capacity)).option("startingOffsets", starting).load(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{interval} seconds")).start()
