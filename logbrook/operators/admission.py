"""A bounded queue that drops the newest: what is admitted, dropped and left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def burst(events: DataFrame, by: list[str], capacity: int, order: str = "seq") -> DataFrame:
    """Each event with admitted: the first `capacity` of a burst that nobody drains."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    return events.withColumn("admitted", F.row_number().over(Window.partitionBy(*by).orderBy(order)) <= capacity)


def queue(ticks: Column, capacity: int, drain: int) -> Column:
    """Struct (admitted, dropped, depth) after ticks, an array of arrivals per tick in order; each tick ends with a drain."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("admitted", "dropped", "depth")])

    def step(s: Column, arrivals: Column) -> Column:
        room = F.least(arrivals, F.lit(capacity) - s["depth"])
        return F.struct((s["admitted"] + room).alias("admitted"), (s["dropped"] + arrivals - room).alias("dropped"), F.greatest(s["depth"] + room - drain, F.lit(0).cast("long")).alias("depth"))

    return F.aggregate(ticks, zero, step)


def simulate(events: DataFrame, tick: Column, capacity: int, drain: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Admission per queue from events counted per tick; ticks without events aren't drained. Only tick counts are brought together."""
    counts = events.groupBy(*by, tick.alias("tick")).agg(F.count("*").alias("n"))
    ordered = counts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "n"))), lambda x: x["n"]).alias("ticks"))
    return ordered.withColumn("_queue", queue(F.col("ticks"), capacity, drain)).select(*by, F.size("ticks").alias("ticks"), "_queue.admitted", "_queue.dropped", "_queue.depth")
