"""Counts, histogram, percentiles, top-k and the interval report of parsed records.

Spark's partial and final aggregation does what workers' buffers and their merge would. The latency
histogram has at most 10,002 bins, so percentiles over it never see more rows than that per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KINDS, LEVELS

#: Bins 0..10000 are milliseconds, the next one is overflow (fixed values).
LARGEST_BIN, OVERFLOW_BIN = 10000, 10001
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def counters() -> list[Column]:
    return [F.count("*").alias("lines_processed"), F.count_if("is_malformed").alias("malformed_lines")]


def line_counters(records: DataFrame) -> DataFrame:
    return records.agg(*counters())


def level_counts(records: DataFrame) -> DataFrame:
    """All five levels with their counts, zeros included."""
    found = records.where(~F.col("is_malformed")).agg(*[F.count_if(F.col("level") == level).alias(level) for level in LEVELS])
    return found.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(level).alias("level"), F.col(level).alias("n")) for i, level in enumerate(LEVELS)])).alias("x")).select("x.*")


def message_counts(records: DataFrame, *keys: str) -> DataFrame:
    return records.where(~F.col("is_malformed")).groupBy(*keys, "message_key").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int, key: str = "message_key", n: str = "n", ordinal: bool = False) -> DataFrame:
    """The k largest counts, ties by key; ordinal compares keys by UTF-16 units instead of UTF-8 bytes. k of 0 or less: none."""
    tie = F.hex(F.encode(F.col(key), "UTF-16BE")) if ordinal else F.col(key)
    return counts.orderBy(F.desc(n), tie.asc()).limit(max(k, 0))


def top_k_per(counts: DataFrame, by: list[str], k: int, key: str = "message_key", n: str = "n") -> DataFrame:
    """The k largest counts within each group, with their rank. Counts are few per group: one for each distinct key."""
    order = Window.partitionBy(*by).orderBy(F.desc(n), F.asc(key))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bin_of(latency: Column) -> Column:
    return F.least(F.greatest(latency, F.lit(0)), F.lit(OVERFLOW_BIN))


def latency_histogram(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, bin, n) of the bins that have samples; rows without latency add none."""
    sampled = records.where(~F.col("is_malformed") & F.col("latency_ms").isNotNull())
    return sampled.groupBy(*keys, bin_of(F.col("latency_ms")).alias("bin")).agg(F.count("*").alias("n"))


def merge_histograms(*histograms: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, histograms).groupBy("bin").agg(F.sum("n").alias("n"))


def nearest_rank(share: float) -> float:
    """Shares beyond 0..1 and NaN as the nearest sensible one."""
    return min(share, 1.0) if share > 0 else 0.0


def latency_percentiles(records: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """Nearest-rank percentiles of the bins, null without samples, and the number of samples."""
    return percentiles(latency_histogram(records), shares)


def percentiles(histogram: DataFrame, shares: dict[str, float] = SHARES, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group: for each share p the first bin whose running count reaches max(1, ceil(p n))."""
    run = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    seen = histogram.withColumns({"_upto": F.sum("n").over(run), "_all": F.sum("n").over(whole)})
    target = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(nearest_rank(p)) * F.col("_all")))
    found = [F.min(F.when(F.col("_upto") >= target(p), F.col("bin"))).cast("int").alias(name) for name, p in shares.items()]
    return seen.groupBy(*by).agg(F.coalesce(F.max("_all"), F.lit(0)).alias("samples"), *found)


def fs_event_columns() -> list[Column]:
    return [F.count_if(F.col("kind") == kind).alias(f"fs_{kind.lower()}") for kind in KINDS]


def fs_event_counts(events: DataFrame) -> DataFrame:
    """Counts by kind of all events, processable or not."""
    return events.agg(*fs_event_columns())


def io_counts(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Read failures and truncations from a status per read."""
    names = {"file_not_found": "FileNotFound", "access_denied": "AccessDenied", "io_exception": "IoError", "truncation_reset": "TruncatedReset"}
    return statuses.agg(*[F.count_if(F.col(status) == value).alias(name) for name, value in names.items()])


def rate(count: Column, elapsed: Column) -> Column:
    """Per second; 0 where no time has passed."""
    return F.when(elapsed > 0, count / elapsed).otherwise(F.lit(0.0))


def interval_report(records: DataFrame, by: list[str], elapsed: Column, k: int = 10) -> DataFrame:
    """One row per group: counters, level counts, percentiles, rates and the top k keys.

    Each part is aggregated from the records with map-side combining; parts meet on the group's few columns.
    """
    levels = F.array(*[F.count_if(~F.col("is_malformed") & (F.col("level") == level)) for level in LEVELS])
    base = records.groupBy(*by).agg(*counters(), levels.alias("level_counts"))
    shares = percentiles(latency_histogram(records, *by), by=tuple(by))
    best = top_k_per(message_counts(records, *by), by, max(k, 1)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("message_key").alias("key"), F.col("n").alias("count")))).alias("top"))
    best = best.select(*by, F.transform("top", lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))).alias("top_k"))
    joined = base.join(shares, by, "left").join(best, by, "left")
    none = F.array().cast("array<struct<key:string,count:bigint>>")
    return joined.withColumns({"elapsed_s": elapsed, "lines_per_s": rate(F.col("lines_processed"), elapsed), "top_k": F.coalesce("top_k", none), "samples": F.coalesce("samples", F.lit(0))})
