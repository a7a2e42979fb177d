"""Queries over log lines and file events made from the events table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import is_processable, split_lines, with_parsed
from ..operators import admission, aggregate, lifecycle
from ..sources import synthetic

Query = Callable[[SparkSession, str], DataFrame]
K, BURST, CAPACITY, DRAIN = 10, 3, 20, 12


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parsed(synthetic.log_lines(_events(spark, sf_dir)))


def _fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.fs_events(_events(spark, sf_dir))


def line_counters(spark, sf_dir):
    return aggregate.line_counters(_records(spark, sf_dir))


def parsed_records(spark, sf_dir):
    stamp = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_text")
    parsed = with_parsed(synthetic.log_lines(_events(spark, sf_dir)).drop("ts"))
    return parsed.select("event_id", "path", stamp, "level", "message_key", "latency_ms", "is_malformed")


def level_counts(spark, sf_dir):
    return aggregate.level_counts(_records(spark, sf_dir))


def message_counts(spark, sf_dir):
    return aggregate.message_counts(_records(spark, sf_dir))


def topk_messages(spark, sf_dir):
    return aggregate.top_k(aggregate.message_counts(_records(spark, sf_dir)), K)


def latency_histogram(spark, sf_dir):
    return aggregate.latency_histogram(_records(spark, sf_dir))


def latency_percentiles(spark, sf_dir):
    return aggregate.latency_percentiles(_records(spark, sf_dir))


def percentiles_by_path(spark, sf_dir):
    histogram = aggregate.latency_histogram(_records(spark, sf_dir), "path")
    return aggregate.percentiles(histogram, by=("path",))


def fs_event_counts(spark, sf_dir):
    return aggregate.fs_event_counts(_fs(spark, sf_dir))


def processable_events(spark, sf_dir):
    return _fs(spark, sf_dir).where(is_processable("path")).groupBy("path", "kind").agg(F.count("*").alias("n"))


def file_epochs(spark, sf_dir):
    return lifecycle.epochs(lifecycle.routed(_fs(spark, sf_dir)))


def file_generations(spark, sf_dir):
    found = lifecycle.generations(lifecycle.routed(_fs(spark, sf_dir)))
    return found.select("seq", "sub", "op", "path", "finalized", "epoch", "generation")


def tail_ranges(spark, sf_dir):
    return lifecycle.tail_ranges(synthetic.length_observations(_events(spark, sf_dir)))


def tail_ranges_kept_offset(spark, sf_dir):
    return lifecycle.tail_ranges(synthetic.length_observations(_events(spark, sf_dir)), keep_offset_at_zero=True)


def truncation_counts(spark, sf_dir):
    return lifecycle.truncation_counts(tail_ranges(spark, sf_dir))


def burst_admission(spark, sf_dir):
    hourly = _fs(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "observed_at"))
    marked = admission.burst(hourly, ["path", "hour"], BURST)
    return marked.groupBy("path").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("dropped"))


def queue_simulation(spark, sf_dir):
    return admission.simulate(_fs(spark, sf_dir), F.date_trunc("hour", "observed_at"), CAPACITY, DRAIN)


def _by_hour(spark, sf_dir):
    lines = synthetic.log_lines(_events(spark, sf_dir)).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")).drop("ts")
    return with_parsed(lines)


def interval_report_hourly(spark, sf_dir):
    report = aggregate.interval_report(_by_hour(spark, sf_dir), ["hour"], F.lit(3600.0), 1)
    levels = [F.get("level_counts", F.lit(i)).alias(f"n_{level}") for i, level in enumerate(("info", "warn", "error", "debug", "other"))]
    first = F.get("top_k", F.lit(0))
    return report.select("hour", "lines_processed", "malformed_lines", *levels, "samples", "p50", "p95", "p99", first["key"].alias("top_key"), first["count"].alias("top_count"), F.round("lines_per_s", 6).alias("lines_per_s"))


def interval_topk(spark, sf_dir):
    daily = with_parsed(synthetic.log_lines(_events(spark, sf_dir)).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts"))
    return aggregate.top_k_per(aggregate.message_counts(daily, "day"), ["day"], 3)


def split_contents(spark, sf_dir):
    """Every complete line of every content, with its number from 0."""
    contents = synthetic.contents(_events(spark, sf_dir))
    return contents.select("event_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))


def unended_contents(spark, sf_dir):
    """Lines and characters after the last line end, by whether there are any."""
    contents = synthetic.contents(_events(spark, sf_dir))
    rest = F.length(F.regexp_extract("content", r"([^\n]*)\z", 1))
    counted = contents.select((rest > 0).alias("unended"), F.size(split_lines(F.col("content"))).alias("complete"), rest.alias("rest"))
    return counted.groupBy("unended").agg(F.sum("complete").alias("n_lines"), F.sum("rest").alias("rest_chars"))


def io_counters(spark, sf_dir):
    return aggregate.io_counts(synthetic.read_statuses(_events(spark, sf_dir)))


def merged_histograms(spark, sf_dir):
    """Histograms per path, merged: the same as over all lines."""
    return aggregate.merge_histograms(aggregate.latency_histogram(_records(spark, sf_dir), "path").drop("path"))


def partial_final_merge(spark, sf_dir):
    """Counters and key counts per path, then merged: the same as over all lines."""
    records = _records(spark, sf_dir)
    partial = records.groupBy("path", "message_key").agg(*aggregate.counters())
    return partial.groupBy("message_key").agg(F.sum("lines_processed").alias("lines_processed"), F.sum("malformed_lines").alias("malformed_lines"))


def queries() -> dict[str, Query]:
    found = [line_counters, parsed_records, level_counts, message_counts, topk_messages, latency_histogram, latency_percentiles, percentiles_by_path, fs_event_counts, processable_events, file_epochs, file_generations, tail_ranges, tail_ranges_kept_offset, truncation_counts, burst_admission, queue_simulation, interval_report_hourly, interval_topk, partial_final_merge, split_contents, unended_contents, io_counters, merged_histograms]
    return {f.__name__: f for f in found}


_PATH = "'/logs/' || ({u} % 8) || CASE {u} % 4 WHEN 1 THEN '.TXT' WHEN 3 THEN '.tmp' ELSE '.log' END"
_LINES = f"""lines AS (
  SELECT event_id, ts AS event_ts, {_PATH.format(u="user_id")} AS path,
    CASE WHEN event_id % 37 = 0 THEN 'not-a-ts' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END || ' '
    || CASE event_type WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'debug' WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'WARN' ELSE 'TRADE' END || ' '
    || CASE WHEN event_id % 53 = 0 THEN '' ELSE event_type || '_' || (user_id % 7) END
    || CASE WHEN event_id % 11 = 0 THEN ' latency_ms=abc' WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN ' LATENCY_MS=' || CAST(floor(value * 40) AS INT) || 'ms' ELSE ' latency_ms=' || CAST(floor(value * 40) AS INT) END AS line
  FROM events),
tokens AS (
  SELECT *, regexp_extract(line, '^([^ ]*) ([^ ]*) ([^ ]*)', 1) AS stamp, regexp_extract(line, '^([^ ]*) ([^ ]*) ([^ ]*)', 2) AS name,
    regexp_extract(line, '^([^ ]*) ([^ ]*) ([^ ]*)', 3) AS word, regexp_extract(line, '(?is)^.*?latency_ms=([0-9]*)', 1) AS digits
  FROM lines),
checked AS (
  SELECT *, coalesce(regexp_matches(stamp, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]{{3}}|[.][0-9]{{7}})?Z$') AND try_cast(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL, false) AS ok
  FROM tokens),
records AS (
  SELECT event_id, event_ts, path, CASE WHEN ok THEN try_cast(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS ts,
    CASE WHEN ok THEN CASE WHEN lower(name) IN ('info', 'warn', 'error', 'debug') THEN upper(name) ELSE 'OTHER' END END AS level,
    CASE WHEN ok THEN word END AS message_key,
    CASE WHEN ok AND try_cast(digits AS BIGINT) <= 2147483647 THEN CAST(digits AS INT) END AS latency_ms, NOT ok AS is_malformed
  FROM checked)"""
_FS = f"""fs AS (
  SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'Created' WHEN 'error' THEN 'Deleted' WHEN 'purchase' THEN 'Renamed' ELSE 'Modified' END AS kind,
    CASE WHEN event_type = 'purchase' THEN {_PATH.format(u="(user_id + 1)")} ELSE {_PATH.format(u="user_id")} END AS path,
    CASE WHEN event_type = 'purchase' THEN {_PATH.format(u="user_id")} END AS old_path, ts AS observed_at
  FROM events),
ops AS (
  SELECT seq, 0 AS sub, 'D' AS op, coalesce(old_path, path) AS path FROM fs WHERE kind IN ('Deleted', 'Renamed')
  UNION ALL
  SELECT seq, CASE kind WHEN 'Renamed' THEN 1 ELSE 0 END, 'W', path FROM fs WHERE kind <> 'Deleted' AND regexp_matches(lower(path), '[.](log|txt)$')),
marked AS (SELECT *, op = 'D' AND coalesce(lag(op) OVER (PARTITION BY path ORDER BY seq, sub) = 'W', false) AS finalized FROM ops),
gens AS (SELECT *, sum(CAST(finalized AS INT)) OVER (PARTITION BY path ORDER BY seq, sub ROWS UNBOUNDED PRECEDING) AS epoch FROM marked)"""
_CONTENTS = """contents AS (
  SELECT event_id, event_type || ' ' || user_id || CASE WHEN event_id % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END
    || CASE WHEN event_id % 5 = 0 THEN chr(10) || chr(13) || chr(10) ELSE '' END
    || CASE WHEN event_id % 7 = 0 THEN 'a' || chr(13) || 'b' || chr(13) || chr(13) || chr(10) ELSE '' END
    || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'rest ' || event_id END AS content
  FROM events),
parts AS (SELECT event_id, string_split(content, chr(10)) AS parts FROM contents)"""
_SAMPLES = "SELECT *, least(greatest(latency_ms, 0), 10001) AS bin FROM records WHERE NOT is_malformed AND latency_ms IS NOT NULL"
_SHARES = ", ".join(f"CAST(quantile_disc(bin, {p}) AS INT) AS p{n}" for n, p in ((50, 0.5), (95, 0.95), (99, 0.99)))


def _tail(before: str) -> str:
    return f"""SELECT *, CAST(CASE WHEN truncated THEN 0 ELSE offset_before END AS BIGINT) AS start, CAST(length - CASE WHEN truncated THEN 0 ELSE offset_before END AS BIGINT) AS bytes
FROM (SELECT *, length < offset_before AS truncated FROM (SELECT *, coalesce({before}, 0) AS offset_before FROM (
  SELECT {_PATH.format(u="user_id")} AS path, event_id AS seq, CAST(CASE WHEN event_id % 29 = 0 THEN 0 ELSE floor(value * 40) END AS BIGINT) AS length FROM events)))"""


def oracle_sql() -> dict[str, str]:
    lag = "lag(length) OVER (PARTITION BY path ORDER BY seq)"
    last = "last_value(nullif(length, 0) IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    levels = "(VALUES (0, 'INFO'), (1, 'WARN'), (2, 'ERROR'), (3, 'DEBUG'), (4, 'OTHER')) AS d(ordinal, level)"
    by_level = ", ".join(f"count(*) FILTER (WHERE level = '{level.upper()}') AS n_{level}" for level in ("info", "warn", "error", "debug", "other"))
    hour = "strftime(event_ts, '%Y-%m-%d %H')"
    return {
        "line_counters": f"WITH {_LINES} SELECT count(*) AS lines_processed, count(*) FILTER (WHERE is_malformed) AS malformed_lines FROM records",
        "parsed_records": f"WITH {_LINES} SELECT event_id, path, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, level, message_key, latency_ms, is_malformed FROM records",
        "level_counts": f"WITH {_LINES} SELECT d.ordinal, d.level, count(r.level) AS n FROM {levels} LEFT JOIN records r ON r.level = d.level GROUP BY ALL",
        "message_counts": f"WITH {_LINES} SELECT message_key, count(*) AS n FROM records WHERE NOT is_malformed GROUP BY message_key",
        "topk_messages": f"WITH {_LINES} SELECT message_key, count(*) AS n FROM records WHERE NOT is_malformed GROUP BY message_key ORDER BY n DESC, message_key LIMIT {K}",
        "latency_histogram": f"WITH {_LINES} SELECT bin, count(*) AS n FROM ({_SAMPLES}) GROUP BY bin",
        "latency_percentiles": f"WITH {_LINES} SELECT count(*) AS samples, {_SHARES} FROM ({_SAMPLES})",
        "percentiles_by_path": f"WITH {_LINES} SELECT path, count(*) AS samples, {_SHARES} FROM ({_SAMPLES}) GROUP BY path",
        "fs_event_counts": f"WITH {_FS} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS fs_{k.lower()}" for k in ("Created", "Modified", "Deleted", "Renamed")) + " FROM fs",
        "processable_events": f"WITH {_FS} SELECT path, kind, count(*) AS n FROM fs WHERE regexp_matches(lower(path), '[.](log|txt)$') GROUP BY path, kind",
        "file_epochs": f"WITH {_FS} SELECT path, CAST(sum(CAST(finalized AS INT)) AS BIGINT) AS epoch FROM gens GROUP BY path",
        "file_generations": f"WITH {_FS} SELECT seq, sub, op, path, finalized, CAST(epoch AS BIGINT) AS epoch, CAST(epoch + 1 AS BIGINT) AS generation FROM gens",
        "tail_ranges": _tail(lag),
        "tail_ranges_kept_offset": _tail(last),
        "truncation_counts": f"SELECT path, count(*) FILTER (WHERE truncated) AS truncation_reset, CAST(sum(bytes) AS BIGINT) AS bytes_read FROM ({_tail(lag)}) GROUP BY path",
        "burst_admission": f"WITH {_FS} SELECT path, count(*) FILTER (WHERE r <= {BURST}) AS admitted, count(*) FILTER (WHERE r > {BURST}) AS dropped FROM (SELECT path, row_number() OVER (PARTITION BY path, date_trunc('hour', observed_at) ORDER BY seq) AS r FROM fs) GROUP BY path",
        "queue_simulation": f"""WITH RECURSIVE ticks AS (SELECT row_number() OVER (ORDER BY h) AS i, n FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY h)),
sim AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS admitted, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS depth
  UNION ALL SELECT t.i, s.admitted + least(t.n, {CAPACITY} - s.depth), s.dropped + t.n - least(t.n, {CAPACITY} - s.depth), greatest(s.depth + least(t.n, {CAPACITY} - s.depth) - {DRAIN}, 0) FROM sim s JOIN ticks t ON t.i = s.i + 1)
SELECT CAST(i AS INT) AS ticks, admitted, dropped, depth FROM sim ORDER BY i DESC LIMIT 1""",
        "interval_report_hourly": f"""WITH {_LINES},
base AS (SELECT {hour} AS hour, count(*) AS lines_processed, count(*) FILTER (WHERE is_malformed) AS malformed_lines, {by_level} FROM records GROUP BY 1),
shares AS (SELECT {hour} AS hour, count(*) AS samples, {_SHARES} FROM ({_SAMPLES}) GROUP BY 1),
best AS (SELECT hour, message_key AS top_key, n AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, message_key) AS r FROM (SELECT {hour} AS hour, message_key, count(*) AS n FROM records WHERE NOT is_malformed GROUP BY ALL)) WHERE r = 1)
SELECT hour, lines_processed, malformed_lines, n_info, n_warn, n_error, n_debug, n_other, coalesce(samples, 0) AS samples, p50, p95, p99, top_key, top_count, round(lines_processed / 3600.0, 6) AS lines_per_s
FROM base LEFT JOIN shares USING (hour) LEFT JOIN best USING (hour)""",
        "interval_topk": f"WITH {_LINES} SELECT day, message_key, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, message_key) AS r FROM (SELECT strftime(event_ts, '%Y-%m-%d') AS day, message_key, count(*) AS n FROM records WHERE NOT is_malformed GROUP BY ALL)) WHERE r <= 3",
        "split_contents": f"WITH {_CONTENTS} SELECT event_id, CAST(i - 1 AS INT) AS line_no, CASE WHEN ends_with(parts[i], chr(13)) THEN left(parts[i], length(parts[i]) - 1) ELSE parts[i] END AS line FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM parts)",
        "unended_contents": f"WITH {_CONTENTS} SELECT parts[-1] <> '' AS unended, CAST(sum(len(parts) - 1) AS BIGINT) AS n_lines, CAST(sum(length(parts[-1])) AS BIGINT) AS rest_chars FROM parts GROUP BY 1",
        "io_counters": "SELECT " + ", ".join(f"count(*) FILTER (WHERE event_id % 11 = {i}) AS {name}" for i, name in enumerate(("file_not_found", "access_denied", "io_exception", "truncation_reset"))) + " FROM events",
        "merged_histograms": f"WITH {_LINES} SELECT bin, count(*) AS n FROM ({_SAMPLES}) GROUP BY bin",
        "partial_final_merge": f"WITH {_LINES} SELECT message_key, count(*) AS lines_processed, count(*) FILTER (WHERE is_malformed) AS malformed_lines FROM records GROUP BY message_key",
    }
