"""Aggregation, lifecycle and admission."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logbrook.operators import admission, aggregate, lifecycle


def histogram(spark, values):
    df = spark.createDataFrame([(False, v) for v in values], "is_malformed boolean, latency_ms int")
    return aggregate.latency_histogram(df)


@pytest.mark.parametrize("values,shares,want", [
    ([], [0.5], [None]), ([123], [0.5, 0.95, 1.0], [123] * 3), ([1, 2, 3, 4], [0.5, 0.95], [2, 4]), ([10001, 20000], [1.0], [10001]),
    ([10, 20, 30, 40], [0.5, 0.95, 0.99], [20, 40, 40]), ([5, 1], [-1.0, 0.0, float("nan"), 2.0], [1, 1, 1, 5]), ([-3, None, 10000], [0.5, 1.0], [0, 10000]),
])
def test_percentiles(spark, values, shares, want):
    row = aggregate.percentiles(histogram(spark, values), {f"p{i}": p for i, p in enumerate(shares)}).first()
    assert row["samples"] == len([v for v in values if v is not None])
    assert [row[f"p{i}"] for i in range(len(shares))] == want


def test_percentiles_are_nearest_ranks(spark):
    random.seed(1)
    values = [random.randint(0, 12000) for _ in range(777)]
    bins = sorted(min(v, 10001) for v in values)
    row = aggregate.percentiles(histogram(spark, values)).first()
    assert [row.p50, row.p95, row.p99] == [bins[max(1, math.ceil(p * 777)) - 1] for p in (0.5, 0.95, 0.99)]


def test_merge_histograms(spark):
    merged = aggregate.merge_histograms(histogram(spark, [1, 2]), histogram(spark, [2, 3]))
    assert {r.bin: r.n for r in merged.collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("counts,k,want", [({"b": 2, "a": 3, "c": 1}, 10, ["a", "b", "c"]), ({"b": 5, "A": 5, "a": 5}, 10, ["A", "a", "b"]), ({"k1": 1, "k2": 10, "k3": 5}, 2, ["k2", "k3"]), ({"a": 1}, 0, []), ({"a": 1}, -1, [])])
def test_top_k(spark, counts, k, want):
    df = spark.createDataFrame(list(counts.items()), "message_key string, n long")
    assert [r.message_key for r in aggregate.top_k(df, k).collect()] == want


def test_top_k_ordinal(spark):
    df = spark.createDataFrame([("\uffee", 1), ("\U0001f600", 1)], "message_key string, n long")
    assert [r.message_key for r in aggregate.top_k(df, 2).collect()] == ["\uffee", "\U0001f600"]
    assert [r.message_key for r in aggregate.top_k(df, 2, ordinal=True).collect()] == ["\U0001f600", "\uffee"]


def records(spark, rows):
    return spark.createDataFrame(rows, "path string, level string, message_key string, latency_ms int, is_malformed boolean")


def test_report(spark):
    df = records(spark, [("a", "INFO", "k", 5, False), ("a", "WARN", "k", None, False), ("a", None, None, None, True), ("b", None, None, None, True)])
    rows = {r.path: r for r in aggregate.interval_report(df, ["path"], F.lit(2.0), 1).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.lines_processed, a.malformed_lines, a.level_counts, a.samples, a.p50, a.lines_per_s) == (3, 1, [1, 1, 0, 0, 0], 1, 5, 1.5)
    assert [tuple(t) for t in a.top_k] == [("k", 2)]
    assert (b.samples, b.p50, b.top_k, b.level_counts) == (0, None, [], [0] * 5)
    assert [r.n for r in aggregate.level_counts(df).orderBy("ordinal").collect()] == [1, 1, 0, 0, 0]


def test_rate_without_time(spark):
    assert spark.range(1).select(aggregate.rate(F.lit(5), F.lit(0.0))).first()[0] == 0.0


def test_io_counts(spark):
    df = spark.createDataFrame([("FileNotFound",), ("IoError",), ("IoError",), ("TruncatedReset",), ("ReadSome",)], "status string")
    assert tuple(aggregate.io_counts(df).first()) == (1, 0, 2, 1)


def fs(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, kind string, path string, old_path string")
    return lifecycle.with_processable(df)


def test_lifecycle(spark):
    df = fs(spark, [("Created", "a.log", None), ("Deleted", "a.log", None), ("Created", "a.log", None), ("Deleted", "b.log", None), ("Renamed", "c.bin", "a.log"), ("Renamed", "a.log", "c.bin"), ("Created", "x.bin", None), ("Deleted", "x.bin", None)])
    ops = lifecycle.routed(df)
    assert {r.path: r.epoch for r in lifecycle.epochs(ops).collect()} == {"a.log": 2, "b.log": 0, "c.bin": 0, "x.bin": 0}
    found = {(r.seq, r.sub): (r.op, r.generation) for r in lifecycle.generations(ops).where("path = 'a.log'").collect()}
    assert found == {(0, 0): ("W", 1), (1, 0): ("D", 2), (2, 0): ("W", 2), (4, 0): ("D", 3), (5, 1): ("W", 3)}
    assert tuple(aggregate.fs_event_counts(df).first()) == (3, 0, 3, 2)


def test_tail_ranges(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 11, 3, 0, 0, 4, 20])], "path string, seq long, length long")
    plain = lifecycle.tail_ranges(df).orderBy("seq").collect()
    assert [(r.offset_before, r.truncated, r.bytes) for r in plain] == [(0, False, 5), (5, False, 6), (11, True, 3), (3, True, 0), (0, False, 0), (0, False, 4), (4, False, 16)]
    kept = lifecycle.tail_ranges(df, keep_offset_at_zero=True).orderBy("seq").collect()
    assert [r.truncated for r in kept] == [False, False, True, True, True, False, False]
    assert lifecycle.truncation_counts(lifecycle.tail_ranges(df)).first().truncation_reset == 2


def test_burst(spark):
    df = spark.createDataFrame([(1, i) for i in range(3)], "tick int, seq long")
    assert [r.admitted for r in admission.burst(df, ["tick"], 2).orderBy("seq").collect()] == [True, True, False]
    with pytest.raises(ValueError):
        admission.burst(df, ["tick"], 0)


def test_queue(spark):
    random.seed(2)
    for ticks, capacity, drain in [([3, 4, 0, 9], 5, 2), ([], 5, 1), ([random.randint(0, 9) for _ in range(50)], 7, 3)]:
        depth = admitted = dropped = 0
        for n in ticks:
            room = min(n, capacity - depth)
            admitted, dropped, depth = admitted + room, dropped + n - room, max(depth + room - drain, 0)
        df = spark.createDataFrame([(ticks,)], "t array<long>").select(admission.queue(F.col("t"), capacity, drain).alias("q")).select("q.*")
        assert tuple(df.first()) == (admitted, dropped, depth)
        assert admitted + dropped == sum(ticks) and depth <= capacity


def test_simulate_per_queue(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 1, 1, 2)] + [("b", 1)], "q string, tick int")
    assert {r.q: (r.admitted, r.dropped, r.depth) for r in admission.simulate(df, F.col("tick"), 2, 1, ("q",)).collect()} == {"a": (3, 1, 1), "b": (1, 0, 0)}
