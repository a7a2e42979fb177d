"""Files, the tailing source, the monitor and the command line."""

import os
import time

import pytest

from logbrook import cli
from logbrook.functions.parse import with_parsed
from logbrook.operators import aggregate
from logbrook.sources import synthetic, tail
from logbrook.sources.files import lines_between, read_logs, read_ranges
from logbrook.streaming.monitor import formatted, start_monitor

T = b"2023-01-02T03:04:05Z "


def put(path, data, mode="wb"):
    with open(path, mode) as file:
        file.write(data)


def test_read_logs(spark, tmp_path):
    put(tmp_path / "a.log", T + b"INFO key1 latency_ms=10\n" + T + b"WARN key2\nleft")
    put(tmp_path / "b.TXT", b"\xef\xbb\xbf" + T + b"INFO bom\r\n" + T + b"INFO a\rb\r\n\n")
    put(tmp_path / "c.tmp", T + b"INFO no\n")
    put(tmp_path / "empty.log", b"")
    lines = read_logs(spark, str(tmp_path))
    found = sorted((r.path[-5:], r.line_offset, bytes(r.line)) for r in lines.collect())
    assert [x[2] for x in found] == [T + b"INFO key1 latency_ms=10", T + b"WARN key2", b"\xef\xbb\xbf" + T + b"INFO bom", T + b"INFO a\rb", b""]
    assert tuple(aggregate.line_counters(with_parsed(lines)).first()) == (5, 2)


@pytest.mark.parametrize("chunk", [1, 7, 32, 65536, 0])
def test_ranges(tmp_path, chunk):
    path = str(tmp_path / "a.log")
    put(path, b"one\r\n" + b"k" * 200 + b"\n\nlast\npart")
    assert list(lines_between(path, 5, 5 + 207, chunk)) == [(5, b"k" * 200), (206, b""), (207, b"last")]


def test_range_of_missing_file(spark):
    df = spark.createDataFrame([("/none/x.log", 1, 0, 10)], "path string, generation int, start long, end long")
    assert read_ranges(df).count() == 0


def test_tail_states(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()

    def step():
        nonlocal state
        rows, after = reader.read(state)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(state, after))
        state = after
        return [(r[0], os.path.basename(r[1]), r[3], r[4], r[5], r[6]) for r in rows[:-1]]

    assert step() == []
    a = tmp_path / "a.log"
    put(a, b"hello\nwor")
    assert step() == [("Created", "a.log", 1, 0, 6, "ReadSome")]
    put(a, b"ld\n", "ab")
    assert step() == [("Modified", "a.log", 1, 6, 12, "ReadSome")]
    assert step() == []
    put(a, b"ab\n")
    assert step() == [("Modified", "a.log", 1, 0, 3, "TruncatedReset")]
    put(a, b"")
    assert step() == [("Modified", "a.log", 1, 0, 0, "TruncatedReset")]
    put(a, b"abcdef\n")
    assert step() == [("Modified", "a.log", 1, 0, 7, "ReadSome")]
    os.rename(a, tmp_path / "b.log")
    assert step() == [("Renamed", "b.log", 1, 0, 7, "ReadSome")]
    os.remove(tmp_path / "b.log")
    assert step() == [("Deleted", "b.log", 1, 0, 0, "NoData")]
    put(tmp_path / "b.log", b"x\n")
    assert step() == [("Created", "b.log", 2, 0, 2, "ReadSome")]
    put(tmp_path / "c.bin", b"x\n")
    assert step() == [("Created", "c.bin", 1, 0, 0, "NoData")]


def test_tail_rotation(tmp_path):
    """A file under an old name with a new inode is read from its start, and the renamed one isn't read again beyond what it grew."""
    state = {"tick": 0, "files": {}, "epochs": {}, "published": 0, "dropped": 0, "events": []}
    log, old = str(tmp_path / "a.log"), str(tmp_path / "a.log.1")
    put(log, b"one\ntwo..\n")
    state = tail.advanced(state, str(tmp_path), 100)
    os.rename(log, old)
    put(log, b"three\nfour\nfive....\n")
    state = tail.advanced(state, str(tmp_path), 100)
    seen = {(e[0], e[1], e[4], e[5]) for e in state["events"]}
    assert ("Created", log, 0, 20) in seen and any(e[0] == "Renamed" and e[1] == old and e[2] == log for e in state["events"])
    put(str(tmp_path / "b.tmp"), b"six\nseven\n")
    os.replace(tmp_path / "b.tmp", log)
    state = tail.advanced(state, str(tmp_path), 100)
    assert {(e[0], e[4], e[5]) for e in state["events"] if e[1] == log} >= {("Deleted", 0, 0), ("Created", 0, 10)}
    assert state["epochs"][log] == 2


def test_tail_capacity(tmp_path):
    for i in range(3):
        put(tmp_path / f"{i}.log", b"x\n")
    reader = tail.TailReader({"path": str(tmp_path), "queuecapacity": "2"})
    first = reader.read(reader.initialOffset())[1]
    assert (first["published"], first["dropped"], len(first["events"])) == (2, 1, 2)
    second = reader.read(first)[1]  # the dropped event's bytes come with the next
    assert (second["published"], second["dropped"], len(second["events"])) == (3, 1, 1)
    with pytest.raises(ValueError):
        tail.TailReader({"path": str(tmp_path), "queuecapacity": "0"})


def test_tail_latest(tmp_path):
    put(tmp_path / "a.log", b"old\n")
    reader = tail.TailReader({"path": str(tmp_path), "startingoffsets": "latest"})
    _, state = reader.read(reader.initialOffset())
    assert state["events"][0][4:6] == [4, 4]
    put(tmp_path / "a.log", b"new\n", "ab")
    assert reader.read(state)[1]["events"][0][4:6] == [4, 8]


def test_monitor(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    put(folder / "a.log", T + b"INFO key1 latency_ms=10\n" + T + b"WARN key2\n" + T[:9])
    seen = []

    def wait(done):
        end = time.time() + 60
        while time.time() < end and not done():
            time.sleep(0.1)
        assert done()

    query = start_monitor(spark, str(folder), str(tmp_path / "state"), interval=0.5, k=1, sink=seen.append)
    try:
        wait(lambda: sum(r.lines_processed for r in seen) == 2)
        put(folder / "a.log", T[9:] + b"INFO key1 latency_ms=20000\n", "ab")
        wait(lambda: sum(r.lines_processed for r in seen) == 3)
        count = len(seen)
        wait(lambda: len(seen) > count)  # an interval without events is reported too
    finally:
        query.stop()
    full = [r for r in seen if r.lines_processed]
    assert (full[0].level_counts, full[0].p50, [tuple(t) for t in full[0].top_k]) == ([1, 1, 0, 0, 0], 10, [("key1", 1)])
    assert full[1].p99 == 10001 and ">10000" in formatted(full[1]) and "TopK:\n  key1: 1" in formatted(full[1])
    put(folder / "a.log", T + b"INFO key3\n", "ab")
    last = []
    start_monitor(spark, str(folder), str(tmp_path / "state"), sink=last.append, once=True).awaitTermination(60)
    assert sum(r.lines_processed for r in last) == 1 and all(r.elapsed_s == 0 and r.lines_per_s == 0 for r in last)


def test_generate(spark):
    parsed = with_parsed(synthetic.generate(spark, 500, files=7, seed=3))
    assert tuple(aggregate.line_counters(parsed).first()) == (500, 0)
    assert parsed.where("latency_ms NOT BETWEEN 1 AND 9999 OR latency_ms IS NULL").count() == 0
    assert parsed.select("path").distinct().count() == 7


def test_cli(tmp_path):
    options = cli.parser().parse_args([str(tmp_path), "-w", "2", "-q", "5", "-r", "3", "-k", "4"])
    assert (options.workers, options.queue_capacity, options.report_interval_seconds, options.topk) == (2, 5, 3, 4)
    plain = cli.parser().parse_args([str(tmp_path)])
    assert (plain.workers, plain.queue_capacity, plain.report_interval_seconds, plain.topk) == (os.cpu_count(), 10000, 2, 10)
    for bad in ([], ["/none/there"], [""], [str(tmp_path), "-w", "0"], [str(tmp_path), "-q", "0"], [str(tmp_path), "-r", "0"], [str(tmp_path), "-k", "x"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
