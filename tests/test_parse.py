"""Line splitting and parsing: literal cases, edge cases, and random lines against a plain model."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logbrook.functions.parse import is_processable, split_lines, with_parsed
from logbrook.sources.files import LineSplitter

T = "2023-01-02T03:04:05Z"
BASE = datetime(2023, 1, 2, 3, 4, 5)
CASES = [
    (f"{T} INFO request_started latency_ms=123", (BASE, "INFO", "request_started", 123)),
    (f"{T} WARN something_happened", (BASE, "WARN", "something_happened", None)),
    ("not-a-ts INFO hi latency_ms=10", None),
    (f"{T} FOOBAR msg", (BASE, "OTHER", "msg", None)),
    (f"{T} INFO alpha beta gamma latency_ms=1", (BASE, "INFO", "alpha", 1)),
    (f"{T} INFO something latency_ms=abc", (BASE, "INFO", "something", None)),
    ("2023-01-02T03:04:05-06:00 INFO offmsg", (BASE + timedelta(hours=6), "INFO", "offmsg", None)),
    ("", None),
    (f"{T} INFO", None),
    (f"{T} INFO ", (BASE, "INFO", "", None)),
    (f"{T} INFO  x", (BASE, "INFO", "", None)),
    (f"{T}  msg", (BASE, "OTHER", "msg", None)),
    (f"{T} info k", (BASE, "INFO", "k", None)),
    (f"{T} ınfo k", (BASE, "OTHER", "k", None)),
    (f"{T} INFO k latency_ms=7abc", (BASE, "INFO", "k", 7)),
    (f"{T} INFO k latency_ms=abc latency_ms=5", (BASE, "INFO", "k", None)),
    (f"{T} INFO k latency_ms=2147483647", (BASE, "INFO", "k", 2147483647)),
    (f"{T} INFO k latency_ms=2147483648", (BASE, "INFO", "k", None)),
    (f"{T} INFO k latency_ms=0000000000012", (BASE, "INFO", "k", 12)),
    (f"{T} INFO k latency_ms=-5", (BASE, "INFO", "k", None)),
    (f"{T} INFO k xLATENCY_ms=9", (BASE, "INFO", "k", 9)),
    (f"{T} INFO latency_ms=4", (BASE, "INFO", "latency_ms=4", 4)),
    (f"{T}\tINFO\tk", None),
    ("2023-01-02T03:04:05.1Z INFO k", None),
    ("2023-01-02T03:04:05.123456Z INFO k", None),
    ("2023-01-02T03:04:05.123 INFO k", (BASE + timedelta(milliseconds=123), "INFO", "k", None)),
    ("2023-01-02T03:04:05.1234567Z INFO k", (BASE + timedelta(microseconds=123456), "INFO", "k", None)),
    ("2023-02-30T03:04:05Z INFO k", None),
    ("2023-01-02T24:04:05Z INFO k", None),
    ("2023-01-02T03:04:60Z INFO k", None),
    ("2023-01-02t03:04:05z INFO k", None),
    ("2023-01-02T03:04:05+0530 INFO k", None),
    ("2023-01-02T03:04:05+15:00 INFO k", None),
    ("\ufeff" + f"{T} INFO k", None),
]


def parsed(spark, lines):
    df = spark.createDataFrame([(i, x if isinstance(x, bytes) else x.encode()) for i, x in enumerate(lines)], "i int, line binary")
    stamp = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = with_parsed(df).select("i", stamp.alias("t"), "level", "message_key", "latency_ms", "is_malformed").orderBy("i").collect()
    return [None if r.is_malformed else (datetime.strptime(r.t, "%Y-%m-%d %H:%M:%S.%f"), r.level, r.message_key, r.latency_ms) for r in rows]


def test_cases(spark):
    assert parsed(spark, [line for line, _ in CASES]) == [want for _, want in CASES]


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert parsed(spark, [f"{T} INFO k", "2023-01-02T03:04:05 INFO k"]) == [(BASE, "INFO", "k", None)] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ill_formed_key(spark):
    assert parsed(spark, [T.encode() + b" INFO d\xff\xfe x"])[0][2] == "d\ufffd\ufffd"


def test_malformed_fields_are_null(spark):
    row = with_parsed(spark.createDataFrame([("x INFO k latency_ms=5",)], "line string")).first()
    assert (row.ts, row.level, row.message_key, row.latency_ms, row.is_malformed) == (None, None, None, None, True)


def model(line):
    first = line.find(" ")
    second = line.find(" ", first + 1) if first >= 0 else -1
    if second < 0:
        return None
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{3}|\d{7}))?(Z|[+-]\d\d:\d\d)?", line[:first], re.A)
    if not m:
        return None
    try:
        ts = datetime(*map(int, m.groups()[:6]), int((m[7] or "0").ljust(7, "0")[:6]))
    except ValueError:
        return None
    if m[8] and m[8] != "Z":
        minutes = int(m[8][1:3]) * 60 + int(m[8][4:6])
        if minutes > 840 or int(m[8][4:6]) > 59:
            return None
        ts -= timedelta(minutes=minutes) * (1 if m[8][0] == "+" else -1)
    name = line[first + 1 : second]
    level = name.upper() if name.isascii() and name.upper() in ("INFO", "WARN", "ERROR", "DEBUG") else "OTHER"
    end = line.find(" ", second + 1)
    found = re.search(r"latency_ms=(\d*)", line, re.I | re.A)
    value = int(found[1]) if found and found[1] else None
    return ts, level, line[second + 1 : end if end >= 0 else None], value if value is not None and value <= 2147483647 else None


def test_random_lines(spark):
    random.seed(3)
    stamps = ["2023-01-02T03:04:05", "2024-02-29T23:59:59.999", "2023-02-29T00:00:00", "0001-01-01T00:00:00", "x", "2023-01-02T03:04:05.1234567", "2023-1-2T03:04:05"]
    lines = [" ".join([random.choice(stamps) + random.choice(["", "Z", "+05:30", "-14:00", "+14:01", "z"]), *random.choices(["INFO", "warn", "k", "", "latency_ms=", "LATENCY_MS=00012x", "latency_ms=99999999999", "é"], k=random.randint(0, 4))]) for _ in range(600)]
    lines = [line for line in lines if not line.startswith("0001") or "+" not in line]  # before the first year
    assert parsed(spark, lines) == [model(line) for line in lines]


@pytest.mark.parametrize("text,lines", [("line1\nline2\n", ["line1", "line2"]), ("a\r\nb\r\n", ["a", "b"]), ("\n\n", ["", ""]), ("partial", []), ("b\rc\r\r\nd", ["b\rc\r"]), ("", [])])
def test_split(spark, text, lines):
    assert spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t"))).first()[0] == lines
    splitter = LineSplitter()
    assert splitter.feed(text.encode()) == [x.encode() for x in lines]


def test_split_over_chunks():
    splitter = LineSplitter()
    assert splitter.feed(b"first line\r") == [] and splitter.feed(b"\nsecond\r\n") == [b"first line", b"second"] and splitter.carry == b""
    assert splitter.feed(b"hello ") == [] and splitter.feed(b"world\n") == [b"hello world"]
    assert splitter.feed(b"partial") == [] and splitter.carry == b"partial"


def test_processable(spark):
    paths = ["/a/x.log", "x.TXT", "x.log.gz", "/a.log/x", "x", ".log", "a.b.txt"]
    found = spark.createDataFrame([(p,) for p in paths], "path string").select(is_processable("path")).collect()
    assert [r[0] for r in found] == [True, True, False, False, False, True, True]
