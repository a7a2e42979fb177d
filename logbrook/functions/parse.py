"""Splitting and strict parsing of log lines, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: yyyy-MM-ddTHH:mm:ss with no, three or seven fraction digits and no zone, Z or an offset of at most 14 hours with a colon.
TIMESTAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3}|[.][0-9]{7})?(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?\z"
LARGEST_INT = 2147483647


def text_of(line: Column | str) -> Column:
    """A binary or string line as string; ill-formed bytes become U+FFFD."""
    return F.make_valid_utf8((F.col(line) if isinstance(line, str) else line).cast("string"))


def split_lines(content: Column) -> Column:
    """Complete lines of a text: only \\n ends a line, one \\r before it goes, and what follows the last \\n isn't a line yet."""
    parts = F.split(content, "\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_replace(x, r"\r\z", ""))


def timestamp_of(stamp: Column) -> Column:
    """The instant, null if the token isn't strictly of an accepted form. No zone means UTC whatever the session's zone."""
    zoned = F.when(stamp.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    return F.when(stamp.rlike(TIMESTAMP), F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][.SSS][XXX]")))


def level_of(name: Column) -> Column:
    """One of the five levels; ASCII case doesn't matter, anything else is OTHER."""
    upper = F.upper(name)
    return F.when(name.rlike(r"\A[A-Za-z]{4,5}\z") & upper.isin("INFO", "WARN", "ERROR", "DEBUG"), upper).otherwise(F.lit("OTHER"))


def latency_of(line: Column) -> Column:
    """Digits after the first latency_ms= in any ASCII case, wherever it stands; null without digits or beyond 32 bits."""
    digits = F.regexp_replace(F.regexp_extract(line, r"(?s)\A.*?(?i:latency_ms=)([0-9]*)", 1), r"\A0+(?=[0-9])", "")
    value = F.when(F.length(digits).between(1, 10), digits).try_cast("bigint")
    return F.when(value <= LARGEST_INT, value).cast("int")


def is_processable(path: Column | str) -> Column:
    """Whether the file name ends in .log or .txt, in any case."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"[.]([^.]*)\z", 1)).isin("log", "txt")


FIELDS = ("ts", "level", "message_key", "latency_ms", "is_malformed")


def parsed(line: Column) -> Column:
    """The struct of a line's FIELDS; a malformed line has null in all but the last."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def fields(x: Column) -> Column:
        ok = x["ts"].isNotNull()
        of = lambda i: F.get(x["parts"], F.lit(i))
        return F.struct(x["ts"].alias("ts"), F.when(ok, level_of(of(1))).alias("level"), F.when(ok, of(2)).alias("message_key"), F.when(ok, latency_of(x["text"])).alias("latency_ms"), (~ok).alias("is_malformed"))

    # a line has two spaces at least, and its third token ends at the next one
    split = let(text_of(line), lambda t: F.struct(t.alias("text"), F.split(t, " ", 4).alias("parts")))
    stamped = let(split, lambda x: F.struct(x["text"].alias("text"), x["parts"].alias("parts"), F.when(F.size(x["parts"]) >= 3, timestamp_of(F.get(x["parts"], F.lit(0)))).alias("ts")))
    return let(stamped, fields)


def with_parsed(lines, line: str = "line"):
    """The rows with ts, level, message_key, latency_ms and is_malformed; malformed lines have null in the other four.

    The fields come out of a generator, which the optimiser neither repeats for each use of a field nor moves filters through:
    each line is parsed once.
    """
    others = [c for c in lines.columns if c not in FIELDS]
    return lines.select(*others, F.inline(F.array(parsed(F.col(line)))))


