"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a file is a row (path, text). Its blob is the SHA-256 of the text, so that a text
under many paths, or the same in many versions, is one blob. The ledger holds, for each blob and
each rule at its version, the spans found (possibly none). A scan reads only blobs for which
some rule at its present version is missing from the ledger, runs just those rules, and joins
all findings back to every path.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: kind, version, pattern, least length, the group whose length counts; the first three are the base kinds, in order.
RULES = (
    ("assign", 1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", 1, r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", 1, r"[0-9a-f]{32,}", 32, 0),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0),
    ("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


def spans_of(rule: tuple, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points, end exclusive, without those that are too short.

    A whole run of hex digits is one match, so asking for 32 digits in the pattern finds the same runs.
    """
    _, _, pattern, least, group = rule
    import re

    return [m.span() for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]


#: Every match of a rule holds one of these, whatever its case (lower) or as it is.
HINTS = {"assign": ("pass", "secret", "token", "api"), "access": ("AKIA",), "pem": ("-----BEGIN ",), "forge": ("gh",), "jwt": ("eyJ",)}


def scan_batches(rules: tuple):
    """(blob, text, pending kinds) -> one row per pending kind with its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {rule[0]: rule for rule in rules}
        kind_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, rows = batch.slice(k, 256), []
                for blob, text, kinds in zip(*(c.to_pylist() for c in part.columns)):
                    text = text or ""
                    low = text.lower()
                    for kind in kinds:
                        seen = low if kind == "assign" else text
                        there = kind not in HINTS or any(hint in seen for hint in HINTS[kind])
                        found = spans_of(by[kind], text) if there else []
                        rows.append((blob, kind, by[kind][1], [{"start": a, "end": b} for a, b in found]))
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), kind_type))], ["blob", "kind", "version", "spans"])

    return run


def scan(history: DataFrame, ledger: DataFrame | None = None, path_col: str = "path", text_col: str = "text", rules: tuple = RULES, tag: str = "secrets") -> tuple[DataFrame, DataFrame]:
    """(path, blob, found) for every row of history, and the ledger's new rows.

    found is an array of (start, end, kind) of all rules, sorted by start, then by the rules' order.
    A null text is empty; repeated rows and null paths keep a row each; an empty history gives no rows.
    Append the new rows to the ledger to make the next scan incremental.
    """
    scratch = Scratch(history.sparkSession, tag)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = history.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = scratch.write(rows.select("path", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path"))  # one path for each blob stands for all
    wanted = F.array(*[F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).alias("version")) for r in rules])
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # at most one for each rule version
        unseen = unseen.join(done, "blob", "left")
        kinds = F.transform(F.filter(wanted, lambda r: ~F.coalesce(F.array_contains(F.col("done"), r), F.lit(False))), lambda r: r["kind"])
    else:
        kinds = F.transform(wanted, lambda r: r["kind"])
    unseen = unseen.select("blob", "path", kinds.alias("kinds")).where(F.size("kinds") > 0)
    to_scan = rows.join(unseen.withColumnRenamed("blob", "its"), (F.col("blob") == F.col("its")) & rows["path"].eqNullSafe(unseen["path"]))
    fresh = to_scan.select("blob", "text", "kinds").mapInArrow(scan_batches(rules), LEDGER)
    fresh = scratch.write(fresh, "fresh").dropDuplicates(["blob", "kind", "version"])  # a path and text given twice is scanned twice
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "kind", "version", "spans"))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r[0], k)])
    current = reduce(lambda a, b: a | b, [(F.col("kind") == r[0]) & (F.col("version") == r[1]) for r in rules])
    hits = known.where(current & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))))).alias("found"))
    hits = hits.select("blob", F.transform(F.array_sort("found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"))
    none = F.array().cast("array<struct<start:long,end:long,kind:string>>")
    return paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("found")), fresh


def digest(found: DataFrame) -> DataFrame:
    """The result columns of a scan, one row for each row of it."""
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(kind) for kind in BASE], F.sha2(spell(base).cast("binary"), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))
