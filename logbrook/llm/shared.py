"""What the training-data operators share: scratch tables, table loading, graph components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The driver's Parquet table, read by Spark so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only where that is unset (local runs, tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    made = getattr(sc, "_logbrook_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="logbrook-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        sc._logbrook_scratch = made
    return f"file://{made}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and outlive executors."""

    #: Those made so far, by the part of the tag before "/".
    made_for: dict[str, list[Scratch]] = {}

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.made_for.setdefault(tag.split("/")[0], []).append(self)
        self.spark, self.root = spark, f"{shared_dir(spark)}/logbrook/{tag}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    @classmethod
    def clear_all(cls, owner: str) -> None:
        """Remove the tables made for an owner whose results are all written."""
        for scratch in cls.made_for.pop(owner, []):
            scratch.clear()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(df, name)[0]

    def keep(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The table as read again, and its path."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps, which it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str) -> None:
        delete(self.spark, path)

    def clear(self) -> None:
        delete(self.spark, self.root)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), by alternating large-star and small-star rounds.

    Returns (node, root), root being the least node that node reaches, for every node
    of an edge between two different nodes. Rounds are logarithmic in the number of nodes;
    each aggregates a minimum with map-side combining and joins it back, so that a node
    with very many neighbours is neither gathered in one task nor sent to the driver.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, path = scratch.keep(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, between = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after, later = scratch.keep(small, "edges")
        found = _state(after)
        scratch.drop(path)
        scratch.drop(between)
        now, path = after, later
        if found == state:
            break
        state = found
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum of an edge table; equal ones mean that a round changed nothing."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
