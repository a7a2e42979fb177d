"""Packing tokenised documents into training sequences, shortest pack first over the length histogram.

Each document's ids (its text's, then one end id) are cut into pieces of the sequence length and
one rest. Only the histogram of piece lengths, at most `limit` numbers, reaches the driver. There
lengths are placed longest first, each into the pattern with most room left, and patterns carry counts,
so the work depends on `limit` alone. Every length step splits at most one pattern and opens at most two, hence
there are at most 3 * limit patterns of at most limit slots in all cases: the slot table that is joined
back (by broadcast) doesn't grow with the documents. Pieces meet slots by their rank among the pieces of
their length; ranks are counted in salted parts, so that one very frequent length is not one task's work.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

LIMIT, END_ID = 2048, 1
#: How the byte-level tokenizer cuts a text into pieces that are encoded on their own (fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit numbers, under a byte-level vocabulary file.

    The vocabulary and its ranks come from the file; merging runs in a faster library with
    the same result, added tokens that are spelled out in a text included (tests compare it with the file's own tokenizer).
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary's spelling
    spelled = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
    ranks = {bytes(spelled[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}
    encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added).encode
    return lambda text: array("I", encode(text, allowed_special="all")).tobytes()


def piece_batches(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode, end = encoder(path), array("I", [end_id]).tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        types = [pa.int64()] * 5 + [pa.binary()] * with_ids
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, rows = batch.slice(k, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for at in range(0, len(ids), 4 * limit):
                        data = ids[at : at + 4 * limit]
                        rows.append((doc, at // 4, len(data) // 4, crc32(data), len(ids) // 4) + (data,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; with_ids adds the ids as little-endian bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return rows.mapInArrow(piece_batches(tokenizer, limit, end_id, with_ids), schema)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, how many such packs), from the count of each length."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pack: tuple[int, ...], left: int, n: int) -> None:
        if n and left:
            at = room.setdefault(left, {})
            at[pack] = at.get(pack, 0) + n
        elif n:
            done.append((pack, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            most = max(room, default=0)
            if most < length:  # no open pack has room: as many of this length as fit share new ones
                fit = limit // length
                put((length,) * fit, limit - fit * length, n // fit)
                put((length,) * (n % fit), limit - (n % fit) * length, 1 if n % fit else 0)
                break
            pack, there = room[most].popitem()
            if not room[most]:
                del room[most]
            used = min(n, there)
            put(pack, most, there - used)
            put((*pack, length), most - length, used)
            n -= used
    return done + [(pack, n) for at in room.values() for pack, n in at.items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset) of each pattern's places."""
    rows, ranks, base = [], {}, 0
    for pack, n in found:
        offset = 0
        for length in pack:
            at = ranks.get(length, 0)
            rows.append((length, at, at + n, base, offset))
            ranks[length] = at + n
            offset += length
        base += n
    return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False, tag: str = "packing") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Pieces fill each sequence from offset 0 without gaps. A null or empty text gives one piece with the
    end id; repeated rows and rows with a null id are packed each on its own; an empty table gives no rows.
    A very long text is one row's work and is cut into pieces; columns of docs other than the two read may have any names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, tag)
    cut = scratch.write(pieces(docs, tokenizer, id_col, text_col, limit, end_id, with_ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    parts = max(64, sum(histogram.values()) >> 17)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)))
    here = F.row_number().over(Window.partitionBy("length", "part").orderBy("piece")) - 1
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.withColumn("here", here).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("here"))
    places = spark.createDataFrame(slots(patterns(histogram, limit)), "at_length long, low long, high long, base long, offset long")
    on = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(places), on).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *["ids"] * with_ids
    )
