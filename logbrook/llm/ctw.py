"""Language-model scores by context-tree weighting over bytes.

Texts are bytes with A-Z in lower case, closed by an end byte. Each byte is eight binary decisions; every
decision has a tree of contexts, the 0 to DEPTH bytes before it, whose nodes hold Krichevsky-Trofimov
estimates. A node's weighted probability is half its own estimate's and half the product of its children's; the
mixture over all depths gives each byte's code length.

The model is what the training texts' byte sequences of length DEPTH + 1 counted to; it grows with them
and is never held in one place. Documents lie in blocks of about BLOCK bytes. A block asks for the
sequences and words that occur in it, each once; counts are summed per sequence, trees are
built for each pair of context bytes (at most 2^24 sequences each), and the answers go back to
the blocks. Only the trees' two top levels, at most 2^16 nodes, reach the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

DEPTH, BLOCK, SLICE = 4, 16_000_000, 400_000
UNMERGED = 8  # tables of counts at once
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\xff"  # never in UTF-8
GRAM, WORD = 0, 1
MISSING = 0.1


def slices(table: pa.Table):
    """(first row, rows' lower-cased bytes, held-out flags) of about SLICE bytes each."""
    at, first, texts, flags = 0, 0, [], []
    for batch in table.to_batches(max_chunksize=1024):
        for text, held in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held_out").to_pylist()):
            texts.append((text or b"").translate(LOWER))
            flags.append(held)
            at += len(texts[-1])
            if at > SLICE:
                yield first, texts, flags
                first, at, texts, flags = first + len(texts), 0, [], []
    if texts:
        yield first, texts, flags


def grams(texts: list[bytes]):
    """Codes of the DEPTH + 1 bytes that end at each byte and end of each text, and how many each text has."""
    import numpy as np

    gap = END * DEPTH
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    codes = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        codes = (codes << 8) | data[k : k + len(codes)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.cumsum(sizes + DEPTH - 1) - (DEPTH - 1)  # past each text's end; what follows up to the next text is padding
    keep = np.ones(len(codes), bool)
    for j in range(DEPTH - 1):
        keep[(stops + j)[stops + j < len(keep)]] = False
    return codes[keep], sizes


def summed(codes: list, counts: list):
    """Distinct codes in order, with the sums of their counts."""
    import numpy as np

    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    return codes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def trim() -> None:
    """Give unused memory back: workers serve many groups, and what they hold counts against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def word_code(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(word, 0)
    return x - (1 << 64) if x >> 63 else x


def asked(key: tuple, table: pa.Table) -> pa.Table:
    """One row for each sequence and word of a block, with its count in the block's training texts."""
    import numpy as np
    from collections import Counter

    trim()
    codes, counts, words, others = [], [], Counter(), set()
    for _, texts, held in slices(table):
        found, sizes = grams(texts)
        train = np.repeat(~np.array(held, bool), sizes)
        for these, known in ((found[train], True), (found[~train], False)):
            u, n = np.unique(these, return_counts=True)
            codes.append(u)
            counts.append(n * known)
        if len(codes) > UNMERGED:
            codes, counts = ([x] for x in summed(codes, counts))
        for text, out in zip(texts, held):
            (others if out else words).update(text.split())
    code, count = summed(codes, counts)
    for word in others:
        words.setdefault(word, 0)
    theirs = np.fromiter(map(word_code, words), np.int64, len(words))
    word, times = summed([theirs], [np.fromiter(words.values(), np.int64, len(words))])
    block = key[0].as_py()
    n, m = len(code), len(word)
    return pa.table({"block": pa.array(np.full(n + m, block)), "kind": pa.array(np.r_[np.full(n, GRAM), np.full(m, WORD)].astype(np.int32)), "code": pa.array(np.r_[code, word]), "train": pa.array(np.r_[count, times])})


def log_gamma(x):
    """ln of the gamma function of positive numbers: Stirling's series after eight steps of the recurrence."""
    import numpy as np

    y = x + 8
    steps = np.ones_like(y)
    for k in range(8):
        steps *= x + k
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.918938533204672741780329736406 + series - np.log(steps)


def log_estimate(zeros, ones):
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    import math

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def decisions(codes):
    """The eight decisions of each code's last byte: (sequence with the byte replaced by the decision's node, bit)."""
    import numpy as np

    last = codes & 255
    k = np.arange(8)
    nodes = (1 << k) | (last[:, None] >> (8 - k))
    return (codes[:, None] & ~np.int64(255)) | nodes, (last[:, None] >> (7 - k)) & 1


class Trees:
    """Nodes of the depths `top`..DEPTH for the sequences of one pair of context bytes."""

    def __init__(self, codes, counts, top: int = 2) -> None:
        import numpy as np

        self.levels, self.top = {}, top
        keys, bits = decisions(codes)
        keys, weights = keys.ravel(), np.repeat(counts, 8).astype(float)
        ones, log_below = weights * bits.ravel(), None
        weights = weights - ones
        for depth in range(DEPTH, top - 1, -1):
            own = keys & ((1 << 8 * (depth + 1)) - 1)
            unique, at = np.unique(own, return_inverse=True)
            zeros, ones = (np.bincount(at, x, len(unique)).astype(float) for x in (weights, ones))
            log_own = log_estimate(zeros, ones)
            log_weighted = log_own if log_below is None else np.log(0.5) + np.logaddexp(log_own, np.bincount(at, log_below, len(unique)))
            stop = np.ones(len(unique)) if log_below is None else np.exp(np.log(0.5) + log_own - log_weighted)
            self.levels[depth] = (unique, zeros, ones, stop)
            keys, weights, log_below = unique, zeros, log_weighted
        self.log_weighted = log_below

    def probability(self, keys, bits):
        """Of each decision, as seen from depth `top`."""
        import numpy as np

        p = np.full(keys.shape, 0.5)
        for depth in range(DEPTH, self.top - 1, -1):
            unique, zeros, ones, stop = self.levels[depth]
            own = keys & ((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(unique, own), max(len(unique) - 1, 0))
            if not len(unique):
                continue
            seen = unique[at] == own
            estimate = (np.where(bits == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            p = np.where(seen, stop[at] * estimate + (1 - stop[at]) * p, 0.5)
        return p


def summary(key: tuple, table: pa.Table) -> pa.Table:
    """What a pair of context bytes adds to the nodes of depth 1: counts and ln of its trees' weighted probability."""
    codes, counts = table.column("code").to_numpy(), table.column("n").to_numpy()
    trees = Trees(codes[counts > 0], counts[counts > 0])
    unique, zeros, ones, _ = trees.levels[2]
    return pa.table({"node": unique & 0xFFFF, "zeros": zeros, "ones": ones, "log_weighted": trees.log_weighted})


def top_levels(rows: list) -> dict[int, tuple]:
    """Dense arrays over (byte before, node) and (node) of counts and stopping weights, from the summaries."""
    import numpy as np

    zeros, ones, below = (np.zeros(1 << 16) for _ in range(3))
    for r in rows:
        zeros[r["node"]], ones[r["node"]], below[r["node"]] = r["zeros"], r["ones"], r["log_weighted"]
    levels = {}
    for depth in (1, 0):
        own = log_estimate(zeros, ones)
        weighted = np.where(zeros + ones > 0, np.log(0.5) + np.logaddexp(own, below), 0.0)
        levels[depth] = (zeros, ones, np.exp(np.log(0.5) + own - weighted))
        zeros, ones, below = (x.reshape(-1, 256).sum(axis=0) for x in (zeros, ones, weighted))
    return levels


def evaluation(top: dict[int, tuple]):
    """The function that gives each sequence log10 of its last byte's probability."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        codes, counts = table.column("code").to_numpy(), table.column("n").to_numpy()
        trees = Trees(codes[counts > 0], counts[counts > 0])
        found = np.zeros(len(codes))
        for k in range(0, len(codes), 50_000):
            keys, bits = decisions(codes[k : k + 50_000])
            p = trees.probability(keys, bits)
            for depth in (1, 0):
                zeros, ones, stop = top[depth]
                own = keys & ((1 << 8 * (depth + 1)) - 1)
                n = zeros[own] + ones[own]
                estimate = (np.where(bits == 1, ones[own], zeros[own]) + 0.5) / (n + 1)
                p = np.where(n > 0, stop[own] * estimate + (1 - stop[own]) * p, 0.5)
            found[k : k + 50_000] = np.log10(p).sum(axis=1)
        return pa.table({"kind": pa.array(np.full(len(codes), GRAM, np.int32)), "code": codes, "value": found})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scoring(total: int, distinct: int, ends: int):
    """The function that scores a block's texts from the answers to what the block asked for."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        import math
        from collections import Counter

        import numpy as np

        trim()
        kind, code, value = (answers.column(c).to_numpy() for c in ("kind", "code", "value"))
        order = np.argsort(code[kind == GRAM])
        sequences, logs = code[kind == GRAM][order], value[kind == GRAM][order]
        elsewhere = dict(zip(code[kind == WORD].tolist(), value[kind == WORD].tolist()))
        del answers, kind, code, value, order
        scale = math.log10(total + MISSING * (distinct + 1))
        unknown = math.log10(MISSING) - scale
        local: Counter = Counter()
        for _, texts, held in slices(docs):
            for text, out in zip(texts, held):
                if not out:
                    local.update(text.split())

        class Words(dict):
            def __missing__(self, word: bytes) -> float:
                n = elsewhere.get(word_code(word), local[word] if word in local else 0)
                found = self[word] = math.log10(n + MISSING) - scale if n else unknown
                return found

        words, end = Words(), (math.log10(ends + MISSING) - scale if ends else unknown)
        rows: list = []
        scores = []
        for _, texts, _ in slices(docs):
            codes, sizes = grams(texts)
            logs_here = logs[np.searchsorted(sequences, codes)]
            scores.append(np.add.reduceat(logs_here, np.r_[0, np.cumsum(sizes)[:-1]]))
            for text in texts:
                values = [words[w] for w in text.split()]
                rows.append((len(values) + 1, len(values) - values.count(unknown) + (ends > 0), sum(values) + end))
            if len(words) > 400_000:
                words.clear()
        if not rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        tokens, known, base = zip(*rows)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base), "score": np.concatenate(scores)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, tag: str = "ctw") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id as text isn't divisible by 10; a null id counts as empty text, so
    it is held out. A null text is empty: its end alone is scored. Repeated rows are learnt as often as they come.
    """
    scratch = Scratch(docs.sparkSession, tag)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spelled = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.crc32(spelled.cast("binary")) % 10 == 0).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    blocks, ends = max(1, -(-(size[0] or 0) // block)), size[1] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)))
    needs = scratch.write(rows.groupBy("block").applyInArrow(asked, "block long, kind int, code long, train long"), "asked")
    scratch.release()
    totals, summed_up = scratch.keep(needs.groupBy("kind", "code").agg(F.sum("train").alias("n")), "totals")
    words = totals.where(F.col("kind") == WORD)
    seen = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total, distinct = (seen[0] or 0) + ends, seen[1] + (ends > 0)
    pair = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    by_pair = totals.where(F.col("kind") == GRAM).select(pair.alias("pair"), "code", "n").groupBy("pair")
    parts = by_pair.applyInArrow(summary, "node long, zeros double, ones double, log_weighted double")
    top = top_levels(parts.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_weighted").alias("log_weighted")).collect())  # at most 2^16 rows
    values = by_pair.applyInArrow(evaluation(top), "kind int, code long, value double").unionByName(words.select("kind", "code", F.col("n").cast("double").alias("value")))
    values = scratch.write(values, "values")
    scratch.drop(summed_up)
    scratch.release()
    answers = needs.join(values, ["kind", "code"]).where((F.col("kind") == GRAM) | (F.col("value") != F.col("train"))).select("block", "kind", "code", "value")
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scoring(total, distinct, ends), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
