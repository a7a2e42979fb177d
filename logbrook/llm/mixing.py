"""Mixing documents of soft domains to target weights, in DataFrame operations only.

A table of labelled documents teaches a classifier (Bernoulli naive Bayes on the words and shape marks that
set a domain apart), which gives every document posteriors over the domains. Document rates from 0 to `most` are then
fitted by accelerated projected gradient steps on

    1/2 sum_k (T_k - target_k)^2 / N_k + RIDGE/2 sum_d t_d (r_d - 1)^2,   T_k = sum_d r_d t_d p_dk,

with t_d tokens, p_dk posteriors and N_k the domain's tokens at rate 1. A step needs the K sums T_k only. A document's rate after n steps
follows from its posteriors and the n gradients, so rates are computed where documents lie, without a join; steps run over
the distinct posteriors (rounded to three digits) with their token totals. Texts are read once for the posteriors, which are written with the tokens.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import Scratch

#: Bound on the labelled rows that the classifier is fitted on (in expectation, chosen by a hash of their ids).
SAMPLE = 50_000
LEAST_Z, LEAST_COUNT, LEAST_RATIO = 5.0, 5, 3.0
#: Up to INLINE features lie in the expression that rates a text; more (texts that recur make rare words significant) stay a table, which
#: is joined, by broadcast up to BROADCAST_ROWS. Its weights are counted in units of 1 / UNIT, so that sums don't depend on their order.
INLINE, BROADCAST_ROWS, UNIT = 4096, 100_000, 1 << 26
RIDGE, STEPS, TOLERANCE = 0.001, 60, 2e-4


def features(text: Column) -> Column:
    """Distinct lower-case words and marks for the text's shape (#name and level); classes are of ASCII, which is cheap."""
    return let(words_of(text), lambda w: let(F.array_distinct(w), lambda d: F.concat(F.array_remove(d, ""), marks(text, w, d))))


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


def marks(text: Column, words: Column, distinct: Column) -> Column:
    """How many of the characters are capitals and signs, and how many of the words are repeats."""
    level = lambda name, share: F.concat(F.lit(f"#{name}"), F.when(share < 0.02, "0").when(share < 0.1, "1").when(share < 0.3, "2").otherwise("3"))
    size = F.greatest(F.length(text), F.lit(1))
    others = lambda pattern: (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))) / size
    again = let(F.size(words), lambda n: 1 - F.size(distinct) / F.greatest(n, F.lit(1)) - 0.4)
    return F.array(level("again", again), level("upper", others("[A-Z]+")), level("sign", others(r"[!-+\-/:-@\[-`{-~]+")))


def tokens(text: Column) -> Column:
    """One more than the text's spaces and line ends; none if it has nothing else."""
    gaps = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(gaps == F.octet_length(text), 0).otherwise(gaps + 1).cast("long")


class Classifier:
    """Domains in order, log odds without any feature, and each chosen feature's change of them, here or in a table (feature, changes)."""

    def __init__(self, domains: list[str], base: list[float], weights: dict[str, list[float]], table: DataFrame | None = None) -> None:
        self.domains, self.base, self.weights, self.table = domains, base, weights, table

    def rated(self, docs: DataFrame, text: Column) -> DataFrame:
        """docs with mix_posteriors added."""
        if self.table is None:
            return docs.select("*", self.posteriors(text).alias("mix_posteriors"))
        keys = [F.xxhash64(text).alias("mix_k1"), F.hash(text, F.length(text)).alias("mix_k2")]
        known = F.broadcast(self.table) if self.table.count() <= BROADCAST_ROWS else self.table.hint("shuffle_merge")
        # every row has the feature "#" once: rows of one text have n times its sums
        found = docs.select(*keys, F.explode(F.array_append(features(text), "#")).alias("feature")).join(known, "feature")
        sums = found.groupBy("mix_k1", "mix_k2").agg(F.sum(F.when(F.col("feature") == "#", 1)).alias("n"), *[F.sum(F.get("changes", F.lit(k))).alias(f"s{k}") for k in range(len(self.domains))])
        logs = F.array(*[F.lit(b) + F.col(f"s{k}") / F.col("n") / float(UNIT) for k, b in enumerate(self.base)])
        rated = sums.select("mix_k1", "mix_k2", self._shares(logs).alias("mix_posteriors"))
        return docs.select("*", *keys).join(rated, ["mix_k1", "mix_k2"]).drop("mix_k1", "mix_k2")

    def _shares(self, logs: Column) -> Column:
        odds = let(logs, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
        return self._rounded(odds)

    def _rounded(self, odds: Column) -> Column:
        return let(odds, lambda v: F.transform(v, lambda x: F.round(x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y), 3)))

    def posteriors(self, text: Column) -> Column:
        """Array of posteriors in the domains' order, rounded to three digits."""
        if not self.domains:
            return F.array().cast("array<double>")
        if not self.weights:
            top = max(self.base)
            return self._rounded(F.array(*[F.lit(math.exp(b - top)) for b in self.base]))
        else:
            table, size = self._table()
            of = lambda w: F.element_at(F.get(table, F.pmod(F.crc32(w), F.lit(size)).cast("int")), w)
            # each distinct word is looked up: a set of all features for every text would cost more
            found = lambda names: F.filter(F.transform(names, of), lambda v: v.isNotNull())
            here = let(words_of(text), lambda w: let(F.array_distinct(w), lambda d: found(F.concat(d, marks(text, w, d)))))
            zero = F.array(*[F.lit(b) for b in self.base])
            logs = F.aggregate(here, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
            return self._shares(logs)

    def _table(self) -> tuple[Column, int]:
        """The features' weights in buckets by checksum (maps are searched from their start), and the number of buckets."""
        size = 1 << len(self.weights).bit_length()
        spell = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
        pair = lambda w, v: f"{spell(w)}, array({', '.join(f'{float(x)!r}D' for x in v)})"
        buckets = [[pair("", [0.0] * len(self.domains))] for _ in range(size)]  # no feature is empty
        for w, v in self.weights.items():
            buckets[zlib.crc32(w.encode()) % size].append(pair(w, v))
        table = "array(" + ", ".join(f"map({', '.join(b)})" for b in buckets) + ")"
        return F.expr(table), size


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", domain_col: str = "domain", sample: int = SAMPLE, tag: str = "mixing") -> Classifier:
    """A classifier from labels (id, domain). An id with several labels has the least; null ids and domains don't count."""
    named = labels.where(F.col(domain_col).isNotNull() & F.col(label_id).isNotNull())
    named = named.groupBy(F.col(label_id).alias("labelled")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    share = min(1.0, sample / max(1, named.count()))
    chosen = named.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(1_000_000 * share))
    # chosen is bounded by `sample` whatever the tables' sizes
    texts = docs.select(F.col(id_col).alias("its_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("its_text"))
    known = texts.join(F.broadcast(chosen), F.col("its_id") == F.col("labelled")).select("domain", "its_text")
    counts = known.select("domain", F.explode(F.array_append(features(F.col("its_text")), "#")).alias("feature")).groupBy("feature", "domain").agg(F.count("*").alias("n"))
    scratch = Scratch(docs.sparkSession, tag)
    counts = scratch.write(counts, "features")
    sizes = {r["domain"]: r["n"] for r in counts.where("feature = '#'").collect()}  # one row for each domain
    domains = sorted(sizes)
    if len(domains) < 2:
        return Classifier(domains, [0.0] * len(domains), {})
    total = sum(sizes.values())
    wide = counts.where(F.col("feature") != "#").groupBy("feature").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    telling = F.lit(False)
    for k, d in enumerate(domains):
        inside, outside, mean = F.col(f"n{k}") / sizes[d], (F.col("all") - F.col(f"n{k}")) / (total - sizes[d]), F.col("all") / total
        z = (inside - outside) / F.sqrt(mean * (1 - mean) * (1 / sizes[d] + 1 / (total - sizes[d])) + 1e-12)
        telling = telling | ((F.round(z, 6) >= LEAST_Z) & (F.col(f"n{k}") >= LEAST_COUNT) & (inside >= LEAST_RATIO * outside))
    telling = scratch.write(wide.where(telling).drop("all"), "telling")  # all that are significant
    base = [math.log(sizes[d] / total) for d in domains]
    if telling.count() > INLINE:
        share = [(F.col(f"n{k}") + 0.5) / (sizes[d] + 1) for k, d in enumerate(domains)]
        units = lambda x: F.round(x * float(UNIT)).cast("long")
        without = telling.agg(*[F.sum(units(F.log(1 - p))) for p in share]).first()
        weights = telling.select("feature", F.array(*[units(F.log(p) - F.log(1 - p)) for p in share]).alias("changes"))
        none = weights.limit(1).select(F.lit("#").alias("feature"), F.array_repeat(F.lit(0).cast("long"), len(domains)).alias("changes"))
        return Classifier(domains, [b + n / UNIT for b, n in zip(base, without)], {}, scratch.write(weights.unionByName(none), "weights"))
    weights = {}
    for word, *counted in sorted(telling.collect()):
        p = [(n + 0.5) / (sizes[d] + 1) for n, d in zip(counted, domains)]
        base = [b + math.log(1 - x) for b, x in zip(base, p)]
        weights[word] = [math.log(x) - math.log(1 - x) for x in p]
    return Classifier(domains, base, weights)


class Rates:
    """Document rates as a function of posteriors: the gradient steps taken so far, from rate 1."""

    def __init__(self, classes: int, most: float = 1.0) -> None:
        self.classes, self.most, self.steps = classes, most, []

    def of(self, posteriors: Column, extrapolated: bool = False) -> Column:
        """The rates after all steps; extrapolated, the point at which the next gradient is taken."""
        if not self.steps:
            return F.lit(1.0)
        numbers = lambda g: ", ".join(f"{float(x)!r}D" for x in g)
        steps = F.expr("array(" + ", ".join(f"named_struct('g', array({numbers(g)}), 'm', {numbers([m])})" for g, m in self.steps) + ")")  # one expression: quick to build
        start = F.struct(F.lit(1.0).alias("at"), F.lit(1.0).alias("r"))  # at: the extrapolated point

        def walk(p: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                pull = F.lit(0.0)
                for k in range(self.classes):
                    pull = pull + F.get(p, F.lit(k)) * F.get(x["g"], F.lit(k))
                after = F.least(F.lit(self.most), F.greatest(F.lit(0.0), s["at"] - (pull + RIDGE * (s["at"] - 1.0)) / (1.0 + RIDGE)))
                return let(after, lambda r: F.struct((r + x["m"] * (r - s["r"])).alias("at"), r.alias("r")))

            return F.aggregate(steps, start, step)["at" if extrapolated else "r"]

        return let(posteriors, walk)  # computed once, not at each step


def fit_rates(totals: DataFrame, targets: list[float], natural: list[float], most: float = 1.0) -> Rates:
    """Rates up to `most` for totals (p, tokens) whose expected tokens per domain come nearest to the targets; natural: those at rate 1.

    In the metric of the documents' tokens a step of 1 / (1 + RIDGE) is safe, as posteriors sum to one.
    """
    rates, k = Rates(len(targets), most), len(targets)
    before, momentum = None, 1.0
    for _ in range(STEPS if k else 0):
        sums = totals.select("p", "tokens", rates.of(F.col("p"), extrapolated=True).alias("rate"))
        sums = sums.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(i))) for i in range(k)]).first()
        gradient = [round(((t or 0.0) - target) / max(n, 1.0), 9) for t, target, n in zip(sums, targets, natural)]
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        rates.steps.append((gradient, (momentum - 1) / after))
        momentum = after
        if before is not None and max(abs(a - b) for a, b in zip(gradient, before)) < TOLERANCE:
            break
        before = gradient
    return rates


def targets_for(natural: list[float], shares: list[float], total: float, most: float) -> list[float]:
    """Tokens for each domain: its share of the total, but no more than `most` times what it has; what scarce domains can't give goes to the others."""
    wanted, left = [0.0] * len(natural), {k for k, s in enumerate(shares) if s > 0}
    while left:
        rest = total - sum(wanted)
        scale = rest / sum(shares[k] for k in left)
        scarce = {k for k in left if shares[k] * scale > most * natural[k]}
        for k in scarce or left:
            wanted[k] = most * natural[k] if scarce else shares[k] * scale
        left = left - scarce if scarce else set()
    return wanted


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", domain_col: str = "domain", most: float = 1.0, total: float | None = None, whole: tuple[str, ...] = (), learn: DataFrame | None = None, sample: int = SAMPLE, tag: str = "mixing") -> tuple[DataFrame, list[str]]:
    """docs with posteriors, n_tokens, rate and copies added (names prefixed mix_), and the domains' order.

    Targets are the weights (0 for a domain without one) times `total`, by default the tokens of the domains with a
    weight. Rates go up to `most`; a domain that hasn't its share even at that rate gives all it has and the others the rest in
    proportion, so a scarce domain never shrinks the whole. With domains named in `whole` these are asked for all that they
    have, and the weights only bound the others, in proportion to them. The
    classifier is fitted on `learn` if given, else on docs, of which a stage before may have taken most of a domain.
    Copies are the rate, rounded up or down by a hash of id and text so that they are right in expectation. A null or empty
    text has no tokens and a rate by its posteriors; without labels every rate is 1; repeated rows are rated alike; an empty table
    gives no rows. Columns of docs other than mix_* may have any names.
    """
    scratch = Scratch(docs.sparkSession, tag)
    classifier = fit(docs if learn is None else learn, labels, id_col, text_col, label_id, domain_col, sample, tag)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mixed = classifier.rated(docs, text).select("*", tokens(text).alias("mix_tokens"), (F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(1 << 30)) / float(1 << 30)).alias("mix_chance"))
    mixed = scratch.write(mixed, "posteriors")
    totals = scratch.write(mixed.groupBy(F.col("mix_posteriors").alias("p")).agg(F.sum("mix_tokens").alias("tokens")), "totals")
    k = len(classifier.domains)
    sums = totals.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(k)]).first() if k else []
    natural = [n or 0.0 for n in sums]
    wanted = [max(0.0, weights.get(d, 0.0)) for d in classifier.domains]
    share = [w / sum(wanted) for w in wanted] if sum(wanted) else wanted
    kept = [(n, s) for d, n, s in zip(classifier.domains, natural, share) if d in whole]
    if kept:
        budget = sum(n for n, _ in kept) / max(sum(s for _, s in kept), 1e-9)
        targets = [n if d in whole else min(n, s * budget) for d, n, s in zip(classifier.domains, natural, share)]
    else:
        targets = targets_for(natural, share, sum(n for n, s in zip(natural, share) if s) if total is None else total, most)
    rates = fit_rates(totals, targets, natural, most) if sum(wanted) else Rates(k)
    mixed = mixed.select("*", rates.of(F.col("mix_posteriors")).alias("mix_rate"))
    return mixed.select("*", F.floor(F.col("mix_rate") + F.col("mix_chance")).cast("int").alias("mix_copies")).drop("mix_chance"), classifier.domains


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: quality and toxicity together name a domain."""
    return labels.select("doc_id", F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic"))).alias("domain"))


#: Production weights: good and clean text, little of low quality, nothing toxic; a scarce domain is repeated up to four times.
WEIGHTS, MOST = {"q1t0": 0.97, "q0t0": 0.03}, 4.0
#: What the pipeline keeps whole.
WHOLE = ("q1t0",)
