"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gets counts in one pass over its rows. Two plain rules come first. Among the rows that
pass them, each language and source has a minimum-covariance-determinant estimate of the transformed counts:
from a start at the coordinates' medians and quartiles, concentration steps keep the three quarters of rows
nearest to the centre and take their mean and covariance anew. Rows beyond CUT in squared Mahalanobis
distance are rejected.

A language and source with too few rows for an estimate is judged by that of its language over all sources,
and if that has too few as well, by that of all rows.

All that is gathered per group are counts on a fixed grid and sums of products, combined map-side, so a
group with a third of all rows costs no task more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import NON_SPACE, SPACE, Scratch

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Standard deviations below which a coordinate's spread is not taken to fall: shares are zero in most texts.
FLOORS = (0.35, 0.12, 0.2, 0.012, 0.06, 0.08)
DIM, STEPS, NEAREST, LEAST_GROUP = len(FLOORS), 3, 0.75, 50
#: The median of chi-squared with 6 degrees of freedom (fixed value), and the rejection distance.
MEDIAN_CHI2, CUT = 5.348, 45.0
KEYS = ("its_lang", "its_source")
#: Estimates are of a language and source (level 0), a language (1) and all rows (2); keys that don't apply are empty.
LEVELS = ("level", *KEYS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of `width` words found twice or more in the array, the first find included.

    Windows are compared by 64-bit hashes. Texts without a repeated hash end there; else the sorted
    (hash, place) pairs show the places of repeated windows, and the union of those windows is measured.
    """
    hashes = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == F.get(s, k)["h"])
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            return F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))

        def union(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(width)).otherwise(F.least(F.lit(width), F.get(p, k + 1) - x)))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(pairs, places), union)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(text: Column) -> Column:
    """The struct of COUNTS and n_distinct, n_upper."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NON_SPACE))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    whole = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).cast("long").alias("n_repeat_words")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(whole, lambda c: F.struct(c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), c["n_distinct"].alias("n_distinct"), upper.cast("long").alias("n_upper")))


def with_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, columns: list[Column]) -> DataFrame:
    """`columns`, COUNTS, base_failed, the group's keys and the coordinates x0.. (null where base_failed)."""
    rows = docs.select(*columns, F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00")).alias(KEYS[0]), F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias(KEYS[1]), counted(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("its"))
    names = [c for c in rows.columns if c != "its"]
    n, failed = F.col("its.n_words"), (F.col("its.n_words") < LEAST_WORDS) | (100 * F.col("its.n_repeat_words") > MOST_REPEATED * F.col("its.n_words"))
    xs = [F.log(n), F.log(F.col("its.word_chars") / n), F.log(F.col("its.n_distinct")), F.col("its.n_symbols") / F.col("its.word_chars"), F.col("its.n_repeat_words") / n, F.col("its.n_upper") / F.col("its.word_chars")]
    return rows.select(*names, *[F.col(f"its.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), *[F.when(~failed, x).alias(f"x{i}") for i, x in enumerate(xs)])


def quantiles(values: DataFrame, keys: list[str], value: str, step: float, shares: dict[str, float]) -> DataFrame:
    """keys and the named quantiles of a column on a grid: counts of grid cells, then their running sums."""
    cells = values.groupBy(*keys, F.floor(F.col(value) / step).alias("cell")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy("cell")
    seen = cells.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    reached = [F.min(F.when(F.col("upto") >= share * F.col("total"), (F.col("cell") + 1) * step)).alias(name) for name, share in shares.items()]
    return seen.groupBy(*keys).agg(*reached, F.max("total").alias("size"))


def distance(factor: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from the group's m0.., under the Cholesky factor l00.. ."""
    solved: list[Column] = []
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def factored(moments: DataFrame) -> DataFrame:
    """keys, size, m0.. and the Cholesky factor of c00.. with the floors' squares added to the diagonal."""
    for i in range(DIM):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            moments = moments.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return moments.select(*LEVELS, "size", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)])


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per group of each level with at least LEAST_GROUP rows: centre and Cholesky factor."""
    none = F.lit("")
    groups = F.array(*[F.struct(F.lit(k).alias("level"), lang.alias(KEYS[0]), source.alias(KEYS[1])) for k, (lang, source) in enumerate(((F.col(KEYS[0]), F.col(KEYS[1])), (F.col(KEYS[0]), none), (none, none)))])
    xs = [f"x{i}" for i in range(DIM)]
    points = rows.where(~F.col("base_failed")).select(F.explode(groups).alias("group"), *xs).select("group.*", *xs)
    each = points.select(*LEVELS, F.posexplode(F.array(*[f"x{i}" for i in range(DIM)])).alias("axis", "x"))
    start = quantiles(each, [*LEVELS, "axis"], "x", 1 / 256, {"low": 0.25, "mid": 0.5, "high": 0.75}).where(F.col("size") >= LEAST_GROUP)
    spread = (F.col("high") - F.col("low")) / 1.349
    at = lambda i, c: F.max(F.when(F.col("axis") == i, c))
    start = start.groupBy(*LEVELS).agg(F.max("size").alias("size"), *[at(i, F.col("mid")).alias(f"m{i}") for i in range(DIM)], *[(at(i, spread * spread) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)])
    now = scratch.write(factored(start), "start")
    for step in range(STEPS + 1):
        near = points.join(now, list(LEVELS)).withColumn("d", F.log(distance() + 1e-6))
        bounds = scratch.write(quantiles(near, list(LEVELS), "d", 1 / 64, {"bound": NEAREST, "middle": 0.5}), "bounds")
        if step == STEPS:  # the scale at which the middle distance is that of a normal distribution
            scale = F.sqrt(F.greatest(F.lit(1.0), F.exp("middle") / MEDIAN_CHI2))
            last = now.join(bounds.select(*LEVELS, scale.alias("scale")), list(LEVELS))
            return scratch.write(last.select(*LEVELS, "size", *[f"m{i}" for i in range(DIM)], *[(F.col(f"l{i}{j}") * F.col("scale")).alias(f"l{i}{j}") for i in range(DIM) for j in range(i + 1)]), "estimates")
        kept = near.join(bounds.select(*LEVELS, "bound"), list(LEVELS)).where("d <= bound")
        sums = kept.groupBy(*LEVELS).agg(F.max("size").alias("size"), F.count("*").alias("n"), *[F.sum(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"s{i}") for i in range(DIM)], *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)], *[F.sum((F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))).alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)])
        n = F.col("n")
        moments = sums.select(*LEVELS, "size", *[(F.col(f"m{i}") + F.col(f"s{i}") / n).alias(f"m{i}") for i in range(DIM)], *[(F.col(f"p{i}{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)])
        now = scratch.write(factored(moments), "concentrated")
    raise AssertionError


def resolved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """For each language and source the estimate of the least level that has one; without any the group isn't in it."""
    of = F.struct("level", *[c for c in found.columns if c not in LEVELS])
    own, lang, every = (found.where(F.col("level") == k).select(*KEYS, of.alias(f"of{k}")) for k in range(3))
    groups = rows.select(*KEYS).distinct().join(own, list(KEYS), "left").join(lang.drop(KEYS[1]), KEYS[0], "left").join(every.select("of2"), F.lit(True), "left")
    return groups.select(*KEYS, F.coalesce("of0", "of1", "of2").alias("of")).select(*KEYS, "of.*").where("level IS NOT NULL")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = (), tag: str = "quality") -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, kept, distance, and `carry`.

    A null text has no words and fails; null languages and sources are groups of their own. Groups with fewer than
    LEAST_GROUP rows are judged by their language's estimate, or that of all rows (the two rules alone decide only if
    all rows are fewer); distance is that from the group's own estimate and null where it has none. Repeated rows count as often as they come.
    """
    scratch = Scratch(docs.sparkSession, tag)
    columns = [F.col(id_col).alias("its_id"), *[F.col(c).alias(f"carried_{c}") for c in carry]]
    rows = scratch.write(with_counts(docs, text_col, lang_col, source_col, columns), "counts")
    found = scratch.write(resolved(rows, estimates(rows, scratch)), "resolved")
    judged = rows.join(found, list(KEYS), "left").withColumn("far", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce("far", F.lit(0.0)) <= CUT)
    judged = judged.withColumn("distance", F.when(F.col("level") == 0, F.col("far")))
    return judged.select(F.col("its_id").alias("doc_id"), *COUNTS, "base_failed", kept.alias("kept"), "distance", *[F.col(f"carried_{c}").alias(c) for c in carry if c != id_col])
