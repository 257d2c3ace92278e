"""Quality rules: fixed rules first, then robust multivariate outliers by language and source. Column expressions only.

Each text gives counts of its words, symbols, repeated lines and repeated word windows. Transformed to five numbers they are
compared with the other documents of their language and source by a minimum-covariance-determinant estimate:

1. There are ``STARTS`` starts: the median and the quartile range of each number in its group, from counts of fixed-point
   values, and mean and covariance of shares of the group that a hash of the numbers chooses.
2. A *concentration step* takes the ``COVERAGE`` share of documents that are nearest to the centre, by Mahalanobis distance,
   and gives their mean and covariance; the determinant never grows from step to step. Each start makes ``STEPS`` of them,
   and the one of the smallest determinant is the group's estimate.
3. Documents whose squared distance is over ``CUTOFF`` go, in the end.

Each number is bounded by its making (logarithms, shares), so that its fixed-point squares stay far below 2^63 for texts and
words of any length. All sums are of whole numbers, so results do not depend on the order of tasks. The documents' numbers
are written once; groups are pre-aggregated where the rows are; their estimates, a row for each group, are broadcast while
there are few and joined by a skew-safe join else. Languages and sources of few documents are pooled: by language, then all.

Defined cases: null text has no words and fails the base rules; null language or source is a group value like any other;
a pool of under ``LEAST_GROUP`` documents rejects none, and a start whose share is empty is left out; equal documents have equal verdicts; an empty table gives an empty
table; columns of the names of results are replaced, others pass through; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import materialise, packed, unpacked
from tilewright.llm.simhash import skew_join

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COVERAGE, STEPS = 0.75, 4
#: 0.75 / P(chi2 with 7 degrees <= 75 % quantile of chi2 with 5): makes the covariance of the nearest 75 % that of all.
CONSISTENCY = 1.412
#: chi2 with 5 degrees is over this once in seventy million times.
CUTOFF = 45.0
LEAST_GROUP = 100
#: The five numbers and the least spread that each is given: without one, a group whose documents hardly differ in a number
#: (no repeated lines at all, say) would reject every document that differs in the least.
SPREADS = {"length": 0.8, "word_size": 0.05, "symbols": 0.03, "dup_lines": 0.12, "repeats": 0.12}
SCALE = 1000
#: Starts of the estimate; all but the first begin with one of so many shares of the group.
STARTS, SHARES = 3, 4
#: Steps of the histogram of log2(1 + squared distance).
DISTANCE_STEPS = 64
BROADCAST_GROUPS = 20_000
#: Keys of an estimate while it is made.
POOL = ["pool", "start"]

#: Columns of an estimate: centre and triangular factor.
ESTIMATE = [f"m{i}" for i in range(len(SPREADS))] + [f"l{i}{j}" for i in range(len(SPREADS)) for j in range(i + 1)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, ordered: Column, mask: Column) -> Column:
    """Words in windows that occur twice or more.

    ``ordered`` holds, in order, the upper bits of each window's hash with the window's place in the lower ones (``mask``);
    windows of equal upper bits stand together and are compared word by word.
    """

    def same(a: Column, b: Column) -> Column:
        p, q = (F.get(ordered, x).bitwiseAND(mask).cast("int") for x in (a, b))
        close = F.coalesce(F.get(ordered, a).bitwiseXOR(F.get(ordered, b)).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(False))
        return close & (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

    places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    return F.when(F.size(ordered) > 1, F.sort_array(F.transform(places, lambda j: F.get(ordered, j).bitwiseAND(mask)))).otherwise(F.array().cast("array<long>"))


def covered(places: Column) -> Column:
    """Words covered by windows of three that start at ``places``, ascending."""
    inner = F.aggregate(F.sequence(F.lit(0), F.size(places) - 2), F.lit(0).cast("long"), lambda a, k: a + F.least(F.lit(3).cast("long"), F.get(places, k + 1) - F.get(places, k)))
    return F.when(F.size(places) == 0, F.lit(0).cast("long")).when(F.size(places) == 1, F.lit(3).cast("long")).otherwise(inner + 3)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS and ``n_lines`` (lines with a word) instead of the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (*COUNTS, "n_lines", text_col)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim(F.col("__tw_t"), F.lit(BLANKS))
    df = docs.select(*rest, text.alias("__tw_t"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    df = df.withColumn("__tw_w", words).withColumn("__tw_l", F.filter(F.split("__tw_t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    n = F.size("__tw_w").cast("long")
    df = df.select(
        *rest,
        "__tw_w",
        n.alias("n_words"),
        F.length(F.array_join("__tw_w", "")).cast("long").alias("word_chars"),
        (F.length("__tw_t") - F.length(F.regexp_replace("__tw_t", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        F.size("__tw_l").cast("long").alias("n_lines"),
        (F.size("__tw_l") - F.size(F.array_distinct("__tw_l"))).cast("long").alias("n_dup_lines"),
        (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1).alias("__tw_mask"),
    )
    w, mask = F.col("__tw_w"), F.col("__tw_mask")

    def marked(i: Column) -> Column:
        h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

    windows = F.when(F.col("n_words") >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), marked)).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("__tw_o", F.sort_array(windows))
    df = df.withColumn("__tw_p", repeat_words(w, F.col("__tw_o"), mask))
    counts = [F.col(c) for c in COUNTS if c != "n_repeat_words"]
    return df.select(*rest, *counts, covered(F.col("__tw_p")).alias("n_repeat_words"), "n_lines")


def fixed(x: Column) -> Column:
    """A number in fixed point."""
    return F.round(x * SCALE).cast("long")


def five_numbers() -> list[Column]:
    """The transformed numbers, in the order of SPREADS."""
    some = F.greatest(F.col("n_words"), F.lit(1))
    return [
        fixed(F.log1p("n_words")).alias("length"),
        fixed(F.log1p(F.col("word_chars") / some)).alias("word_size"),
        fixed(F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))).alias("symbols"),
        fixed(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        fixed(F.col("n_repeat_words") / some).alias("repeats"),
    ]


def meet(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what a table of a row for each group has for them."""
    few = materialise(few, "groups")
    if few.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(few), keys)
    return skew_join(rows, few, keys)


def quantiles(counts: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Of histograms (keys, value, n): the smallest value that reaches each share of the rows."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__tw_run", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__tw_all", F.sum("n").over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("__tw_run") >= share * F.col("__tw_all"), F.col(value))).alias(name) for name, share in shares.items()])


def starts(rows: DataFrame) -> DataFrame:
    """Centre ``m{i}`` and triangular factor ``l{i}{j}`` of each pool and start."""
    shares = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    # read from hundredths, of which a pool's aggregate holds some thousands at most, since the numbers are bounded
    hundredths = {c: F.floor(F.col(c) * 100 / SCALE) for c in SPREADS}
    q = rows.where("start = 0").groupBy("pool", "start").agg(*[F.percentile(v, shares).alias(c) for c, v in hundredths.items()])
    cols = []
    for i, (c, least) in enumerate(SPREADS.items()):
        cols.append((F.col(c)[1] / 100).alias(f"m{i}"))
        spread = F.sqrt(F.pow((F.col(c)[2] - F.col(c)[0]) / 134.9, F.lit(2.0)) + least**2)
        cols += [(spread if i == j else F.lit(0.0)).alias(f"l{i}{j}") for j in range(i + 1)]
    chosen = F.pmod(F.xxhash64(*SPREADS), F.lit(SHARES)) == F.col("start") - 1
    return q.select("pool", "start", *cols).unionByName(concentrated(rows.where((F.col("start") > 0) & chosen)))


def concentrated(near: DataFrame) -> DataFrame:
    """Mean and the triangular factor of the covariance of the rows, by pool and start."""
    names = list(SPREADS)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = [F.sum(F.col(names[i])).alias(f"s{i}") for i in range(len(names))]
    # a number of fixed point is below 2^15 here, so decimals of 38 digits hold the sums of any table
    products = [F.sum((F.col(names[i]) * F.col(names[j])).cast("decimal(20,0)")).alias(f"p{i}{j}") for i, j in pairs]
    df = near.groupBy("pool", "start").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    means = {i: F.col(f"s{i}") / F.col("n") / SCALE for i in range(len(names))}
    df = df.select("pool", "start", *[means[i].alias(f"m{i}") for i in means], *[(F.col(f"p{i}{j}").cast("double") / F.col("n") / SCALE**2 - means[i] * means[j]).alias(f"c{i}{j}") for i, j in pairs])
    floors = list(SPREADS.values())
    for i, j in pairs:
        c = F.col(f"c{i}{j}") * CONSISTENCY
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c + F.lit(floors[i] ** 2), F.lit(floors[i] ** 2))) if i == j else c / F.col(f"l{j}{j}"))
    return df.select("pool", "start", *ESTIMATE)


def best_start(estimates: DataFrame) -> DataFrame:
    """The estimate of the smallest determinant of each pool, the earlier start of equal ones."""
    logs = F.round(sum((F.log(f"l{i}{i}") for i in range(1, len(SPREADS))), F.log("l00")), 9)
    best = estimates.groupBy("pool").agg(F.min_by(F.struct(*ESTIMATE), F.struct(logs, "start")).alias("e"))
    return best.select("pool", "e.*")


def with_distance(rows: DataFrame) -> DataFrame:
    """Rows that carry their pool's estimate, with the squared Mahalanobis distance ``d2`` instead of it."""
    own = rows.columns
    for i, c in enumerate(SPREADS):
        y = F.col(c) / SCALE - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(SPREADS))), F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", d2).select(*[c for c in own if c not in ESTIMATE], "d2")


def nearest(rows: DataFrame) -> DataFrame:
    """The COVERAGE share of each pool with the smallest distances, by a histogram of their logarithms."""
    rows = rows.withColumn("step", F.floor(F.log2(1 + F.col("d2")) * DISTANCE_STEPS))
    counts = rows.groupBy(*POOL, "step").agg(F.count(F.lit(1)).alias("n"))
    return meet(rows, quantiles(counts, "step", POOL, {"last": COVERAGE}), POOL).where(F.col("step") <= F.col("last")).drop("last", "step")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the text, with COUNTS, ``base_failed``, ``d2`` (null in pools too small to judge) and ``kept``."""
    rest = [c for c in docs.columns if c not in (*COUNTS, text_col, "base_failed", "d2", "kept")]
    marks = [F.col(f"`{c}`").alias(f"__tw_{k}") for k, c in (("lang", lang_col), ("source", source_col))]
    counted = text_counts(docs.select(packed(rest), *marks, F.col(f"`{text_col}`").alias("__tw_text")), "__tw_text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = counted.select("__tw_rest", *COUNTS, base.alias("base_failed"), F.struct(F.col("__tw_lang").alias("lang"), F.col("__tw_source").alias("source")).alias("__tw_own"), *five_numbers())
    stored = materialise(counted, "counts")
    # pools: the language and source, else the language, else all, by numbers of documents
    sizes = materialise(stored.groupBy("__tw_own").agg(F.count(F.lit(1)).alias("n")).withColumn("by", F.to_json(F.struct("__tw_own.lang"))), "sizes")
    sizes = meet(sizes, sizes.groupBy("by").agg(F.sum(F.when(F.col("n") < LEAST_GROUP, F.col("n"))).alias("rest")), ["by"])
    none = F.lit(None).cast("string")
    pool = F.when(F.col("n") >= LEAST_GROUP, F.struct(F.lit(0).alias("level"), F.col("__tw_own.lang").cast("string").alias("lang"), F.col("__tw_own.source").cast("string").alias("source")))
    pool = pool.when(F.col("rest") >= LEAST_GROUP, F.struct(F.lit(1).alias("level"), F.col("__tw_own.lang").cast("string").alias("lang"), none.alias("source")))
    pool = pool.otherwise(F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")))
    pools = sizes.select(F.to_json("__tw_own").alias("__tw_h"), F.to_json(pool).alias("pool"))
    rows = stored.withColumn("__tw_h", F.to_json("__tw_own"))
    points = materialise(meet(rows, pools, ["__tw_h"]).select("__tw_rest", *COUNTS, "base_failed", "pool", *SPREADS), "points")
    numbers = points.select("pool", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"), *SPREADS)
    estimates = starts(numbers)
    for _ in range(STEPS):
        estimates = concentrated(nearest(with_distance(meet(numbers, estimates, POOL))))
    enough = points.groupBy("pool").agg(F.count(F.lit(1)).alias("__tw_n")).join(best_start(estimates), "pool")
    judged = with_distance(meet(points, enough, ["pool"]))
    d2 = F.when(F.col("__tw_n") >= LEAST_GROUP, F.col("d2"))
    return judged.select(*unpacked(rest), *COUNTS, "base_failed", d2.alias("d2"), (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= CUTOFF)).alias("kept"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules, the verdict on every document and its squared distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "d2")
