"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest. Column expressions only.

A rule is ``host/path``; it fits its host and all subdomains if the path starts with the rule's, and the longest that fits
decides. URLs without a rule are judged by boosted trees of depth two. Features are cut into bins; each level of a tree is
grown from one table of gradient sums by node, feature and bin, aggregated from the labelled rows, of which only the sums
reach the driver. Scoring is a sum of CASE expressions.

Labels are a table of URLs and labels (1: block). Where none is given, ``listed_labels`` makes one from a blocklist of a few
whole hosts, ``LISTED``: pages of these hosts and their subdomains are labelled 1, pages that an allow rule fits and a share
of the others 0, as presumed. No feature sees a host's words, so the trees can only learn how listed URLs look, and judge
hosts that nobody listed by it; held-out hosts are the test. At most about ``MAX_LABELLED`` labelled rows, chosen by a hash
of the URL, are learned from.

Defined cases: null URLs and those without ``://`` have an empty host and path, no rule fits, and the trees judge them by
features of zero; without labels of both classes every score is the labels' mean (0 without any); URLs of any length are
read whole; repeated rows are judged alike; an empty table gives an empty table; columns of the names of results are
replaced, others pass through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialise, packed, unpacked
from tilewright.llm.simhash import skew_join

#: The rules, as verdict and host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A first blocklist, in the form of rules: whole hosts with their subdomains.
LISTED = (("block", "casino-win.example.com/"), ("block", "free-bets.example.com/"), ("block", "ads-track.example.com/"))
#: One in so many of the pages that nothing lists is presumed fine.
PRESUMED = 8

MAX_LABELLED = 20_000
BINS, TREES, RATE, RIDGE, LEAF_ROWS = 16, 12, 0.4, 1.0, 5
BLOCK_FROM = 0.5
BROADCAST_SUFFIXES = 20_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_parts", "longest_part", "hyphens", "host_digits", "digits",
    "entropy", "parameters", "marks", "suffix_length", "suffix_share",
)
PREFIX = "__tw_f_"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is put on last, so tried first
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def share_of(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))
    seen = F.transform(F.filter(each, lambda c: c != ""), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(seen, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def with_features(pages: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with ``host``, ``path`` and a DOUBLE column for each of FEATURES."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = parts(F.col(f"`{url_col}`"))
    df = pages.withColumn("host", host).withColumn("path", path)
    host, path = F.col("host"), F.col("path")
    names = F.split(host, r"\.", -1)
    numbers = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), "host_parts": F.size(names),
        "longest_part": F.array_max(F.transform(names, F.length)), "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "host_digits": share_of(host, "[0-9]+"), "digits": share_of(url, "[0-9]+"), "entropy": entropy(host),
        "parameters": F.length(url) - F.length(F.regexp_replace(url, "[&=]", "")), "marks": share_of(url, "[^A-Za-z0-9]+"),
        "suffix_length": F.length(F.element_at(names, -1)),
    }
    df = df.withColumn("__tw_suffix", F.element_at(names, -1)).withColumns({PREFIX + k: v.cast("double") for k, v in numbers.items()})
    counts = materialise(df.groupBy("__tw_suffix").agg(F.count(F.lit(1)).alias("n")), "suffixes")
    total, n_suffixes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    shares = counts.select("__tw_suffix", F.log10(F.col("n") / F.lit(total or 1)).alias(PREFIX + "suffix_share"))
    joined = df.join(F.broadcast(shares), "__tw_suffix", "left") if n_suffixes <= BROADCAST_SUFFIXES else skew_join(df, shares, "__tw_suffix", "left")
    return joined.drop("__tw_suffix")


class BoostedTrees:
    """Trees of depth two over binned features; scores as column expressions."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def score(self, value) -> Column:
        """``value(name)`` is a feature's column."""
        total = F.lit(self.base)
        for (name, cut), sides in self.trees:
            low, high = (leaf if isinstance(leaf, float) else F.when(value(leaf[0]) < leaf[1], leaf[2]).otherwise(leaf[3]) for leaf in sides)
            total = total + F.when(value(name) < cut, low).otherwise(high)
        return 1 / (1 + F.exp(-total))


def best_cut(sums: list) -> tuple[float, str, float, float, float] | None:
    """Of rows (feature, bin, upper edge, g, h, n): gain, feature, cut and the two steps of the best split."""
    best = None
    by: dict[str, list] = {}
    for r in sums:
        by.setdefault(r.feature, []).append(r)
    for feature in sorted(by):
        rows = sorted(by[feature], key=lambda r: r.bin)
        g, h, n = (math.fsum(getattr(r, k) for r in rows) for k in "ghn")
        left = [0.0, 0.0, 0.0]
        for r, after in zip(rows, rows[1:], strict=False):
            left = [left[0] + r.g, left[1] + r.h, left[2] + r.n]
            if min(left[2], n - left[2]) < LEAF_ROWS:
                continue
            gain = left[0] ** 2 / (left[1] + RIDGE) + (g - left[0]) ** 2 / (h - left[1] + RIDGE) - g * g / (h + RIDGE)
            if best is None or gain > best[0] + 1e-9:
                best = gain, feature, after.bin, RATE * left[0] / (left[1] + RIDGE), RATE * (g - left[0]) / (h - left[1] + RIDGE)
    return best if best and best[0] > 1e-6 else None


def fit_trees(labelled: DataFrame) -> BoostedTrees:
    """Trees from rows of feature columns and ``y``; rows of equal bins are added up before the first tree."""
    label = F.col("y")
    n, mean = labelled.agg(F.count(F.lit(1)), F.avg("y")).first()
    mean = mean if n else 0.0
    if not n or mean in (0.0, 1.0):
        model = BoostedTrees(-40.0 if mean == 0 else 40.0)
        return model
    edges = labelled.agg(*[F.percentile(PREFIX + f, [i / BINS for i in range(1, BINS)]).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f])) for f in FEATURES}

    # a row's bin of a feature is the largest cut that it reaches, so a bin's name is a value to compare with
    def binned(f: str) -> Column:
        return reduce(lambda a, c: F.when(F.col(PREFIX + f) >= c, F.lit(c)).otherwise(a), cuts[f], F.lit(float("-inf"))).alias(f)

    cells = materialise(labelled.select(*[binned(f) for f in FEATURES], label.alias("y")).groupBy(*FEATURES).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")), "cells")
    model = BoostedTrees(math.log(mean / (1 - mean)))
    for _ in range(TREES):
        p = model.score(F.col)
        rows = cells.withColumn("p", p).select("*", (F.col("ones") - F.col("n") * F.col("p")).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))

        def sums(rows: DataFrame) -> list:
            long = rows.select("node", "g", "h", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("x"))
            # sums of fixed point do not depend on the order of tasks
            return long.groupBy("node", F.col("x.feature").alias("feature"), F.col("x.bin").alias("bin")).agg(*[(F.sum(F.round(F.col(c) * 1e9).cast("decimal(28,0)")).cast("double") / 1e9).alias(c) for c in "gh"], F.sum("n").alias("n")).collect()

        root = best_cut(sums(rows.withColumn("node", F.lit(0))))
        if root is None:
            break
        _, name, cut, low, high = root
        found = sums(rows.withColumn("node", F.when(F.col(name) < cut, 0).otherwise(1)))
        sides = []
        for node, step in ((0, low), (1, high)):
            inner = best_cut([r for r in found if r.node == node])
            sides.append(step if inner is None else inner[1:])
        model.trees.append(((name, cut), sides))
    return model


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``score`` of the trees and ``verdict``.

    ``labels`` has the columns ``url`` and ``label`` (1: block); without it, ``listed_labels`` of the pages.
    """
    made = ("host", "path", "rule", "score", "verdict")
    rest = [c for c in pages.columns if c not in made]
    source = pages.select(packed(rest), F.col(f"`{url_col}`").alias("__tw_url"))
    featured = with_features(source, "__tw_url")
    rule, decided = fitting(F.col("host"), F.col("path"), rules)
    if labels is None:
        labelled = listed_labels(featured, rules)
    else:
        labelled = with_features(labels.select(F.col("url").alias("__tw_url"), F.col("label").cast("double").alias("y")).where("y IS NOT NULL"), "__tw_url")
    n = labelled.count()
    if n > max_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64("__tw_url"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))
    model = fit_trees(materialise(labelled.select("y", *[PREFIX + f for f in FEATURES]), "labelled"))
    score = model.score(lambda f: F.col(PREFIX + f))
    by_model = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    judged = featured.withColumn("rule", rule).withColumn("decided", decided).withColumn("score", score)
    return judged.select(*unpacked(rest), "host", "path", "rule", "score", F.coalesce("decided", by_model).alias("verdict"))


def listed_labels(featured: DataFrame, rules, listed=LISTED) -> DataFrame:
    """Rows labelled 1 by the blocklist, 0 by an allow rule or, a share of those that no rule fits, as presumed."""
    _, known = fitting(F.col("host"), F.col("path"), listed)
    _, decided = fitting(F.col("host"), F.col("path"), rules)
    presumed = decided.isNull() & (F.pmod(F.xxhash64("__tw_url"), F.lit(PRESUMED)) == 0)
    return featured.withColumn("y", F.when(known == "block", 1.0).when((decided == "allow") | presumed, 0.0)).where(F.col("y").isNotNull())


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
