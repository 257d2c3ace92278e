"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. Column expressions only.

==========  ================================================================  =========================================
kind        pattern                                                           confirmed by
==========  ================================================================  =========================================
email       local part, @, domain with a dot                                  -
ip          four groups of digits                                             parts of at most 255
card        14 to 19 digits, single blanks or hyphens between                 Luhn
phone       +, then 10 to 15 digits, blanks, brackets, dots or hyphens        -
iban        two letters, two digits, groups of four                           modulo 97
ssn         3-2-4 digits of an issued range                                   words nearby
key         32 to 64 hexadecimal digits                                       words nearby
==========  ================================================================  =========================================

The first four are *base* kinds: all of their confirmed spans stay. The others stay if their score reaches ``THRESHOLD``:
the kind's own weight, more if a word of the kind stands in the 40 code points before the span or the 20 after it.

Patterns are written so that a match starts at the first character of its run and never gives characters back, which finds
the same leftmost non-overlapping matches as the plain forms in time linear in the text. A span's place comes from the
lengths of the pieces between the matches, added up in blocks.

Defined cases: null counts as empty and has no spans; texts of any length are read whole; repeated rows give repeated
results; an empty table gives an empty table; a column named ``pii`` is replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "key")
THRESHOLD = 0.5
NEAR_BONUS = 0.35
BEFORE, AFTER = 40, 20
BLOCK = 64

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"

#: pattern, what a text must contain for the pattern to be tried, weight of a confirmed span, words that speak for it
RULES: dict[str, tuple[str, str | None, float, str]] = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", None, 0.6, "ip|host|server|address"),
    "card": (r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", None, 0.8, "card|visa|credit|payment"),
    "phone": (r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])", "+", 0.7, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None, 0.6, "iban|account|bank|konto|cuenta"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social"),
    "key": (r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])", None, 0.3, "key|token|secret|password|credential"),
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a good check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, letters as 10 to 35 and the first four characters last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        v = F.when(c >= 65, c - 55).otherwise(c - 48)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


CONFIRM: dict[str, Callable[[Column], Column]] = {
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: luhn(F.regexp_replace(m, "[ -]", "")),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit(""))),
}


def starts(z: Column) -> Column:
    """Starts of matches from structs of the gap before each (``g``) and its length (``l``), added up in blocks."""
    last = F.floor((F.size(z) - 1) / BLOCK).cast("int")
    none = F.array().cast("array<long>")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["l"])

    sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(z, b * BLOCK + 1, BLOCK)))
    firsts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def block(b: Column, first: Column) -> Column:
        part = F.slice(z, b * BLOCK + 1, BLOCK)
        return F.transform(part, lambda x, i: first + total(F.slice(part, F.lit(1), i)) + x["g"])

    found = F.flatten(F.transform(F.slice(firsts, F.lit(1), last + 1), lambda first, b: block(b, first)))
    return F.when(F.size(z) > 0, found).otherwise(none)


def lengths(matches: Column, gaps: Column) -> Column:
    """The length of each match and of the gap before it."""
    return F.transform(matches, lambda x, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("g"), F.length(x).cast("long").alias("l")))


def spans(matches: Column, gaps: Column, places: Column, number: int, kind: str, weight: float, words: str) -> Column:
    """The confirmed spans of a kind, with their scores."""

    def span(start: Column, i: Column) -> Column:
        match = F.get(matches, i)
        around = F.concat(F.right(F.get(gaps, i), F.lit(BEFORE)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(AFTER)))
        score = F.lit(weight) + F.when(around.rlike(rf"(?i)\b(?:{words})"), NEAR_BONUS).otherwise(0.0)
        confirmed = CONFIRM[kind](match) if kind in CONFIRM else F.lit(True)
        kept = confirmed if kind in BASE_KINDS else confirmed & (score >= THRESHOLD)
        return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), kept.alias("kept"))

    return F.filter(F.transform(places, span), lambda x: x["kept"])


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of (start, kind, end, score), places in code points, end exclusive, in order of place."""
    names = [c for c in docs.columns if c != "pii"]
    df = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__tw_t"))
    text = F.col("__tw_t")
    nothing = F.array().cast("array<string>")
    for kind, (pattern, needs, _, _) in RULES.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        df = df.withColumn(f"__tw_m_{kind}", F.when(text.contains(needs), found).otherwise(nothing) if needs else found)
    for kind, (pattern, *_) in RULES.items():
        # the pieces between the matches, only where there are any
        df = df.withColumn(f"__tw_g_{kind}", F.when(F.size(f"__tw_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(nothing))
    for kind in RULES:
        m, g = F.col(f"__tw_m_{kind}"), F.col(f"__tw_g_{kind}")
        df = df.withColumn(f"__tw_z_{kind}", lengths(m, g))
    for kind in RULES:
        df = df.withColumn(f"__tw_s_{kind}", starts(F.col(f"__tw_z_{kind}")))
    parts = []
    for number, (kind, (_, _, weight, words)) in enumerate(RULES.items()):
        m, g, s = (F.col(f"__tw_{x}_{kind}") for x in "mgs")
        parts.append(spans(m, g, s, number, kind, weight, words))
    df = df.withColumn("__tw_all", F.array_sort(reduce(lambda a, b: F.concat(a, b), parts)))
    pii = F.transform("__tw_all", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score")))
    return df.select(*[F.col(f"`{c}`") for c in names], pii.alias("pii"))


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(*kinds: str) -> Column:
    """The spans of some kinds."""
    return F.filter("pii", lambda x: x["kind"].isin(*kinds))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all kinds, the digest of the base spans, all spans, and ``has_pii``: whether a document has any."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(spelled(of_kind(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, spelled(F.col("pii")).alias("spans"), (F.size("pii") > 0).alias("has_pii"))
