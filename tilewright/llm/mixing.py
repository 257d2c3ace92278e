"""Mixing sources to target weights: raking to marginals, then sampling by calibrated probabilities. Column expressions only.

Documents fall into cells of source, language and topic. Iterative proportional fitting scales the cells' token weights to
the target shares of each of the three in turn until all agree. A cell's ratio (weight over tokens) is turned into a
probability ``min(1, s * ratio)``, where ``s`` gives the wanted number of expected tokens; a document is taken if a hash of
its id, seen as a number from 0 to 1, is below its cell's probability. Raking works on the table of cells, which grows with
the number of combinations that occur, not with documents; it stays in DataFrames and its lineage is cut by checkpoints.

Targets, for each dimension: a number ``a`` (shares in proportion to the natural ones to the power ``a``), or shares by
value; values without a share divide what is left in proportion to their tokens. Targets that contradict one another (a
source found only in one language, of unlike shares) cannot be met: the last dimension's hold after ``SWEEPS`` sweeps, and a
RuntimeWarning tells how far the others are off. Topics come from a column, named or given as an expression; without one
``topic_of`` tells coarse kinds of text.

Defined cases: null text has no tokens; null source, language or topic is a value like any other; cells without tokens have
the ratio 1; rows of one id are taken or left together; texts are read whole; an empty table gives an empty table; columns
of the names of results are replaced, others pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialise, packed, unpacked
from tilewright.llm.simhash import skew_join

BLANKS = " \t\n\x0b\f\r"
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.6, "lang": 0.8, "topic": 0.7}
KEEP = 0.6
SWEEPS, TOLERANCE = 30, 1e-6
SEED = 20240229
BROADCAST_CELLS = 20_000
#: Values of the scale tried at once; three rounds narrow it to one part in 64 ** 3 of its range in logarithms.
TRIED, ROUNDS = 64, 3
MADE = ("topic", "n_tokens", "ratio", "probability", "sampled")


def topic_of(text: Column) -> Column:
    """A coarse kind of text: rows of cells, licence notices, contact details, else prose."""
    return F.when(text.contains(" | "), "table").when(text.rlike("(?i)licen[sc]e"), "notice").when(text.contains("@"), "contact").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words between blanks."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).cast("long")


def target_shares(cells: DataFrame, dim: str, target: float | Mapping[str, float]) -> DataFrame:
    """(value, share): wanted shares of the values of a dimension that have tokens, adding up to 1."""
    own = cells.where(F.col("t") > 0).groupBy(F.col(dim).alias("value")).agg(F.sum("t").cast("double").alias("t"))
    if isinstance(target, Mapping):
        given = F.lit(None).cast("double")
        for value, share in target.items():
            given = F.when(F.col("value").eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(given)
        own = own.withColumn("given", given)
        taken, rest = own.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("t")))).first()
        left = max(0.0, 1 - (taken or 0.0)) / rest if rest else 0.0
        own = own.withColumn("share", F.coalesce("given", left * F.col("t")))
    else:
        own = own.withColumn("share", F.pow("t", F.lit(float(target))))
    total = own.agg(F.sum("share")).first()[0]
    return own.select("value", (F.col("share") / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """Cells (the dimensions, ``t`` tokens) with ``ratio``: raked weight over tokens, 1 on average."""
    dims = list(targets)
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    state = cells.withColumn("w", F.col("t").cast("double"))
    wide = {}
    for d in dims:
        state = state.withColumn(f"key_{d}", F.to_json(F.struct(d)))  # never null, so an equal key is an equal value
        shares = target_shares(cells, d, targets[d]).select(F.to_json(F.struct(F.col("value").alias(d))).alias(f"key_{d}"), (F.col("share") * total).alias(f"want_{d}"))
        shares = materialise(shares, f"target-{d}")
        wide[d] = shares.count() > BROADCAST_CELLS
        state = skew_join(state, shares, f"key_{d}", "left") if wide[d] else state.join(F.broadcast(shares), f"key_{d}", "left")
    state = materialise(state, "cells")
    for _ in range(SWEEPS):
        for d in dims:
            now = state.groupBy(f"key_{d}").agg(F.sum("w").alias("now"))
            met = skew_join(state, now, f"key_{d}") if wide[d] else state.join(F.broadcast(now), f"key_{d}")
            state = met.withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.coalesce(F.col(f"want_{d}"), F.lit(0.0)) / F.col("now")).otherwise(F.col("w"))).drop("now")
        state = state.checkpoint()
        errors = [state.groupBy(f"key_{d}").agg(F.abs(F.sum("w") - F.max(f"want_{d}")).alias("e")).agg(F.max("e").alias("e")) for d in dims]
        worst = max([0.0, *[r.e or 0.0 for e in errors for r in e.collect()]])
        if worst <= TOLERANCE * max(total, 1.0):
            break
    else:
        warnings.warn(f"after {SWEEPS} sweeps a marginal is {worst / max(total, 1.0):.2g} of all tokens off its target", RuntimeWarning, stacklevel=2)
    return state.select(*dims, "t", F.when(F.col("t") > 0, F.round(F.col("w") / F.col("t"), 9)).otherwise(1.0).alias("ratio"))


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """Cells with ``probability`` = min(1, s * ratio), s for ``keep`` of all tokens in expectation."""
    total, top, low = cells.agg(F.sum("t"), F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    if not total or not low:
        return cells.withColumn("probability", F.lit(float(min(1.0, keep))))
    wanted, a, b = float(total) * min(1.0, keep), keep / top / 2, 2 / low
    for _ in range(ROUNDS):
        tries = [a * (b / a) ** (i / (TRIED - 1)) for i in range(TRIED)]
        sums = cells.agg(*[F.sum(F.col("t") * F.least(F.lit(1.0), s * F.col("ratio"))) for s in tries]).first()
        reached = next((i for i, x in enumerate(sums) if x >= wanted * (1 - 1e-12)), TRIED - 1)
        a, b = tries[max(0, reached - 1)], tries[reached]
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), b * F.col("ratio")), 9))


def chance(id_col: Column, seed: int) -> Column:
    """A number from 0 to 1 for each id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | str | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, their cell's ``ratio`` and ``probability``, and whether they are ``sampled``."""
    rest = [c for c in docs.columns if c not in MADE]
    text = F.col(f"`{text_col}`")
    topic = F.col(f"`{topic}`").cast("string") if isinstance(topic, str) else topic
    kind = F.coalesce(topic if topic is not None else topic_of(F.coalesce(text, F.lit(""))), F.lit(""))
    dims = [F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), kind.alias("topic")]
    table = docs.select(F.struct(*dims).alias("__tw_cell"), token_count(text).alias("t"))
    cells = materialise(table.groupBy("__tw_cell").agg(F.sum("t").alias("t")).select("__tw_cell.*", "t"), "cell-tokens")
    done = calibrated(materialise(rake(cells, targets), "raked"), keep)
    key = F.to_json(F.struct("source", "lang", "topic"))
    done = materialise(done.select(key.alias("__tw_key"), "ratio", "probability"), "probabilities")
    own = docs.select(packed(rest), F.col(f"`{id_col}`").alias("__tw_id"), F.struct(*dims).alias("__tw_cell"), token_count(text).alias("n_tokens")).withColumn("__tw_key", F.to_json("__tw_cell"))
    met = own.join(F.broadcast(done), "__tw_key") if done.count() <= BROADCAST_CELLS else skew_join(own, done, "__tw_key")
    taken = chance(F.col("__tw_id"), seed) < F.col("probability")
    return met.select(*unpacked(rest), F.col("__tw_cell.topic").alias("topic"), "n_tokens", "ratio", "probability", taken.alias("sampled"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, ratio, probability and whether the mix takes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "ratio", "probability", "sampled")
