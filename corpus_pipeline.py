"""A corpus pipeline of five stages, each written to the shared folder and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each works
on all that its predecessor kept, and its decisions take effect:

1. quality classifier: documents that it rejects go;
2. line dedup: lines found in three documents or more stay in one of them;
3. SimHash near-dedup: one document of each group of like texts stays (five-word shingles, similarity of 0.8 or more);
4. mixing: documents are taken by probabilities that bring source, language and topic nearer to their targets;
5. BPE: ids of the tokens of each document, and whether decoding gives the text back.

A text changed by a stage has ``n_chars`` counted anew where the table has that column. Nulls, empty texts, repeated rows and
empty tables are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, lines, mixing, quality, simhash
from tilewright.llm.common import materialise

VOCABULARY = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in another one."""
    kept = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts."""
    return simhash.near_dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes."""
    return mixing.mix(docs).where("sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (BINARY: little-endian unsigned 32-bit), how many, and whether they decode to the text."""
    import public_tokenizers

    coded = bpe.bpe_encode(docs, public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the model, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
