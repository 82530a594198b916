"""A training corpus in five stages, each over all that the one before kept.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; extra columns of
the input are carried along, whatever their names. A null text is an empty one (the rules reject it), a null doc_id comes
after all others, a null source is a source of its own and a null lang a stratum without rules. Rows that repeat are
copies: one stays; rows that share an id go or stay by their own texts. Very long texts are read whole, ties are broken by
id and hash, so runs agree. An empty table runs through all stages. Stages bound their session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verisift.llm import jaccard, lines, mixing, pieces, rules
from verisift.llm._shared import bounded_batches, release, staged, staged_so_far


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled ones; the labels are those of the corpus."""
    bounded_batches(spark)
    return rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go everywhere; n_chars follows the text."""
    bounded_batches(spark)
    out = lines.drop_hot_lines(docs, min_docs=10, min_chars=1, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target of words; rows repeat as often as the mix takes them."""
    bounded_batches(spark)
    return mixing.mix(docs, keep=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the sampled piece ids of each text and their number."""
    bounded_batches(spark)
    out = pieces.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mixture), ("SentencePiece encoding", encoding)]

#: Labels choose the cutoffs and a lattice is sampled: SQL has no form of either. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = staged_so_far()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
        release(mark, docs)  # what earlier stages left
    return STAGES[-1][1](spark, docs, sf_dir)
