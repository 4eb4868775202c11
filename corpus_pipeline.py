"""Training-text pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm import decontaminate, line_dedup, minhash, packing, toxicity
from revlake.llm.common import stage
from revlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; null and empty texts are scored too, repeated rows alike."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 0").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; repeated lines stay in the first one only (rows without id come first), and n_chars follows the text. A
    null text stays null, rows with one id are one document."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. Texts without words and rows
    without id stay; repeated rows stay or go alike."""
    return minhash.drop_near_copies(docs)


def drop_leaky(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.drop_leaky(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens; a null or empty text is the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_dedup", drop_near_copies), ("decontamination", drop_leaky), ("packing", pack)]
#: The classifier, the minima and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, in order. Further columns pass through all stages but the last; empty tables give no
    rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
