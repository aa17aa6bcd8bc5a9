"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing, each over all that the last one kept.

Null and empty texts pass every stage but near-dedup, which keeps one of all equal texts (null counts as empty). Rows without an id
come last where ids decide. Of rows equal in id and text near-dedup keeps one. Further columns pass through, whatever their
names, up to packing, which returns pieces. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import lines, mixing, neardup, packing, toxicity
from evidora.llm.common import cut, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, trained on the labels of the training folds; documents scored 0.7 or more go."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.scored(docs, machine)
    return out.where(F.col(out.columns[-1]) < 0.7).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; of each group of equal or similar lines one stays, n_chars follows the text."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; of each component of near-duplicates the document of the smallest id stays."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; a row for each time that the mix takes a document, the document at a source's cut up to there."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; a row per piece with its sequence and its place there."""
    return packing.pack_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: The stages train, sign and pack: SQL can't express run()'s rows. Tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
