"""A training corpus from documents, in five stages, each over all that the stage before kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor
costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlark.llm import latent_decontamination, piece_lattice, rule_ensemble, similar_texts, substring_cover
from seasonlark.llm.registry import tuned
from seasonlark.scratch import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    tuned(spark)
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five-word shingles, similarity of 0.8).

    SimHash anchors propose first, bands of minimum hashes what fingerprints cannot find; shingles decide.
    """
    tuned(spark)
    return similar_texts.keep_one_of_each(docs)


def repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its runs of 20 or more words that an earlier one has; untouched texts stay as they are."""
    tuned(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "n_chars"))
    out = substring_cover.dedup_substrings(docs, carry=rest).drop("n_words")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tuned(spark)
    return latent_decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    tuned(spark)
    path = piece_lattice.model_path()
    coded = piece_lattice.encode(docs, path)
    return piece_lattice.decode(coded, path).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_runs),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokenise),
]

#: Several stages (trained rules, fingerprints, latent search, merges) have no SQL form; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
