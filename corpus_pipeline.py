"""A corpus from raw documents to token ids: toxicity, exact dedup, near-dedup, benchmark decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import decontamination, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from quorumlake.llm.common import unused, written

#: Near copies share this percentage of their five-word shingles. A pair at exactly 0.8 shares 31 or more of the 64
#: coordinates but for a chance of one in a hundred million.
NEAR_PERCENT, NEAR_MATCHES = 80, 31


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity lexicon scores at 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs, labels, toxicity.fold_of(F.col("doc_id")) != 1)
    score = unused(docs, "_score")
    return toxicity.score_texts(docs, lexicon, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of each set of texts that are equal but for the case of A-Z."""
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of documents with a similarity of 0.8 or more."""
    return near_dedup.keep_first(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words (or all, if fewer) of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with each text's ids, their number, and the two verdicts on them."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: No stage but exact dedup can be put in SQL; tests hold the rows to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
