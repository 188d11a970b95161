"""From raw documents to tokens: clean, drop repeated lines, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.llm import bpe, line_dedup, mixing, near_dup, quality
from flagstone.llm.common import read, written
from flagstone.llm.queries import PATTERN, RANKS

#: No SQL: the rows hold tokens of a byte-pair encoding. tests/llm checks them stage by stage.
ORACLE_SQL = None


def with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, n_chars counted anew."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, rejected documents go as a whole."""
    judged = quality.judge(docs).filter("quality.kept")
    return with_text(judged, F.col("quality.clean_text")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them alone; documents left without a word go."""
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True))
    kept = with_text(done, F.col("line_dedup.kept_text")).select(*docs.columns)
    return kept.filter(F.col("text").rlike(quality.WORD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 or more the one with the smallest id stays."""
    return near_dup.one_of_each(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic shares of the words come to their flattened targets."""
    return mixing.mix(docs, kept_share=0.8).filter("mix.sampled").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of the text decoded from them."""
    return bpe.digests(bpe.round_trip(docs, RANKS, PATTERN))


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
