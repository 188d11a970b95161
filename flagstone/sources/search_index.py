"""Substring search over a stored table by trigram postings.

Layout under ``root``::

    root/rows/...                       the rows, in blocks of neighbours (column ``_block``)
    root/postings/bucket=<n>/...        (gram, block): blocks with a row whose search text has the three characters

A text is looked up by its trigrams: blocks that have all of them are the only ones that can match, and
their rows are tested with the same predicate as a search without an index. So a match may span two
cells, and the result is the same. Texts of fewer than three characters have no trigram; they test all
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.operators.explore import haystack, search_rows
from flagstone.sources.snapshot import _read_schema, _write_schema

#: Rows of a block: fewer make searches read less and the postings larger.
BLOCK_ROWS = 64
#: Folders of the postings; a search reads those of its trigrams.
BUCKETS = 64
#: Up to so many blocks are read by a filter that reaches the files; more by a join.
LISTED_BLOCKS = 1000


def grams_of(text: Column) -> Column:
    """Distinct stretches of three characters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), 1))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def _with_block(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_block", T.LongType())])


def build_search_index(df: DataFrame, root: str, types: dict[str, str] | None = None) -> None:
    """Writes the rows of ``df`` and the postings of their search texts, one shuffle of (gram, block)."""
    spark = df.sparkSession
    # numbers of one partition differ from those of the next by a multiple of BLOCK_ROWS
    block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).cast("long")
    df.withColumn("_block", block).write.mode("errorifexists").parquet(f"{root}/rows")
    rows = spark.read.schema(_with_block(df.schema)).parquet(f"{root}/rows")
    found = rows.select("_block", F.explode(grams_of(haystack(df, types))).alias("gram"))
    postings = found.distinct().withColumn("bucket", _bucket(F.col("gram")))
    # a folder's rows are in order of gram, so that a reader skips most of its row groups
    postings.repartitionByRange("bucket", "gram", "_block").sortWithinPartitions("bucket", "gram").write.mode("errorifexists").partitionBy("bucket").parquet(f"{root}/postings")
    _write_schema(spark, root, "rows", df.schema)


def candidate_blocks(spark: SparkSession, root: str, text: str) -> DataFrame:
    """(_block) of the blocks that have all trigrams of a lower-case text of three characters or more."""
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    buckets = [r.b for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
    postings = spark.read.schema("gram string, _block long, bucket int").parquet(f"{root}/postings")
    some = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return some.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("_block")


def search_indexed(spark: SparkSession, root: str, text: str | None, types: dict[str, str] | None = None) -> DataFrame:
    """The rows that ``search_rows`` finds in the indexed table; a blank text keeps every row."""
    schema = _read_schema(spark, root, "rows")
    rows = spark.read.schema(_with_block(schema)).parquet(f"{root}/rows")
    q = (text or "").strip().lower()
    if len(q) >= 3:
        blocks = candidate_blocks(spark, root, q)
        listed = [r._block for r in blocks.limit(LISTED_BLOCKS + 1).collect()]
        rows = rows.where(F.col("_block").isin(listed)) if len(listed) <= LISTED_BLOCKS else rows.join(blocks, "_block", "left_semi")
    return search_rows(rows.select(*[F.col(f"`{f.name}`") for f in schema.fields]), text, types)
