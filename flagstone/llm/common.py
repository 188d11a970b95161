"""Helpers shared by the corpus operators: shared scratch tables and gapless numbering."""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.session import checkpoint_dir

#: Blank characters of all word and line rules: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word: a longest run of characters that are not blank.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def served_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts a file into the application's own folder on the driver, from where Spark serves it; its path there."""
    path = os.path.join(SparkFiles.getRootDirectory(), "served", name)
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        Path(path).write_bytes(data)
    return path


def ship(spark: SparkSession) -> None:
    """Adds this package to the job, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_flagstone_shipped", False):
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    name = f"flagstone-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    sc.addPyFile(served_file(spark, name, packed.getvalue()))
    sc._flagstone_shipped = True


def released(function: Callable) -> Callable:
    """``function`` of batches, after each of which the memory that Arrow keeps unused goes back to the system.

    Workers are used again by later tasks and wait for them meanwhile, beside the executor's own memory."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for made in function(batches):
            yield made
            del made
            pool.release_unused()
        pool.release_unused()

    return lean


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the workers, which keep no unused memory."""
    ship(df.sparkSession)
    return df.mapInArrow(released(function), schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under the shared folder, read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_prefix(docs: DataFrame) -> str:
    """Underscores with which no column of ``docs`` begins, for the names of columns that come and go."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Only A-Z lowered, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def uniform(*cols: Column | str, bits: int = 48) -> Column:
    """A long in [0, 2**bits) that depends on the values of ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, blocks: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the earlier rows of the same ``keys``, itself left out.

    Rows of a key are ordered by ``order[0]``, a hash from :func:`uniform`, and then the other
    columns of ``order``. A key is cut into ``blocks`` ranges of that hash, so that a key with most
    of the rows is summed by many tasks; the totals of the blocks (one row each) are summed up over
    each key and joined back.
    """
    block = f"{out}__block"
    cut = df.withColumn(block, F.shiftrightunsigned(F.col(order[0]) * F.lit(blocks), 48).cast("int"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, block).agg(F.sum(value).alias(f"{out}__total"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, block, F.coalesce(F.sum(f"{out}__total").over(before), F.lit(0)).alias(f"{out}__start"))
    return (
        cut.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, block])
        .withColumn(out, (F.col(out) + F.col(f"{out}__start")).cast("long"))
        .drop(block, f"{out}__start")
    )
