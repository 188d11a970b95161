"""Versioned snapshots: atomic full rebuilds that readers never see half-written (A2, A3).

Layout under ``root``::

    root/v=<version>/order_month=YYYY-MM/part-*.parquet   (+ _SUCCESS written by the committer)

A version becomes visible only when Spark's output committer has written its ``_SUCCESS``
marker, so no pointer swap or rename is needed: readers resolve the newest committed version
once and keep reading its files while a newer one is being built. Old versions are removed by
``prune_versions``, never by the writer. Single writer per root assumed.

``root`` must be shared storage on a cluster; by default it lives under the folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.session import checkpoint_dir

MONTH_PARTITION = "order_month"


def default_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/flagstone/snapshots/{name}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _natural(name: str) -> list:
    """Sort key of a version name: digit runs by their value, so v9 comes before v10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", name)]


def commits(spark: SparkSession, root: str) -> list[tuple[str, dt.datetime]]:
    """(version, commit time in UTC) of the versions under ``root`` whose write committed, oldest first.

    The commit time is that of the committer's ``_SUCCESS`` marker; versions committed in the same
    millisecond are ordered by name, digits by value."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        marker = st.getPath().suffix("/_SUCCESS")
        if st.isDirectory() and name.startswith("v=") and fs.exists(marker):
            out.append((fs.getFileStatus(marker).getModificationTime(), _natural(name[2:]), name[2:]))
    epoch = dt.datetime(1970, 1, 1)
    return [(name, epoch + dt.timedelta(milliseconds=ms)) for ms, _, name in sorted(out)]


def committed_versions(spark: SparkSession, root: str) -> list[str]:
    """Committed versions under ``root``, oldest commit first."""
    return [name for name, _ in commits(spark, root)]


def with_month(df: DataFrame, ts_col: str = "order_date_time", month_col: str = MONTH_PARTITION) -> DataFrame:
    """Add a month partition column derived from a time or date column."""
    return df.withColumn(month_col, F.date_format(F.col(ts_col), "yyyy-MM"))


def refresh_snapshot(
    df: DataFrame,
    root: str,
    version: str | None = None,
    partition_col: str | None = MONTH_PARTITION,
    max_records_per_file: int = 5_000_000,
    placed: bool = False,
) -> str:
    """Write ``df`` (all its columns, so a new source column is picked up by itself) as the
    next version; returns the version.

    The rows are rebalanced by partition value before the write: adaptive execution splits a
    value that holds much of the data over as many tasks as its measured size needs and puts
    small values together, so files stay few and bounded (``max_records_per_file``). The source
    is computed once (no sampling pass). Rows that already lie by partition value (``placed``) are
    written where they are."""
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    spark = df.sparkSession
    if version in committed_versions(spark, root):
        raise FileExistsError(f"version {version} already exists under {root}")
    w = df
    if partition_col:
        if partition_col not in df.columns:
            w = with_month(df)
        if not placed:
            w = w.hint("rebalance", partition_col)
    _write_schema(spark, root, version, w.schema)
    writer = w.write.mode("errorifexists").option("maxRecordsPerFile", max_records_per_file)
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.parquet(f"{root}/v={version}")
    return version


def _schema_path(root: str, version: str) -> str:
    return f"{root}/_schemas/{version}.json"


def _write_schema(spark: SparkSession, root: str, version: str, schema: T.StructType) -> None:
    """Keep the written schema beside the version: partition columns are read back with their
    written types instead of types guessed from folder names ('3' would become an integer)."""
    fs, p = _fs(spark, _schema_path(root, version))
    out = fs.create(p, True)
    try:
        out.write(bytearray(schema.json().encode("utf-8")))
    finally:
        out.close()


def _read_schema(spark: SparkSession, root: str, version: str) -> T.StructType | None:
    fs, p = _fs(spark, _schema_path(root, version))
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")
        )
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        text = "\n".join(lines)
    finally:
        stream.close()
    return T.StructType.fromJson(json.loads(text))


def read_snapshot(
    spark: SparkSession, root: str, schema: T.StructType | None = None, version: str | None = None
) -> DataFrame:
    """Newest committed version (or the given one). With ``schema`` the read is not inferred."""
    versions = committed_versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    v = version or versions[-1]
    if v not in versions:
        raise FileNotFoundError(f"version {v} not committed under {root}")
    schema = schema or _read_schema(spark, root, v)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root}/v={v}")


def snapshot_info(spark: SparkSession, root: str) -> DataFrame:
    """Column names and types of the newest version, with its refresh time: that of the commit, in UTC."""
    versions = commits(spark, root)
    if not versions:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    version, refreshed = versions[-1]
    df = read_snapshot(spark, root, version=version)
    rows = [(i, f.name, f.dataType.simpleString(), refreshed) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType(
        [
            T.StructField("position", T.IntegerType(), False),
            T.StructField("column", T.StringType(), False),
            T.StructField("type", T.StringType(), False),
            T.StructField("refreshed_at", T.TimestampNTZType(), True),
        ]
    )
    return spark.createDataFrame(rows, schema)


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` committed versions; returns the deleted ones."""
    versions = committed_versions(spark, root)
    doomed = versions[:-keep] if keep > 0 else versions
    for v in doomed:
        for path in (f"{root}/v={v}", _schema_path(root, v)):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return doomed
