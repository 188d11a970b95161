"""Snapshots that rewrite only what changed: a digest per partition and a manifest per version (A2).

Layout under ``root``::

    root/_manifests/<20 digits>.json                  one version: its files and digests, by partition value
    root/parts/refresh=<id>/<column>=<value>/...      files of the partitions that a refresh wrote

A refresh digests the source by partition (one aggregation), writes the partitions whose digest is not
that of the newest version, and commits a manifest that names the old files of the others. A manifest
appears whole, by creating its numbered file where none is. Of two refreshes at once the later one
compares again with the winner's manifest. Files never change: a reader that opened a version keeps
its files until :func:`prune_manifests` removes them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.sources.review_log import LostRace, create_if_absent, read_text
from flagstone.sources.snapshot import MONTH_PARTITION, _fs, with_month

REFRESH = "refresh"


@dataclass(frozen=True)
class Part:
    """One partition value's files, rows and digest, and the version that wrote it."""

    path: str
    rows: int
    digest: str
    version: int


@dataclass(frozen=True)
class Manifest:
    version: int
    refreshed_at: str
    column: str
    schema: T.StructType
    parts: dict[str | None, Part]

    def text(self) -> str:
        parts = [[value, part.__dict__] for value, part in sorted(self.parts.items(), key=lambda x: (x[0] is not None, x[0] or ""))]
        return json.dumps({**self.__dict__, "schema": self.schema.jsonValue(), "parts": parts})

    @staticmethod
    def parsed(text: str) -> Manifest:
        fields = json.loads(text)
        parts = {value: Part(**part) for value, part in fields["parts"]}
        return Manifest(**{**fields, "schema": T.StructType.fromJson(fields["schema"]), "parts": parts})


def _path(root: str, version: int) -> str:
    return f"{root}/_manifests/{version:020d}.json"


def manifest_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/_manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """A version's manifest; the newest, if None."""
    known = manifest_versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no snapshot{'' if version is None else f' of version {version}'} under {root}")
    return Manifest.parsed(read_text(spark, _path(root, known[-1] if version is None else version)))


def _hash_sum(seed: int, row: Column) -> Column:
    """Exact sum of a group's 64-bit row hashes as text, from sums of three parts that fit a long each:
    a sum of decimals makes objects for each row."""
    h, part = F.xxhash64(F.lit(seed), row), (1 << 22) - 1
    sums = [F.sum(F.shiftright(h, 44)), F.sum(F.shiftright(h, 22).bitwiseAND(F.lit(part))), F.sum(h.bitwiseAND(F.lit(part)))]
    high, middle, low = (x.cast("decimal(20,0)") for x in sums)
    scale = lambda bits: F.lit(1 << bits).cast("decimal(14,0)")
    return (high * scale(44) + middle * scale(22) + low).cast("decimal(38,0)").cast("string")


def _digest(columns: list[str]) -> list[Column]:
    """Count and two sums of hashes of whole rows: the same for any order and split of the same rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return [F.count(F.lit(1)).alias("rows"), F.concat_ws("/", *[_hash_sum(seed, row) for seed in (1, 2)]).alias("digest")]


def partition_digests(df: DataFrame, column: str) -> dict[str | None, tuple[int, str]]:
    """(rows, digest) by partition value; one row per value comes to the driver."""
    columns = sorted(c for c in df.columns if c != column)
    found = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(*_digest(columns)).collect()
    return {r.value: (r.rows, r.digest) for r in found}


def _written_parts(df: DataFrame, root: str, column: str, values: list[str | None], version: int) -> dict[str | None, Part]:
    """Writes the rows of some partition values; what was written, digested from the files."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    text = F.col(f"`{column}`").cast("string")
    some = text.isin([v for v in values if v is not None])
    rows = df.where(F.coalesce(some, F.lit(False)) | text.isNull() if None in values else some)
    path = f"{root}/parts/{REFRESH}={name}"
    rows.hint("rebalance", column).write.mode("errorifexists").partitionBy(column).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    fs, p = _fs(spark, path)
    folders = {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()}
    out = {}
    for value, (count, digest) in partition_digests(back, column).items():
        folder = f"{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
        if folder not in folders:
            raise ValueError(f"partition value {value!r} cannot name a folder")
        out[value] = Part(f"{REFRESH}={name}/{folder}", count, digest, version)
    return out


def refresh_changed(df: DataFrame, root: str, column: str = MONTH_PARTITION, attempts: int = 20) -> Manifest:
    """Makes ``df`` the newest version and writes only the partitions that differ from the version before.

    Without the partition column, it is derived from the order time. With other columns or types all
    partitions differ. The recorded digests are those of the written files, so a source that changes
    while it is read is put right by the next refresh. Columns of map type have no digest and are
    refused by Spark. Rows with a null partition value are a partition of their own."""
    spark = df.sparkSession
    if column not in df.columns:
        df = with_month(df, month_col=column)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.col(f"`{column}`").cast("string").alias(column))
    wanted = partition_digests(df, column)
    staged: dict[str | None, Part] = {}
    for _ in range(attempts):
        known = manifest_versions(spark, root)
        last = manifest(spark, root, known[-1]) if known else None
        version = known[-1] + 1 if known else 0
        have = dict(last.parts) if last and last.schema == df.schema and last.column == column else {}
        todo = [v for v, (_, digest) in wanted.items() if not (v in staged or (v in have and have[v].digest == digest))]
        if todo:
            staged |= _written_parts(df, root, column, todo, version)
        parts = {v: staged.get(v) or have.get(v) for v in wanted}
        parts = {v: p for v, p in parts.items() if p}  # a value can vanish between the digest and the write
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")
        made = Manifest(version, now, column, df.schema, parts)
        if create_if_absent(spark, _path(root, version), made.text()):
            return made
    raise LostRace(f"no commit after {attempts} attempts")


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version (the newest, if None). Filters on the partition column prune its folders."""
    m = manifest(spark, root, version)
    names = [f.name for f in m.schema.fields]
    if not m.parts:
        return spark.createDataFrame([], m.schema)
    reader = spark.read.schema(T.StructType([*m.schema.fields, T.StructField(REFRESH, T.StringType())]))
    paths = [f"{root}/parts/{p.path}" for p in m.parts.values()]
    return reader.option("basePath", f"{root}/parts").parquet(*paths).select(*[F.col(f"`{c}`") for c in names])


def manifest_parts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(value, rows, version that wrote it) of each partition of a version, one row per folder."""
    m = manifest(spark, root, version)
    rows = [(v, p.rows, p.version) for v, p in m.parts.items()]
    return spark.createDataFrame(rows, f"{m.column} string, rows long, written_by long")


def prune_manifests(spark: SparkSession, root: str, keep: int = 2, orphans_after: dt.timedelta = dt.timedelta(days=1)) -> list[int]:
    """Removes all but the newest ``keep`` versions and the files that only they had; their numbers.

    Folders that no manifest names, left by a refresh that ended without a commit, go once they are
    older than ``orphans_after``."""
    known = manifest_versions(spark, root)
    keep = max(keep, 1)
    kept = {p.path for v in known[-keep:] for p in manifest(spark, root, v).parts.values()}
    doomed = known[:-keep]
    old = {p.path for v in doomed for p in manifest(spark, root, v).parts.values()}
    for path in old - kept:
        fs, p = _fs(spark, f"{root}/parts/{path}")
        fs.delete(p, True)
    for v in doomed:  # after their files, so that a run that ends here is finished by the next one
        fs, p = _fs(spark, _path(root, v))
        fs.delete(p, False)
    fs, p = _fs(spark, f"{root}/parts")
    limit = (dt.datetime.now(dt.timezone.utc) - orphans_after).timestamp() * 1000
    used = {path.split("/")[0] for path in kept}
    for s in fs.listStatus(p) if fs.exists(p) else []:
        if s.getPath().getName() not in used and (not fs.listStatus(s.getPath()) or s.getModificationTime() < limit):
            fs.delete(s.getPath(), True)
    return doomed
