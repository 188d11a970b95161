"""Review dataset as a log of commits: many writers, small writes, merge on read.

Layout under ``root``::

    root/_log/<20 digits>.json      one commit each, numbered without gaps
    root/data/<id>/...              a base (all rows, one folder per rule) or a delta (rows of touched cases)
    root/outcomes/<id>/...          outcome of every decision of a batch

A commit becomes visible, whole, by creating its numbered file where none is (:func:`publish`). Of two
writers that read version N only one creates N + 1. The other looks at what the winners touched: if
no case of its own batch is among it, its delta is still right and takes the next number; else the
batch is decided again on the newer version, so that a case saved by the winner comes out as a
conflict and nothing is lost.

A delta holds all rows, as they are after the batch, of the cases that the batch saved or edited; a
reader takes each case from the newest commit that holds it. :func:`compact` merges what there is at
some version into a new base; later deltas still apply to it, so it never stands in a writer's way.

``root`` is shared storage. On HDFS and the like the file is created by a rename that fails if the
target exists, on a file system by a hard link; a store with neither needs a lock of its own.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.operators.reviews import KEYS, apply_decisions, validated_decisions
from flagstone.operators.rules import RULES, RuleSpec
from flagstone.sources.snapshot import _fs

BASE, DELTA = "base", "delta"


class LostRace(RuntimeError):
    """Other writers took every number that a batch tried to commit as."""


@dataclass(frozen=True)
class Entry:
    """One commit. ``as_of``: the version whose rows a base holds; a delta's own number."""

    version: int
    kind: str
    data: str
    schema: T.StructType
    as_of: int
    batch: str | None = None
    outcomes: str | None = None

    def text(self) -> str:
        return json.dumps({**self.__dict__, "schema": self.schema.jsonValue()}, sort_keys=True)

    @staticmethod
    def parsed(text: str) -> Entry:
        fields = json.loads(text)
        return Entry(**{**fields, "schema": T.StructType.fromJson(fields["schema"])})


@dataclass(frozen=True)
class Staged:
    """A batch decided on version ``read``: its written delta and outcomes, not yet committed.

    ``validated``: the batch's stored checks, which do not change when it is decided again."""

    read: int
    entry: Entry
    decisions: DataFrame
    rules: tuple[RuleSpec, ...]
    validated: DataFrame | None = None


def _log_path(root: str, version: int) -> str:
    return f"{root}/_log/{version:020d}.json"


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file in one step; False, and nothing changed, if there is one already."""
    fs, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            # rename would replace an existing file here; a link fails
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all commits, oldest first."""
    fs, p = _fs(spark, f"{root}/_log")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())


def entry(spark: SparkSession, root: str, version: int) -> Entry:
    return Entry.parsed(read_text(spark, _log_path(root, version)))


def chain(spark: SparkSession, root: str, version: int | None = None) -> list[Entry]:
    """The base and the deltas, oldest first, that make up a version (the newest, if None).

    Read backwards from the version to the last base and on to the version which that base holds."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed reviews{'' if version is None else f' of version {version}'} under {root}")
    base, deltas = None, []
    for v in reversed([k for k in known if version is None or k <= version]):
        if base and v <= base.as_of:
            break
        e = entry(spark, root, v)
        if e.kind == DELTA:
            deltas.append(e)
        elif base is None:
            base = e
    return [base, *reversed(deltas)]


def latest(spark: SparkSession, root: str) -> int:
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no committed reviews under {root}")
    return known[-1]


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """Columns in the order in which they first came."""
    seen: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            seen.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    return T.StructType(list(seen.values()))


def read_log(spark: SparkSession, root: str, version: int | None = None, rule_ids: list[str] | None = None) -> DataFrame:
    """All reviews at a version (the newest, if None), of some rules if given; base folders of other rules are not read."""
    base, *deltas = chain(spark, root, version)
    schema = merged_schema([e.schema for e in (base, *deltas)])

    def rows(e: Entry) -> DataFrame:
        df = spark.read.schema(e.schema).parquet(f"{root}/data/{e.data}")
        if rule_ids is not None:
            df = df.where(F.col("rule_id").isin(list(rule_ids)))
        return df.select(*[(F.col(f"`{f.name}`") if f.name in e.schema.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    if not deltas:
        return rows(base)
    *older, last = [rows(e) for e in deltas]
    touched = last.select(*KEYS)
    if not older:
        return rows(base).join(touched, KEYS, "left_anti").unionByName(last)
    if len(older) == 1:
        earlier, newest = older[0], older[0].select(*KEYS)
    else:
        changed = None
        for e, part in zip(deltas[:-1], older, strict=True):
            part = part.withColumn("_version", F.lit(e.version))
            changed = part if changed is None else changed.unionByName(part)
        newest = changed.groupBy(*KEYS).agg(F.max("_version").alias("_version"))
        earlier = changed.join(newest, [*KEYS, "_version"], "left_semi").drop("_version")
    # the newest delta is taken as it is, and the base goes to both joins by one shuffle
    untouched = rows(base).join(newest, KEYS, "left_anti").join(touched, KEYS, "left_anti")
    return untouched.unionByName(earlier.join(touched, KEYS, "left_anti")).unionByName(last)


def _write(df: DataFrame, path: str, by_rule: bool) -> T.StructType:
    """Writes ``df`` in as few files as its measured size needs; its schema."""
    if by_rule:
        df.hint("rebalance", "rule_id").write.mode("errorifexists").partitionBy("rule_id").parquet(path)
    else:
        df.hint("rebalance").write.mode("errorifexists").parquet(path)
    return df.schema


def create_log(reviews: DataFrame, root: str) -> int:
    """Starts a log with ``reviews`` as its first base; raises FileExistsError if there is one."""
    spark, name = reviews.sparkSession, uuid.uuid4().hex
    schema = _write(reviews, f"{root}/data/{name}", True)
    if not create_if_absent(spark, _log_path(root, 0), Entry(0, BASE, name, schema, 0).text()):
        _drop(spark, f"{root}/data/{name}")
        raise FileExistsError(f"there are reviews under {root}")
    return 0


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stage(root: str, decisions: DataFrame, rules: tuple[RuleSpec, ...] = RULES, batch: str | None = None, validated: DataFrame | None = None) -> Staged:
    """Decides a batch on the newest version and writes its outcomes and delta, without a commit.

    Base folders of rules that the batch does not name are not read, and only cases that it saved or
    edited are written: the join that decides a record's row leaves the others out. The batch is validated
    once and stored (or taken as ``validated``, from a time when it was staged before)."""
    spark, name = decisions.sparkSession, uuid.uuid4().hex
    read = latest(spark, root)
    validated = validated_decisions(decisions, rules) if validated is None else validated
    rule_ids = [r.rule_id for r in validated.where("valid").select("rule_id").distinct().collect()]  # of the registry
    rows, outcomes = apply_decisions(read_log(spark, root, read, rule_ids), decisions, rules, validated, changed_only=True)
    _write(outcomes, f"{root}/outcomes/{name}", False)
    schema = _write(rows, f"{root}/data/{name}", False)
    return Staged(read, Entry(read + 1, DELTA, name, schema, read + 1, batch, name), decisions, rules, validated)


def _named(validated: DataFrame) -> DataFrame:
    """Cases that the batch's valid decisions name."""
    return validated.where("valid").select(*KEYS).distinct()


def publish(root: str, staged: Staged) -> bool:
    """Commits a staged batch as the version after the one it was decided on; False if that is taken."""
    return create_if_absent(staged.decisions.sparkSession, _log_path(root, staged.entry.version), staged.entry.text())


def rebase(root: str, staged: Staged) -> Staged | None:
    """The staged batch on top of commits made since, if they touched none of its cases; else None.

    A batch may then also not have a column that one of them added with another type."""
    spark = staged.decisions.sparkSession
    since = [entry(spark, root, v) for v in versions(spark, root) if v > staged.read]
    named = _named(validated_decisions(staged.decisions, staged.rules) if staged.validated is None else staged.validated)
    types = {f.name: f.dataType for f in staged.entry.schema.fields}
    for e in since:
        if any(types.get(f.name, f.dataType) != f.dataType for f in e.schema.fields):
            return None
        if e.kind == DELTA:
            keys = spark.read.schema(e.schema).parquet(f"{root}/data/{e.data}").select(*KEYS)
            if not keys.join(named, KEYS, "left_semi").isEmpty():
                return None
    now = max([staged.read, *[e.version for e in since]])
    return replace(staged, read=now, entry=replace(staged.entry, version=now + 1, as_of=now + 1))


def discard(root: str, staged: Staged) -> None:
    """Removes the files of a staged batch that will not be committed."""
    spark = staged.decisions.sparkSession
    for kind in ("data", "outcomes"):
        _drop(spark, f"{root}/{kind}/{staged.entry.data}")


def commit_batch(
    root: str,
    decisions: DataFrame,
    rules: tuple[RuleSpec, ...] = RULES,
    batch: str | None = None,
    staged: Staged | None = None,
    attempts: int = 20,
) -> Entry:
    """Decides and commits a batch however many other writers there are; the commit.

    With a ``batch`` name the batch is committed once: if the log has a commit of that name, for example
    of a run that ended before it got its answer, that commit is returned. ``staged`` continues a batch
    that was staged already. After ``attempts`` lost races LostRace is raised and nothing is left."""
    spark = decisions.sparkSession
    validated = staged.validated if staged else None
    for _ in range(attempts):
        if batch is not None and (done := committed(spark, root, batch)):
            if staged:
                discard(root, staged)
            return done
        staged = staged or stage(root, decisions, rules, batch, validated)
        validated = staged.validated
        if publish(root, staged):
            return staged.entry
        moved = rebase(root, staged)
        if moved is None:
            discard(root, staged)
        staged = moved
    if staged:
        discard(root, staged)
    raise LostRace(f"no commit after {attempts} attempts")


def committed(spark: SparkSession, root: str, batch: str) -> Entry | None:
    """The commit of a named batch among all commits."""
    for v in reversed(versions(spark, root)):
        e = entry(spark, root, v)
        if e.batch == batch:
            return e
    return None


def outcomes(spark: SparkSession, root: str, e: Entry) -> DataFrame:
    """Outcome of every decision of a committed batch."""
    return spark.read.parquet(f"{root}/outcomes/{e.outcomes}")


def compact(spark: SparkSession, root: str, attempts: int = 20) -> Entry | None:
    """Writes the newest version as a new base; None if it is one already. Rows are the same before and after."""
    at = latest(spark, root)
    if len(chain(spark, root, at)) == 1:
        return None
    name = uuid.uuid4().hex
    schema = _write(read_log(spark, root, at), f"{root}/data/{name}", True)
    for _ in range(attempts):
        e = Entry(latest(spark, root) + 1, BASE, name, schema, at)
        if create_if_absent(spark, _log_path(root, e.version), e.text()):
            return e
    _drop(spark, f"{root}/data/{name}")
    raise LostRace(f"no commit after {attempts} attempts")


def vacuum(spark: SparkSession, root: str, keep: int = 2, orphans_after: dt.timedelta = dt.timedelta(days=1)) -> list[str]:
    """Removes data that none of the newest ``keep`` versions needs, and files of writers that ended
    without a commit, once they are older than ``orphans_after``; names of the folders removed.

    Outcomes and the log itself stay."""
    known = versions(spark, root)
    needed = {e.data for v in known[-keep:] for e in chain(spark, root, v)}
    logged = {entry(spark, root, v).data for v in known}
    fs, p = _fs(spark, f"{root}/data")
    limit = (dt.datetime.now(dt.timezone.utc) - orphans_after).timestamp() * 1000
    gone = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name not in needed and (name in logged or s.getModificationTime() < limit):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
