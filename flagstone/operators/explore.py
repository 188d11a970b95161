"""Table exploration as DataFrame operators: search, type-aware sort, paging, distinct values,
suggestion lists. The reference does these in the browser over a fetched result; here they
run where the data is, and only the page the caller asks for leaves Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.text import display_text, raw_text
from flagstone.operators.render import resolve_columns

# ---------------------------------------------------------------------------------------
# Fixed values of the reference's table screens.
# ---------------------------------------------------------------------------------------
PAGE_SIZE = 50
PERSON_KEYS = ("sales_person", "assignedTo", "first_assignee")
NUMERIC_TYPES = ("money", "num", "int")

# Own scale limits. Rows one task may hold for the top-k of a page; ranges per refinement step (a
# collected table of one small row per range).
MAX_TASK_ROWS = 10_000
MAX_RANGES = 4096


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty text values of one column, sorted."""
    c = F.col(column)
    return df.where(c.isNotNull() & (c != "")).select(c.alias(column)).distinct().orderBy(column)


def person_suggestions(flagged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct union of person columns of flagged rows and past decided sales persons (H1)."""
    parts = [flagged.select(F.col(k).cast("string").alias("suggestion")) for k in PERSON_KEYS if k in flagged.columns]
    parts.append(reviews.select(F.col("decided_sales_person").alias("suggestion")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    s = F.col("suggestion")
    return u.where(s.isNotNull() & (s != "")).distinct().orderBy("suggestion")


def haystack(df: DataFrame, types: dict[str, str] | None = None) -> Column:
    """Search text of a row: display text and raw text of every column, space-joined, lower case."""
    types = types or {c.key: c.type for c in resolve_columns(df.schema)}
    parts = []
    for f in df.schema.fields:
        parts.append(display_text(F.col(f.name), types[f.name], f.dataType))
        parts.append(raw_text(F.col(f.name), f.dataType))
    return F.lower(F.concat_ws(" ", *parts))


def search_rows(df: DataFrame, text: str | None, types: dict[str, str] | None = None) -> DataFrame:
    """Rows whose search text contains the trimmed, lower-cased query (N1); a blank query
    keeps every row. A match may span two cells, as in the reference."""
    q = (text or "").strip().lower()
    if not q:
        return df
    return df.where(F.instr(haystack(df, types), q) > 0)


def natural_key(c: Column) -> Column:
    """Sort key comparing text by language rules (a1 before B1) and digit runs as numbers of any
    length: each run is written without leading zeros behind its own length."""
    runs = F.regexp_extract_all(c.cast("string"), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def sized(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    key = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), sized(r)).otherwise(r))
    return F.collate(F.array_join(key, ""), "UNICODE")


SortKey = tuple[Column, bool]  # (expression, descending)


def sort_keys(
    df: DataFrame,
    column: str,
    descending: bool = False,
    col_type: str | None = None,
    base_order: list[tuple[str, bool]] | None = None,
) -> list[SortKey]:
    """Keys of the type-aware column sort (G3): numbers and booleans numerically, other values
    as text with digit runs compared as numbers; blanks (NULL, '') last ascending and first
    descending (the whole comparison is negated); ties keep the base order, which should end
    in a unique column so the order is total."""
    f = df.schema[column]
    col_type = col_type or resolve_columns(T.StructType([f]))[0].type
    c = F.col(column)
    blank = c.isNull() | (c.cast("string") == "")
    value = c.cast("double") if col_type in NUMERIC_TYPES or col_type == "bool" else natural_key(c)
    value = F.when(~blank, value)  # two blanks compare equal: the base order decides
    keys: list[SortKey] = [(blank, descending), (value, descending)]
    keys += [(F.col(name), desc) for name, desc in (base_order or [])]
    return keys


def _order(keys: list[SortKey], reverse: bool = False) -> list[Column]:
    out = []
    for expr, desc in keys:
        if desc != reverse:
            out.append(expr.desc_nulls_last())
        else:
            out.append(expr.asc_nulls_first())
    return out


def sort_rows(df: DataFrame, keys: list[SortKey]) -> DataFrame:
    return df.orderBy(*_order(keys))


def page_count(df: DataFrame, page_size: int = PAGE_SIZE) -> int:
    """Number of pages (at least 1), from one distributed count."""
    n = df.count()
    return max(1, -(-n // page_size))


def page(
    df: DataFrame,
    keys: list[SortKey],
    number: int,
    page_size: int = PAGE_SIZE,
    total_rows: int | None = None,
    max_task_rows: int = MAX_TASK_ROWS,
    directory: PageDirectory | None = None,
) -> DataFrame:
    """One page of ``df`` in the order of ``keys`` (G4); the page number is clamped to the last page.

    With the ``directory`` of these rows and keys (:func:`page_directory`) the rows are neither counted
    nor shuffled: it names the keys between which the page lies.

    Rows that tie on the keys are ordered by a hash of the whole row, on every page, so that pages
    neither repeat nor skip rows; only identical rows tie after that, and any of them will do. While
    more than ``max_task_rows`` rows may precede the page, the rows are range-partitioned on the
    keys and counted per range (one small row per range); only the ranges that cover the page are
    kept, by a filter on their first and last key. The page is then a top-k inside those rows, so
    neither a task nor the one that merges their rows holds more than about ``max_task_rows`` of
    each task, whatever the page number."""
    if directory is not None:
        total_rows = directory.rows
    n = total_rows if total_rows is not None else df.count()
    last = max(1, -(-n // page_size)) - 1
    safe = min(max(number, 0), last)
    start = safe * page_size
    size = max(0, min(page_size, n - start))
    keys = _total(df, keys)
    part, rows = df, n
    while start + size > max_task_rows:
        known = directory or page_directory(part, keys, max_task_rows, rows, total=True)
        lo_text, hi_text, types, skipped, covered = known.covering(start, size)
        directory = None
        lo = [_restore(v, t) for v, t in zip(lo_text, types)]
        hi = [_restore(v, t) for v, t in zip(hi_text, types)]
        if lo_text == hi_text:  # the page lies inside one group of identical rows: any of them
            return part.where(_lex_equal(keys, lo)).limit(size)
        if covered >= rows:  # the page needs all ranges there are: two or three, as small as they get
            break
        part = part.where(~_lex_cmp(keys, lo, _before) & ~_lex_cmp(keys, hi, _after))
        start, rows = start - skipped, covered
    return part.orderBy(*_order(keys)).offset(start).limit(size)


def _total(df: DataFrame, keys: list[SortKey]) -> list[SortKey]:
    """``keys`` with a hash of the whole row behind them, so that only identical rows tie."""
    return keys + [(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), False)]


@dataclass(frozen=True)
class PageDirectory:
    """Where the rows of one order lie: ranges of it, each with its rows and its first and last key as exact text."""

    rows: int
    types: tuple[T.DataType, ...]
    ranges: tuple[tuple[int, tuple, tuple], ...]

    def covering(self, start: int, size: int) -> tuple[list, list, list[T.DataType], int, int]:
        """The first key of the range holding row ``start`` and the last key of the range holding the
        last of ``size`` rows, the key types, the rows before the first range and those of the ranges."""
        seen, first, skipped = 0, None, 0
        for n, lo, hi in self.ranges:
            if first is None and seen + n > start:
                first, skipped = lo, seen
            seen += n
            if first is not None and seen >= start + size:
                return list(first), list(hi), list(self.types), skipped, seen - skipped
        raise RuntimeError("rows changed between the count and the range statistics")

    def text(self) -> str:
        return json.dumps({"rows": self.rows, "types": [t.json() for t in self.types], "ranges": self.ranges})

    @staticmethod
    def parsed(text: str) -> PageDirectory:
        fields = json.loads(text)
        types = tuple(T._parse_datatype_json_string(t) for t in fields["types"])
        return PageDirectory(fields["rows"], types, tuple((n, tuple(lo), tuple(hi)) for n, lo, hi in fields["ranges"]))


def page_directory(df: DataFrame, keys: list[SortKey], max_task_rows: int = MAX_TASK_ROWS, rows: int | None = None, total: bool = False) -> PageDirectory:
    """Range-partitions ``df`` on the sort keys once and keeps the ranges' counts and border keys (one
    small row a range), for any number of pages of this order. Belongs to one version of the rows."""
    keys = keys if total else _total(df, keys)
    rows = df.count() if rows is None else rows
    names = [f"_k{i}" for i in range(len(keys))]
    kdf = df.select(*[e.alias(nm) for (e, _), nm in zip(keys, names)])
    order = _order([(F.col(nm), d) for nm, (_, d) in zip(names, keys)])
    ranges = min(MAX_RANGES, max(2, -(-2 * rows // max_task_rows)))
    types = [f.dataType for f in kdf.schema.fields]
    carried = F.struct(*[_carry(F.col(nm), t).alias(nm) for nm, t in zip(names, types)])
    stats = (
        kdf.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select(carried.alias("_b"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
        .groupBy("_p")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("_b", "_i").alias("_lo"), F.max_by("_b", "_i").alias("_hi"))
        .orderBy("_p")
        .collect()
    )
    return PageDirectory(sum(r._n for r in stats), tuple(types), tuple((r._n, tuple(r._lo), tuple(r._hi)) for r in stats))


def _carry(c: Column, t: T.DataType) -> Column:
    """A key value as exact text for the driver (instants as microseconds)."""
    return F.unix_micros(c).cast("string") if isinstance(t, T.TimestampType) else c.cast("string")


def _restore(v: str | None, t: T.DataType) -> Column | None:
    if v is None:
        return None
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(F.lit(int(v)))
    return F.lit(v).cast(t)


def _before(x: Column, b: Column | None, desc: bool) -> Column:
    """``x`` strictly before bound ``b`` in the key's order (ascending: NULLs first;
    descending: NULLs last)."""
    if not desc:
        return F.lit(False) if b is None else (x.isNull() | F.coalesce(x < b, F.lit(False)))
    return x.isNotNull() if b is None else F.coalesce(x > b, F.lit(False))


def _after(x: Column, b: Column | None, desc: bool) -> Column:
    if not desc:
        return x.isNotNull() if b is None else F.coalesce(x > b, F.lit(False))
    return F.lit(False) if b is None else (x.isNull() | F.coalesce(x < b, F.lit(False)))


def _equal(x: Column, b: Column | None) -> Column:
    return x.isNull() if b is None else F.coalesce(x == b, F.lit(False))


def _lex_cmp(keys: list[SortKey], bound: list, cmp) -> Column:
    """Lexicographic comparison of a row's keys with a bound: earlier keys equal, this one ``cmp``."""
    out, prefix = F.lit(False), F.lit(True)
    for (x, desc), b in zip(keys, bound):
        out = out | (prefix & cmp(x, b, desc))
        prefix = prefix & _equal(x, b)
    return out


def _lex_equal(keys: list[SortKey], bound: list) -> Column:
    out = F.lit(True)
    for (x, _), b in zip(keys, bound):
        out = out & _equal(x, b)
    return out
