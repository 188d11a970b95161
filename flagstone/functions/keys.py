"""Case keys and blank-safe text helpers (Column -> Column)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the warehouse's TRIM strips (Unicode white space) and what the trim of a form
# field strips (the blanks and line ends of a script, among them U+FEFF but not U+0085).
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WAREHOUSE_BLANKS = _BLANKS + "\u0085"
_FORM_BLANKS = _BLANKS + "\ufeff"


def _edges(c: Column | str, blanks: str) -> Column:
    # a trim looks at the ends of a text, a pattern tries each of its places
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(blanks))


def blank_trim(c: Column | str) -> Column:
    """Strip every Unicode blank from both ends, as the warehouse does."""
    return _edges(c, _WAREHOUSE_BLANKS)


def form_trim(c: Column | str) -> Column:
    """Strip the blanks of a form field from both ends."""
    return _edges(c, _FORM_BLANKS)


def utc_date(c: Column, dtype: T.DataType) -> Column:
    """Date in UTC: of an instant whatever the session time zone, of a wall clock as it stands."""
    if isinstance(dtype, T.TimestampType):
        return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))
    return F.to_date(c)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters above U+FFFF count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def longer_in_utf16(c: Column, most: int) -> Column:
    """Whether a text has more than ``most`` UTF-16 units; only one of more bytes can, and is counted."""
    return (F.octet_length(c) > most) & (utf16_length(c) > most)


def key_part(spec: str) -> Column:
    """One key column as text; ``name:date`` keeps only the date of a timestamp. NULL -> ''."""
    name, _, kind = spec.partition(":")
    col = F.col(name)
    if kind == "date":
        text = F.date_format(F.to_date(col), "yyyy-MM-dd")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def case_key(key_cols: list[str] | tuple[str, ...]) -> Column:
    """Pipe-joined key. NULL parts become '' but keep their separator, so a key is never NULL
    and (a, NULL, b) differs from (NULL, a, b)."""
    return F.concat_ws("|", *[key_part(k) for k in key_cols])


def is_blank_key(key: Column) -> Column:
    """True when a key holds nothing but separators (an all-blank record)."""
    return F.replace(key, F.lit("|"), F.lit("")) == F.lit("")
