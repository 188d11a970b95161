"""URL rules in a sorted digest array: 64-bit xxhash keys, binary search, full-string confirmation.

``pack`` turns the rules into one file: the sorted keys, the offsets and the rule strings. The file
is handed to the executors with ``SparkContext.addFile`` and memory-mapped there, so a worker
touches only the pages that a search visits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.llm.common import in_arrow, lower_ascii, served_file

#: Largest packed rule file that is handed to every executor.
MAX_PACKED_BYTES = 512 * 1024 * 1024


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """Rules (verdict, host, path) as bytes: header, sorted keys, string ends, verdicts, path lengths, strings.

    Equal rules with different verdicts: the last one given holds.
    """
    texts = {f"{host.lower()}{path}": (verdict == "block", len(host)) for verdict, host, path in rules}
    order = sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t.encode()), t))
    keys = np.array([xxhash.xxh64_intdigest(t.encode()) for t in order], np.uint64)
    blobs = [t.encode() for t in order]
    ends = np.cumsum([len(b) for b in blobs], dtype=np.int64)
    host_chars = np.array([texts[t][1] for t in order], np.int64)
    blocks = np.array([texts[t][0] for t in order], np.int64)
    lengths = np.unique([len(t) - texts[t][1] for t in order]).astype(np.int64)
    head = struct.pack("<qq", len(order), len(lengths))
    return b"".join([head, keys.tobytes(), ends.tobytes(), host_chars.tobytes(), blocks.tobytes(), lengths.tobytes(), *blobs])


class DigestArray:
    """A packed rule file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, n_lengths = struct.unpack("<qq", raw[:16].tobytes())
        at, parts = 16, []
        for kind, count in ((np.uint64, n), (np.int64, n), (np.int64, n), (np.int64, n), (np.int64, n_lengths)):
            parts.append(raw[at : at + 8 * count].view(kind))
            at += 8 * count
        self.keys, self.ends, self.host_chars, self.blocks, self.lengths = parts
        self.strings = raw[at:]

    def string(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, texts: list[str], host_chars: list[int]) -> np.ndarray:
        """Position of each text's rule, -1 where none: binary search on the keys, then the strings compared."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1)
        digests = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, digests)
        end = np.searchsorted(self.keys, digests, "right")
        out = np.full(len(texts), -1)
        for k in np.flatnonzero(at < end):
            for i in range(at[k], end[k]):
                if self.host_chars[i] == host_chars[k] and self.string(i) == texts[k].encode():
                    out[k] = i
        return out


def suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains of at most ``longest`` characters, so that a host of many dots makes few."""
    spare = len(host) - longest
    out, at = ([host], host.find(".")) if spare <= 0 else ([], host.find(".", spare - 1))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def host_and_path(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host and path of ``url``; both empty for null or a url without ``://``."""
    rest = F.when(F.contains(F.col(url), F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumn("host", lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], ident: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """ident, host, path, rule and verdict of every row of ``pages``.

    A rule fits its host and every subdomain if the path starts with the rule's path; the longest
    rule (host and path, then host alone) wins. Without one, the rule is null and the verdict is
    ``otherwise``. Null urls and urls without ``://`` have empty host and path, which no rule fits.
    Repeated rows are judged one by one; other columns are not read. The packed rules are bounded
    by MAX_PACKED_BYTES, checked here.
    """
    packed = pack(rules)
    if len(packed) > MAX_PACKED_BYTES:
        raise ValueError(f"{len(packed)} bytes of rules; at most {MAX_PACKED_BYTES}")
    name = f"url-rules-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(served_file(spark, name, packed))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = DigestArray(SparkFiles.get(name))
        lengths, longest = [int(x) for x in store.lengths], int(max(store.host_chars, default=0))
        for batch in batches:
            owner, texts, chars = [], [], []
            for row, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for part in suffixes(host, longest) if host else ():
                    for n in lengths:
                        if n <= len(path):
                            owner.append(row)
                            texts.append(part + path[:n])
                            chars.append(len(part))
            found = store.find(texts, chars)
            best: dict[int, tuple[int, int, int]] = {}
            for k in np.flatnonzero(found >= 0):
                mine = (len(texts[k]), chars[k], int(k))
                best[owner[k]] = max(best.get(owner[k], mine), mine)
            rule = [texts[best[r][2]] if r in best else None for r in range(batch.num_rows)]
            verdict = [("block" if store.blocks[found[best[r][2]]] else "allow") if r in best else otherwise for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[ident, "host", "path", "rule", "verdict"])

    parts = host_and_path(pages.select(F.col(ident), F.col(url).alias("__url")), "__url").select(ident, "host", "path")
    kind = parts.schema[ident].dataType.simpleString()
    return in_arrow(parts, judged, f"`{ident}` {kind}, host string, path string, rule string, verdict string")
