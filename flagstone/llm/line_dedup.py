"""Line dedup: range-partitioned line keys, sorted by document and position, streamed once.

Only keys, ids and positions are shuffled. The result is a compressed bitmap per document that
tells which lines stay; ``apply_bitmaps`` puts it to the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import BLANKS, free_prefix, in_arrow, written

DROP, EDGE, MARK = 0, 1, 2
ROWS = "doc long, row long, pos int, kind int, h1 long, h2 long, n_docs long"


def line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) to (h1, h2, doc, row, pos) of each line whose key isn't empty: 128 bits of the key's hash."""
    for batch in batches:
        lines = pc.split_pattern(pc.fill_null(batch.column(2), ""), "\n")
        keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=BLANKS))
        owner = pc.list_parent_indices(lines).to_numpy()
        pos = np.arange(len(owner)) - lines.offsets.to_numpy()[owner] + lines.offsets[0].as_py()
        full = np.flatnonzero(pc.binary_length(keys).to_numpy(zero_copy_only=False))
        digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.take(pa.array(full)).to_pylist())
        hashes = np.frombuffer(digests, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(hashes[:, i].copy()) for i in (0, 1)], *[batch.column(i).take(pa.array(owner[full])) for i in (0, 1)], pa.array(pos[full].astype(np.int32))],
            names=["h1", "h2", "doc", "row", "pos"],
        )


class Stream:
    """One sorted partition of (h1, h2, doc, row, pos): decides each key as it goes by.

    Rows of the running key wait until it is known to be in ``least`` documents, so no more than
    that many documents' rows are held, however often the key occurs. The partition's first and
    last keys can go on in its neighbours: what their count here leaves open goes out as EDGE rows,
    with one MARK of the count and the first row.
    """

    def __init__(self, least: int, keep_first: bool):
        self.least, self.keep_first = least, keep_first
        self.out: list[np.ndarray] = []
        self.key: tuple[int, int] | None = None
        self.first_key = True

    def emit(self, rows: np.ndarray, kind: int, n_docs: int = 0) -> None:
        if len(rows):
            self.out.append(np.column_stack([rows[:, 2:], np.full(len(rows), kind), rows[:, :2], np.full(len(rows), n_docs)]))

    def close(self, edge: bool) -> None:
        """The running key is over (or the partition is, if ``edge``)."""
        if self.key is None:
            return
        if edge or self.first_key:
            self.emit(self.waiting, EDGE)
            if self.flushed and self.keep_first:
                self.emit(self.start, EDGE)
            self.emit(self.start, MARK, self.docs)
        self.first_key = False

    def feed(self, rows: np.ndarray) -> None:
        new_key = np.ones(len(rows), bool)
        new_key[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        new_doc = new_key.copy()
        new_doc[1:] |= (rows[1:, 2:4] != rows[:-1, 2:4]).any(1)
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], len(rows))
        docs = np.add.reduceat(new_doc, starts) if len(rows) else []
        # keys that begin and end inside this batch: by far the most, decided at once
        inner = np.zeros(len(starts), bool)
        inner[1:-1] = True
        frequent = inner & (np.asarray(docs) >= self.least)
        for k in (0, len(starts) - 1)[: min(2, len(starts))]:
            if k == len(starts) - 1 and frequent.any():
                self.inner(rows, starts, ends, frequent)
            self.run(rows[starts[k] : ends[k]], int(docs[k]))

    def inner(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, frequent: np.ndarray) -> None:
        lost = np.repeat(frequent, ends - starts)
        if self.keep_first:
            lost[starts] = False
        self.emit(rows[lost], DROP)

    def run(self, rows: np.ndarray, docs: int) -> None:
        """Rows of one key, perhaps the running one."""
        key = (int(rows[0, 0]), int(rows[0, 1]))
        if key != self.key:
            self.close(False)
            self.key, self.docs, self.flushed, self.start = key, 0, False, rows[:1]
            self.waiting, self.last = rows[:0], None
        self.docs += docs - (self.last == tuple(rows[0, 2:4]))
        self.last = tuple(rows[-1, 2:4])
        if self.docs < self.least:
            self.waiting = np.concatenate([self.waiting, rows])
            return
        lost = np.concatenate([self.waiting, rows])
        if not self.flushed and self.keep_first:
            lost = lost[1:]
        self.emit(lost, DROP)
        self.waiting, self.flushed = rows[:0], True

    def taken(self) -> pa.RecordBatch:
        rows = np.concatenate(self.out) if self.out else np.empty((0, 7), np.int64)
        self.out = []
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int64]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(k)) for i, k in enumerate(kinds)], names=["doc", "row", "pos", "kind", "h1", "h2", "n_docs"])


def dropped_lines(rows: DataFrame, least: int, keep_first: bool, partitions: int | None) -> DataFrame:
    """(doc, row, pos) of the lines to drop, from ``rows`` (doc long, row long, text string)."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(least, keep_first)
        for batch in batches:
            if batch.num_rows:
                stream.feed(np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
                yield stream.taken()
        stream.close(True)
        yield stream.taken()

    keys = in_arrow(rows, line_keys, "h1 long, h2 long, doc long, row long, pos int")
    order = ["h1", "h2", "doc", "row"]
    # the document is part of the range key, so the rows of one frequent line are spread over partitions
    ranged = keys.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order, "pos")
    decided = written(in_arrow(ranged, streamed, ROWS), "line-decisions")
    marks = decided.filter(F.col("kind") == MARK)
    totals = marks.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.min(F.struct("doc", "row", "pos")).alias("first"))
    edges = decided.filter(F.col("kind") == EDGE).join(totals.filter(F.col("n") >= least), ["h1", "h2"])
    if keep_first:
        edges = edges.filter(F.struct("doc", "row", "pos") != F.col("first"))
    return decided.filter(F.col("kind") == DROP).select("doc", "row", "pos").union(edges.select("doc", "row", "pos"))


def identity(ident: str, text: str) -> tuple[Column, Column]:
    """The id, the least long if null, and a hash of the text.

    Both together tell documents apart, also those with the same id; repeated rows share them.
    """
    return F.coalesce(F.col(f"`{ident}`").cast("long"), F.lit(-(2**63))), F.xxhash64(F.col(f"`{text}`"))


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    keep_first: bool = False,
    ident: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Per distinct document: doc, row (its identity), n_lines, n_dropped (long), keep_bitmap (binary).

    A line's key is the line stripped of blanks at both ends with A-Z lowered. A key that isn't
    empty and is found in ``min_docs`` documents or more loses all its lines, or with
    ``keep_first`` all but the first by id and position. Lines are split at \\n, so a null or
    empty text has one empty line, which always stays. ``keep_bitmap`` is the zlib-compressed
    bits of the lines, first line first, 1: stays. Repeated rows count as one document. A null id
    is an id like any other; columns beside ident (an integer) and text are not read.
    """
    text_col = F.coalesce(F.col("text"), F.lit(""))
    doc, row = identity(ident, text)
    rows = docs.select(doc.alias("doc"), row.alias("row"), F.col(f"`{text}`").alias("text"))
    lost = dropped_lines(rows, min_docs, keep_first, partitions).groupBy("doc", "row").agg(F.collect_set("pos").alias("lost"))
    size = (F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1).cast("long")
    sizes = rows.select("doc", "row", size.alias("n_lines")).distinct()

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                bits = np.ones(n, np.uint8)
                if gone.is_valid:
                    bits[gone.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                counts.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
                names=["doc", "row", "n_lines", "n_dropped", "keep_bitmap"],
            )

    both = sizes.join(lost, ["doc", "row"], "left").select("doc", "row", "n_lines", "lost")
    return in_arrow(both, bitmaps, "doc long, row long, n_lines long, n_dropped long, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``line_dedup``: n_lines, n_dropped and kept_text.

    Every row of ``docs`` comes back once, repeated rows included; kept_text is '' where all lines go.
    A column of ``docs`` named line_dedup is replaced, the others stay.
    """
    own = free_prefix(docs)
    keys = [own + "doc", own + "row"]
    maps = bitmaps.select(F.col("doc").alias(keys[0]), F.col("row").alias(keys[1]), F.struct("n_lines", "n_dropped", "keep_bitmap").alias(own + "map"))
    both = docs.withColumns(dict(zip(keys, identity(ident, text), strict=True))).join(maps, keys)
    both = both.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "line_dedup"], own + "map")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            infos, kept = batch.column(batch.num_columns - 1), []
            for t, n, gone, bits in zip(texts, *[infos.field(i).to_pylist() for i in range(3)], strict=True):
                t = t or ""
                if gone:
                    stays = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n)
                    t = "\n".join(line for line, s in zip(t.split("\n"), stays, strict=True) if s)
                kept.append(t)
            done = pa.StructArray.from_arrays([infos.field(0), infos.field(1), pa.array(kept, pa.string())], names=["n_lines", "n_dropped", "kept_text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], done], names=[*batch.schema.names[:-1], "line_dedup"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name.lower() != "line_dedup")
    return in_arrow(both, cut, f"{fields}, line_dedup struct<n_lines: bigint, n_dropped: bigint, kept_text: string>")
