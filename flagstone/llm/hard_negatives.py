"""Hard negatives by Four-Russians scoring: exact integer inner products from table lookups.

A vector becomes integers. Of every eight dimensions an anchor's 256 subset sums are computed once. A
candidate's integers are held as bit planes in two's complement, eight dimensions to a byte, so that
a byte indexes the table of its group: the looked-up sums of a plane, added over the groups, are the
plane's share of the inner product, and shift-add over the planes gives the whole, exact score.

Candidates are packed into blocks once. Each task takes one block of anchors and one slice of the
candidate blocks, which stream past it; it keeps no more than the best few rows of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.llm.common import in_arrow, ship, written

#: Anchors whose tables a task holds at a time, and candidates in a packed block.
ANCHORS, BLOCK = 512, 2048
#: Parts of the candidates that are scored by different tasks for the same anchors.
SLICES = 8
#: Integers stay below this, so that the score of up to 1,024 dimensions fits a long.
LARGEST = 1 << 26
LOWEST = np.iinfo(np.int64).min

PACKED = "dim int, slice int, block int, kind int, ids binary, marks binary, labels binary, data binary, lows binary, highs binary"


def usable(rows: DataFrame, ident: str, label: str, vector: str, scale: int) -> DataFrame:
    """Distinct (id, label, v, dim) of the rows that take part; ``v`` holds floor(scale * x) of each component x."""
    v = F.col(vector)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST)
    good = F.col(ident).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, fits)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    found = rows.filter(good).select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.size(v).alias("dim"))
    return found.distinct()


def planes_of(v: np.ndarray) -> np.ndarray:
    """Bit planes (plane, group, row) of integers (row, dimension), the sign's plane last."""
    rows, dim = v.shape
    padded = np.zeros((rows, -(-dim // 8) * 8), np.int32)
    padded[:, :dim] = v
    count = int(np.where(v < 0, ~v, v).max(initial=0)).bit_length() + 1
    return np.stack([np.packbits((padded >> p) & 1 != 0, axis=1, bitorder="little").T for p in range(count)])


def tables_of(v: np.ndarray) -> np.ndarray:
    """Subset sums (group, subset, anchor) of anchors (anchor, dimension)."""
    count, dim = v.shape
    groups = -(-dim // 8)
    padded = np.zeros((count, groups * 8), np.int64)
    padded[:, :dim] = v
    sums = np.zeros((groups, 256, count), np.int64)
    parts = padded.reshape(count, groups, 8).transpose(1, 2, 0)
    for j in range(8):
        np.add(sums[:, : 1 << j], parts[:, j : j + 1], out=sums[:, 1 << j : 2 << j])
    # the sums of a plane over all groups stay in 32 bits
    return sums.astype(np.int32) if np.abs(padded).sum(axis=1, initial=0).max(initial=0) < 2**31 else sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (anchor, row) by lookups, from the sign's plane down by shift and add."""
    total = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for p in range(len(planes) - 1, -1, -1):
        plane = np.zeros(total.shape, tables.dtype)
        for table, index in zip(tables, planes[p], strict=True):
            plane += table[index]
        total = (total << 1) + plane if p < len(planes) - 1 else -plane.astype(np.int64)
    return np.ascontiguousarray(total.T)


class Best:
    """The first ``keep`` rows, best score first and smaller id first, within each of an anchor's ranges of scores."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, keep: int):
        self.highs, self.keep = highs.tolist(), keep
        self.floors = lows.tolist()
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.floors]

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        if not self.floors:
            return
        near = np.flatnonzero((score >= min(self.floors)) & (score <= max(self.highs)))
        if not len(near):
            return
        score, ids = score[near], ids[near]
        for k, (low, high) in enumerate(zip(self.floors, self.highs, strict=True)):
            inside = (score >= low) & (score <= high)
            if not inside.any():
                continue
            s, i = np.concatenate([self.rows[k][0], score[inside]]), np.concatenate([self.rows[k][1], ids[inside]])
            if len(s) > self.keep:
                may = s >= np.partition(s, len(s) - self.keep)[len(s) - self.keep]
                s, i = s[may], i[may]
            first = np.lexsort((i, -s))[: self.keep]
            self.rows[k] = (s[first], i[first])
            if len(first) == self.keep:
                self.floors[k] = max(low, int(s[first[-1]]))  # an equal score may still win by its id


def packed_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`usable` as blocks of one dimension, each ordered by label and id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            dims, flat = batch.column(3).to_numpy(), batch.column(2)
            starts, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = values[starts[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int32)
                held = waiting.pop(dim, None)
                now = (ids[at], labels[at], v) if held is None else tuple(np.concatenate(p) for p in zip(held, (ids[at], labels[at], v), strict=True))
                while len(now[0]) >= BLOCK:
                    yield block(dim, number, *(x[:BLOCK] for x in now))
                    now, number = tuple(x[BLOCK:] for x in now), number + 1
                if len(now[0]):
                    waiting[dim] = now
        for dim, now in waiting.items():
            yield block(dim, number, *now)
            number += 1

    def block(dim: int, number: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, labels))
        row = {"dim": dim, "slice": number % SLICES, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "data": planes_of(v[order]).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("slice", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary())]))

    return in_arrow(rows.select("id", "label", "v", "dim"), pack, "dim int, slice int, ids binary, labels binary, data binary")


def packed_anchors(anchors: DataFrame) -> DataFrame:
    """anchors (block, dim, id, mark, label, v, lows, highs) as a row per block; a block's number comes from a hash of whole rows."""

    def pack(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        numbers = lambda c: column(c).to_numpy().astype(np.int64).tobytes()
        ranges = lambda c: np.array([len(x) for x in column(c)] + column(c).flatten().to_pylist(), np.int64).tobytes()
        row = {
            "dim": table.column("dim")[0].as_py(),
            "block": table.column("block")[0].as_py(),
            "ids": numbers("id"),
            "marks": numbers("mark"),
            "labels": numbers("label"),
            "data": column("v").flatten().to_numpy().astype(np.int32).tobytes(),
            "lows": ranges("lows"),
            "highs": ranges("highs"),
        }
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "marks", "labels", "data", "lows", "highs")]]))

    ship(anchors.sparkSession)
    return anchors.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, marks binary, labels binary, data binary, lows binary, highs binary")


def best_rows(anchors: DataFrame, candidates: DataFrame, keep: int, same_label: bool, anchor_blocks: int) -> DataFrame:
    """(anchor, mark, dim, range, id, score): the best ``keep`` candidates per slice in each of an anchor's ranges of scores.

    Candidates have the anchor's label (``same_label``; its own id left out) or another one.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (dim, _, _), group in groupby(rows, lambda r: (r["dim"], r["block"], r["slice"])):
            first = next(group)
            if first["kind"] == 1:
                for _ in group:
                    pass
                continue  # candidates without anchors of their dimension
            anchor_ids, marks, anchor_labels = (np.frombuffer(first[c], np.int64) for c in ("ids", "marks", "labels"))
            lows, highs = (split_ranges(first[c], len(anchor_ids)) for c in ("lows", "highs"))
            best = [Best(low, high, keep) for low, high in zip(lows, highs, strict=True)]
            tables = tables_of(np.frombuffer(first["data"], np.int32).reshape(len(anchor_ids), dim))
            of_label = {x: np.flatnonzero(anchor_labels == x) for x in np.unique(anchor_labels).tolist()}
            for r in group:
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                groups = -(-dim // 8)
                planes = np.frombuffer(r["data"], np.uint8).reshape(-1, groups, len(ids)) if groups else np.zeros((1, 0, len(ids)), np.uint8)
                if not same_label:
                    found = scores(tables, planes)
                for label, members in of_label.items():
                    a, b = np.searchsorted(labels, [label, label + 1]).tolist()
                    if same_label and a < b:
                        part = scores(tables[:, :, members], planes[:, :, a:b])
                        for k, m in enumerate(members.tolist()):
                            others = ids[a:b] != anchor_ids[m]
                            best[m].offer(part[k][others], ids[a:b][others])
                    elif not same_label:
                        for m in members.tolist():
                            found[m, a:b] = LOWEST
                            best[m].offer(found[m], ids)
            out = [(anchor_ids[m], marks[m], k, s, i) for m, x in enumerate(best) for k, (s, i) in enumerate(x.rows) if len(s)]
            if out:
                counts = [len(s) for *_, s, _ in out]
                again = lambda x: np.repeat(np.array(x), counts)  # noqa: B023, E731
                columns = [again([x[0] for x in out]), again([x[1] for x in out]), np.full(sum(counts), dim, np.int32), again([x[2] for x in out]).astype(np.int32)]
                columns += [np.concatenate([x[4] for x in out]), np.concatenate([x[3] for x in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "mark", "dim", "range", "id", "score"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None).cast("binary")
    asked = packed_anchors(anchors).withColumn("slice", every(SLICES)).withColumn("kind", F.lit(0))
    offered = candidates.withColumn("block", every(anchor_blocks)).withColumn("kind", F.lit(1))
    offered = offered.withColumns({c: nothing for c in ("marks", "lows", "highs")})
    keys, fields = ["dim", "block", "slice"], [x.split()[0] for x in PACKED.split(", ")]
    both = asked.select(fields).union(offered.select(fields)).repartition(anchor_blocks * SLICES, *keys)
    return in_arrow(both.sortWithinPartitions(*keys, "kind"), score, "anchor long, mark long, dim int, range int, id long, score long")


def split_ranges(data: bytes, count: int) -> list[np.ndarray]:
    flat = np.frombuffer(data, np.int64)
    return np.split(flat[count:], np.cumsum(flat[:count])[:-1])


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    ident: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) of the components. An anchor is a row for which
    ``anchors``, a condition on the columns of ``rows``, holds. Its positives are the ``positives``
    best other rows of its label; for each of them the ``negatives`` best rows of other labels follow
    whose score is ``low`` to ``high`` percent of the positive's. Better is the higher score, then
    the smaller id. Fewer rows come where there are fewer; a negative positive score has none.

    No part take rows with a null id, label or vector, with a null or non-finite component, or with
    one of which floor(scale * x) is not within 2**26. Rows equal in id, label and vector are one;
    other rows that share an id are each a row, but none is a positive of its own id. Only vectors of
    one dimension are compared. An empty table gives no rows. Other columns are not read.
    """
    table = written(usable(rows, ident, label, vector, scale), "vectors")
    chosen = usable(rows.filter(anchors), ident, label, vector, scale).withColumn("mark", F.xxhash64("id", "label", "v"))
    chosen = written(chosen, "anchors")
    blocks = 1 + chosen.count() // ANCHORS
    placed = chosen.withColumn("block", F.pmod("mark", F.lit(blocks)).cast("int"))
    candidates = written(packed_candidates(table), "blocks")

    bounds = lambda x: F.array(F.lit(x).cast("long"))
    whole = placed.withColumns({"lows": bounds(-(2**63) + 1), "highs": bounds(2**63 - 1)})
    first = best_rows(whole, candidates, positives, True, blocks)
    top = Window.partitionBy("anchor", "mark", "dim").orderBy(F.desc("score"), "id")
    pairs = first.withColumn("range", F.row_number().over(top) - 1).filter(F.col("range") < positives)
    pairs = written(pairs.select("anchor", "mark", "dim", "range", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    p = F.col("positive_score")
    least, most = F.ceil(p * low / F.lit(100).cast("decimal(20,0)")), F.floor(p * high / F.lit(100).cast("decimal(20,0)"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("range", x.cast("long").alias("x")))), lambda s: s["x"])
    ranges = pairs.groupBy(F.col("anchor").alias("id"), "mark", "dim").agg(ordered(least).alias("lows"), ordered(most).alias("highs"))
    second = best_rows(placed.join(ranges, ["id", "mark", "dim"]), candidates, negatives, False, blocks)
    keys = ["anchor", "mark", "dim", "range"]
    last = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ranked = second.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= negatives)
    named = {"anchor": "anchor_id", "id": "negative_id", "score": "negative_score"}
    return ranked.join(pairs, keys).withColumnsRenamed(named).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
