"""Trie of the prefixes that conversations share, with totals of its subtrees by centroid decomposition.

A node is named by a 128-bit digest of its turns: the exclusive or, over the turns, of hashes of
position and turn. Prefix digests are therefore running aggregates that can be cut anywhere, and a
conversation of any length is spread over tasks.

A node's own figures are counted once, in the row of its smallest member. Sums of subtrees add up
over any division of these rows, as long as each row comes with its ancestors: a task takes
stretches of conversations, builds the forest of their parent edges and decomposes it. Each
component is split at its centroid, the node below which at most half of the component hangs; the
total of the part below it is added along the path from the centroid to the component's top, and
all parts are split again. So a forest of n nodes needs log n rounds, however deep it is. What
tasks found for a node is summed. Paths are cut at every :data:`DEPTH` turns; the nodes at the cuts
form a trie in their place, with the totals of the stretches below them, to which the same is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.llm.common import in_arrow, written

#: Turns after which a path is cut into another stretch.
DEPTH = 512
#: Rows of whole stretches from which a task makes a forest and starts the next one.
FOREST = 1 << 16
#: Conversations with neighbouring ids that are dealt together.
NEIGHBOURS = 64
#: Numbers in one row of a digest that is made of many.
NUMBERS = 4096
NODE = ["p1", "p2"]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv, block, place, turn_key, n_bytes) of all turns; blocks are ranges of a conversation, ``place`` counts from 1 in each.

    Turns come by number, null first, and at equal numbers by a digest of role and text.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("turn"), F.col("turn_key"), F.col("row")]  # row: equal turns go to several blocks
    dealt = written(rows, "turns").repartitionByRange("conv", *order).withColumn("block", F.spark_partition_id())
    placed = F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order))
    return written(dealt, "ranges").select("conv", "block", placed.alias("place"), "turn_key", "n_bytes")


def before(rows: DataFrame, what, out: str) -> DataFrame:
    """(conv, block, ``out``): the aggregate ``what`` over the earlier blocks of each conversation; null in the first."""
    parts = rows.groupBy("conv", "block").agg(*[x.alias(f"{out}{k}") for k, x in enumerate(what)])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    merge = F.sum if out == "count" else F.bit_xor
    return parts.select("conv", "block", *[merge(f"{out}{k}").over(earlier).alias(f"{out}{k}") for k in range(len(what))])


def rebuilt(turns: DataFrame, family: int, longest: int) -> DataFrame:
    """(conv, block, depth, turn_key, n_bytes, n_turns): conversations after their first turns gave way to those of another one.

    The first h turns, h being crc32 of the id modulo ``longest`` + 1, are those of the conversation
    whose id is the next multiple of ``family`` towards zero: all it has if fewer, none if it is absent.
    Every conversation has a row of depth 0.
    """
    offset = before(turns, [F.max("place")], "count")
    whole = written(turns.join(offset, ["conv", "block"]).withColumn("place", (F.col("place") + F.coalesce("count0", F.lit(0))).cast("long")).drop("count0"), "places")
    counts = whole.groupBy("conv").agg(F.max("place").alias("own"))
    heads = counts.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("own").alias("offered"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (longest + 1)
    convs = counts.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": h}).join(heads, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))))
    convs = written(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv", "base", "h", "taken", "n_turns"), "conversations")

    # a conversation's own places stay in their blocks; the join is by block, so a long one is not one task
    blocks = whole.select("conv", "block").distinct().join(convs, "conv")
    own = whole.join(blocks, ["conv", "block"]).filter("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
    given = whole.filter((F.col("place") <= longest) & (F.col("conv") % family == 0)).select(F.col("conv").alias("base"), "place", "turn_key", "n_bytes")
    taken = convs.join(given, "base").filter("place <= taken").withColumns({"block": F.lit(-1), "depth": F.col("place")})
    top = convs.select("conv", F.lit(-2).alias("block"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("n_bytes"), "n_turns")
    fields = top.columns
    return own.select(fields).union(taken.select(fields)).union(top)


def paths(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`rebuilt` with the digests of the prefix (p1, p2) and of the one before it (q1, q2; null at depth 0)."""
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(k), "depth", "turn_key")).cast("long"))
    rows = written(rows.drop("turn_key"), "rebuilt")
    offset = before(rows, [F.bit_xor("x1"), F.bit_xor("x2")], "x_before")
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    got = rows.withColumns({f"w{k}": F.bit_xor(f"x{k}").over(inside) for k in (1, 2)}).join(offset, ["conv", "block"])
    for k in (1, 2):
        got = got.withColumn(f"p{k}", F.col(f"w{k}").bitwiseXOR(F.coalesce(f"x_before{k - 1}", F.lit(0))))
        got = got.withColumn(f"q{k}", F.when(F.col("depth") > 0, F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}"))))
    return got.select("conv", "depth", *NODE, "q1", "q2", "n_bytes", "n_turns")


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` (kind, node) over the subtree of each node of a forest; ``parent`` is -1 at a top."""
    n = len(parent)
    out = np.zeros_like(weights)
    order = np.argsort(depth, kind="stable")
    levels = [x for x in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(x)]
    size = np.ones(n, np.int64)  # of the part of the component that hangs on a node
    for level in reversed(levels):
        held = level[parent[level] >= 0]
        np.add.at(size, parent[held], size[held])
    cut = parent < 0  # tops of components
    top, low = np.arange(n), np.full(n, -1)
    while levels:
        alive = np.concatenate(levels)
        for level in levels:
            top[level] = np.where(cut[level], level, top[parent[level]])
        heavy = np.zeros(n, bool)
        heavy[alive] = 2 * size[alive] > size[top[alive]]
        held = alive[heavy[alive] & ~cut[alive]]
        centroid = heavy.copy()
        centroid[parent[held]] = False  # a heavy child is nearer to the middle
        centres = np.flatnonzero(centroid)

        # total of what hangs on each centroid in its component
        low[alive] = -1
        low[centres] = np.arange(len(centres))
        for level in levels:
            inner = level[~cut[level] & ~centroid[level]]
            low[inner] = low[parent[inner]]
        below = alive[low[alive] >= 0]
        totals = np.zeros((len(weights), len(centres)), weights.dtype)
        for k in range(len(weights)):
            np.add.at(totals[k], low[below], weights[k, below])

        # along the path from the centroid to the top of its component
        out[:, centres] += totals
        at, which = centres, np.arange(len(centres))
        while len(at):
            up = ~cut[at]
            at, which = parent[at[up]], which[up]
            out[:, at] += totals[:, which]
            size[at] -= size[centres[which]]
        cut[alive[(parent[alive] >= 0) & centroid[parent[alive]]]] = True
        levels = [x for level in levels if len(x := level[~centroid[level]])]
    return out


def stretch_totals(rows: DataFrame) -> DataFrame:
    """(p1, p2, saved, leaves): sums over a node's subtree within its stretch of DEPTH turns, from rows (conv, depth, p1, p2, saved, leaves)."""

    def forest(stretch: np.ndarray, depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, saved: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
        # rows are in order of stretch and depth, so a row's parent is the row before it
        order = np.lexsort((p2, p1))
        new = np.append(True, (np.diff(p1[order]) != 0) | (np.diff(p2[order]) != 0))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        firsts = order[new]
        parent = np.where(np.append(True, np.diff(stretch) != 0), -1, np.append(-1, node[:-1]))
        weights = np.zeros((2, len(firsts)), np.int64)
        np.add.at(weights[0], node, saved)
        np.add.at(weights[1], node, leaves)
        sums = centroid_sums(parent[firsts], depth[firsts], weights)
        some = sums.any(axis=0)
        columns = [p1[firsts][some], p2[firsts][some], sums[0][some], sums[1][some]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*NODE, "saved", "leaves"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) >= FOREST:
                ends = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
                if len(ends):
                    done, held = [x[: ends[-1] + 1] for x in held], [x[ends[-1] + 1 :] for x in held]
                    yield from some_of(done)
        if held is not None and len(held[0]):
            yield from some_of(held)

    def some_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        conv, stretch = columns[:2]
        number = np.cumsum(np.append(True, (np.diff(conv) != 0) | (np.diff(stretch) != 0))) - 1
        # stretches with nothing to add, such as copies of earlier ones, are left out
        some = np.bincount(number, (columns[5] != 0) | (columns[6] != 0))[number] > 0
        if some.any():
            yield forest(number[some], *(x[some] for x in columns[2:]))

    dealt = rows.withColumn("stretch", F.floor(F.col("depth") / DEPTH).cast("long"))
    dealt = dealt.select("conv", "stretch", "depth", *NODE, "saved", "leaves", F.floor(F.col("conv") / NEIGHBOURS).alias("near"))
    dealt = dealt.repartition("near", "stretch").sortWithinPartitions("near", "stretch", "conv", "depth").drop("near")
    found = in_arrow(dealt, totals, "p1 long, p2 long, saved long, leaves long")
    return summed(found)


def summed(found: DataFrame) -> DataFrame:
    return found.groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def rollup(rows: DataFrame) -> DataFrame:
    """(p1, p2, saved, leaves): sums over each node's whole subtree; nodes where both are 0 may lack.

    ``rows`` are (conv, depth, p1, p2, q1, q2, owner, saved, leaves): every node on the path of every
    conversation, its figures in the row where ``owner`` holds and 0 in the others.
    """
    inside = written(stretch_totals(rows), "stretches")
    if (rows.agg(F.max("depth")).first()[0] or 0) < DEPTH:
        return inside
    # the nodes at the cuts, as a trie of their own
    cuts = rows.filter(F.col("depth") % DEPTH == 0).withColumn("depth", F.floor(F.col("depth") / DEPTH).cast("long")).drop("saved", "leaves")
    above = cuts.select("conv", (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    owned = cuts.filter("owner").join(inside, NODE, "left").select("conv", "depth", "saved", "leaves")
    upper = cuts.drop("q1", "q2").join(above, ["conv", "depth"], "left").join(owned, ["conv", "depth"], "left").na.fill(0, ["saved", "leaves"])
    wholes = written(rollup(written(upper.select(rows.columns), "cuts")), "cut-totals")
    # the whole subtree of a node at a cut hangs on the last node of the stretch before it
    hanging = cuts.filter("owner and depth > 0").join(wholes, NODE).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "saved", "leaves")
    added = rows.filter("owner").select("conv", "depth", *NODE).join(summed(hanging), NODE).select("conv", "depth", "saved", "leaves")
    again = rows.drop("saved", "leaves").join(added, ["conv", "depth"], "left").na.fill(0, ["saved", "leaves"])
    return written(summed(inside.union(stretch_totals(again))), "totals")


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of rows (p1, p2, conv): SHA-256 of the ids in ascending order, joined by commas.

    Ids become rows of many numbers first, so that the one task that a digest needs reads few rows and
    holds one at a time.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != node or len(ids) == NUMBERS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (a, b), []
                ids.append(conv)
            yield rows_of(out)
        if ids:
            yield rows_of([(*node, ids[0], ",".join(map(str, ids)))])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            yield digests_of(out)
        if node:
            yield digests_of([(*node, sha.hexdigest())])

    def digests_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True)], names=[*NODE, "ends_sha256"])

    sorted_ends = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    lists = in_arrow(sorted_ends, grouped, "p1 long, p2 long, first long, ids string")
    return in_arrow(lists.repartition(*NODE).sortWithinPartitions(*NODE, "first"), digested, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (:func:`rebuilt`) from (conv_id, turn, role, text).

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text) and
    ends_sha256 (of the ids of the conversations that end there).

    A null role or text counts as empty; rows without a conv_id take no part. Turns with a null
    number come first; turns of equal number come by a digest of role and text, so repeated rows are
    turns of their own. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    path = written(paths(rebuilt(turns_in_order(conversations), family, longest)), "paths")
    figures = [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "n_bytes", "q1", "q2")]]
    nodes = path.groupBy(*NODE).agg(*figures)
    kids = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, NODE, "left").na.fill(0, ["n_children"]), "nodes")

    figures = [F.lit(True).alias("owner"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")]
    own = nodes.select(F.col("conv_id").alias("conv"), "depth", *figures)
    rows = path.drop("n_bytes", "n_turns").join(own, ["conv", "depth"], "left").na.fill(0, ["saved", "leaves"]).na.fill(False, ["owner"])
    sums = rollup(written(rows, "owned"))
    ends = end_digests(path.filter("depth = n_turns").select(*NODE, "conv"))

    # at most 1,000 nodes have more than a thousandth of all nodes as children
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * 1000 > nodes.count()).alias("busy"))
    busy = F.broadcast(parents.filter("busy").drop("busy"))
    joined = nodes.join(sums, NODE, "left").join(ends, NODE, "left")
    some = joined.join(busy, ["q1", "q2"], "left")
    few = parents.filter("not busy").drop("busy").withColumnRenamed("parent_conv_id", "other")
    # children of busy nodes get a null key here: nothing to meet, and no hot key
    q = [F.when(F.col("parent_conv_id").isNull(), F.col(c)).alias(c) for c in ("q1", "q2")]
    named = some.select(*[c for c in some.columns if c not in ("q1", "q2")], *q)
    with_key, without = named.filter("q1 is not null"), named.filter("q1 is null").drop("q1", "q2").withColumn("other", F.lit(None).cast("long"))
    both = with_key.join(few, ["q1", "q2"], "left").drop("q1", "q2").unionByName(without)
    return both.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "other").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
