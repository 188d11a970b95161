"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with the same key (for the query: the same text) are linked. Linked documents of one
group and shard are alike, so the state is one row per (group, shard) with a count, however large
a group is. Documents without a link have no say in it and fill what room is left.

The linked documents start where the order of their hashes puts them, in even shares, so nearly all
links are cut. In each round the members of a group ask for the shard that holds most of the group
and could take more of it. What is asked for is summed up for each two shards, 56 numbers for eight
shards, and granted as far as members change places, between two shards or around a circle of
them, or go where there is room; every other round, shards with room are asked first. Loads thus never pass the quotas, which differ by one at most, and
places are exchanged where the quotas are full. Rounds end when the cut has stopped falling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.llm.common import running_total, uniform, written

#: Rows of one key that one task numbers, on average.
BLOCK_ROWS = 100_000
#: Rounds without a smaller cut after which propagation ends; equal shards are weighed anew in each.
IDLE_ROUNDS = 3


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart, adding up to ``n``."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def loads(state: DataFrame, shards: int) -> list[int]:
    """Linked documents in each shard: one small row per shard comes to the driver."""
    got = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def cut_pairs(state: DataFrame) -> int:
    """Linked pairs in different shards."""
    sums = state.groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    cut = (F.col("n") * F.col("n") - F.col("sq")) / 2
    return int(sums.agg(F.sum(cut.cast("decimal(38,0)"))).first()[0] or 0)


def circle(asked: list[list[int]]) -> list[int] | None:
    """Shards a, b, ..., a each of which has members that ask for the next; the shortest there is."""
    best = None
    for start in range(len(asked)):
        paths, seen = [[start]], {start}
        while paths and (best is None or len(paths[0]) + 1 < len(best)):
            longer = []
            for path in paths:
                for to in (x for x, n in enumerate(asked[path[-1]]) if n > 0):
                    if to == start:
                        best = [*path, start] if best is None or len(path) + 1 < len(best) else best
                    elif to not in seen:
                        seen.add(to)
                        longer.append([*path, to])
            paths = longer
    return best


def granted_moves(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many members go from shard to shard: by circles, then to where there is room, which frees room in turn."""
    shards = len(room)
    left, room, out = [list(x) for x in asked], list(room), [[0] * shards for _ in room]

    def move(a: int, b: int, n: int) -> None:
        left[a][b] -= n
        out[a][b] += n

    while path := circle(left):
        steps = list(zip(path, path[1:], strict=False))
        n = min(left[a][b] for a, b in steps)
        for a, b in steps:
            move(a, b, n)
    # without circles, shards can be taken so that each comes after those its members ask for
    todo = set(range(shards))
    while todo:
        to = min(x for x in todo if not any(left[x][y] for y in todo))
        todo.remove(to)
        for a in sorted(todo, key=lambda x: -left[x][to]):
            n = min(left[a][to], room[to])
            move(a, to, n)
            room[to] -= n
            room[a] += n
    return out


def propagate(state: DataFrame, quota: list[int], room: list[int], blocks: int, turn: int) -> DataFrame | None:
    """One round: the state after the granted moves, None if there are none. ``turn`` decides between equal shards."""
    shards = len(quota)
    votes = state.filter(F.col("n") < by_shard(quota, F.col("shard")))  # a shard full of one group takes no more of it
    # every other round, shards with room go first, so that members don't wait for a shard that nobody leaves
    has_room = (by_shard(room, F.col("shard")) > 0) & F.lit(turn % 2 == 0)
    likes = F.struct(has_room.alias("open"), "n", F.xxhash64("g1", "g2", "shard", F.lit(turn)).alias("h"), F.col("shard").alias("to"))
    target = votes.groupBy("g1", "g2").agg(F.max(likes).alias("best"))
    asked = state.join(target.select("g1", "g2", F.col("best.to").alias("to"), F.col("best.n").alias("there")), ["g1", "g2"])
    # a move to a shard with as much of the group or more always lowers the cut
    asked = asked.filter("to <> shard and there >= n")
    # groups of which the shard has the larger part go first; ties by a hash
    first = F.greatest(F.lit(0), F.lit(40) - F.length(F.bin("there")))
    asked = written(asked.withColumn("turn", (first * F.lit(2**42) + uniform("g1", "g2", bits=42)).cast("long")), "asked")
    sums = [[0] * shards for _ in quota]
    for r in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # at most a row for each two shards
        sums[r["shard"]][r["to"]] = r["n"]
    moves = granted_moves(sums, room)
    if not any(map(any, moves)):
        return None
    limit = by_shard([n for line in moves for n in line], F.col("shard") * shards + F.col("to"))
    asked = running_total(asked, ["shard", "to"], ["turn", "g1", "g2"], F.col("n"), "before", blocks)
    granted = asked.withColumn("n", F.least(F.col("n"), limit - F.col("before"))).filter("n > 0")
    moved = granted.select("g1", "g2", F.explode(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))).alias("m"))
    after = state.select("g1", "g2", "shard", "n").union(moved.select("g1", "g2", "m.shard", "m.n"))
    return written(after.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "state")


def started(linked: DataFrame, total: int, shards: int, blocks: int) -> DataFrame:
    """The state of linked documents (turn, id, salt, g1, g2; ``total`` rows) in even shards by the order of their hashes."""
    placed = running_total(linked.withColumn("all", F.lit(0)), ["all"], ["turn", "id", "salt"], F.lit(1), "number", 8 * blocks)
    ends = [sum(quotas(total, shards)[: s + 1]) for s in range(shards)]
    shard = F.coalesce(*[F.when(F.col("number") < end, s) for s, end in enumerate(ends)]).cast("int")
    return placed.groupBy("g1", "g2", shard.alias("shard")).agg(F.count("*").alias("n"))


def settled(state: DataFrame, quota: list[int], blocks: int) -> tuple[DataFrame, list[int]]:
    """The state after the last round, and the pairs cut before and after each round."""
    shards, cuts, idle = len(quota), [cut_pairs(state)], 0
    while cuts[-1] and idle < IDLE_ROUNDS:
        room = [q - h for q, h in zip(quota, loads(state, shards), strict=True)]
        after = propagate(state, quota, room, blocks, len(cuts))
        state = state if after is None else after
        cuts.append(cuts[-1] if after is None else cut_pairs(state))
        idle = idle + 1 if cuts[-1] >= cuts[-2] else 0
    return state, cuts


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (id long, salt long, g1 long, g2 long and others) with ``shard`` int and ``slot`` long.

    (id, salt) orders the rows; rows alike in both are taken in any order, which changes nothing.
    Rows of a null group (g1) have no links.
    """
    rows = written(rows.withColumn("turn", uniform("id", "salt")), "rows")
    n = rows.count()
    quota = quotas(n, shards)
    blocks = 1 + n // BLOCK_ROWS
    sizes = rows.filter("g1 is not null").groupBy("g1", "g2").agg(F.count("*").alias("members")).filter("members > 1")
    linked = written(rows.join(sizes, ["g1", "g2"], "left_semi"), "linked")

    state, _ = settled(written(started(linked, linked.count(), shards, blocks), "state"), quota, blocks)
    held = loads(state, shards)

    # members of a group take its shards in turn: the first n of them the first shard, and so on
    ends = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spans = state.select("g1", "g2", "shard", "n", F.sum("n").over(ends).alias("end"))
    numbered = running_total(linked, ["g1", "g2"], ["turn", "id", "salt"], F.lit(1), "number", blocks)
    placed = numbered.join(spans, ["g1", "g2"]).filter("number < end and number >= end - n").select(*rows.columns, "shard")

    # the others fill the shards up
    alone = rows.join(sizes, ["g1", "g2"], "left_anti")
    room, at = [], 0
    for q, h in zip(quota, held, strict=True):
        room.append((at, at + q - h))
        at += q - h
    fill = running_total(alone.withColumn("all", F.lit(0)), ["all"], ["turn", "id", "salt"], F.lit(1), "number", 8 * blocks)
    shard = F.coalesce(*[F.when(F.col("number") < end, s) for s, (_, end) in enumerate(room)]).cast("int")
    filled = fill.select(*rows.columns, shard.alias("shard"))
    out = written(placed.unionByName(filled), "placed")
    return running_total(out, ["shard"], ["turn", "id", "salt"], F.lit(1), "slot", blocks).drop("turn")


def shard_documents(docs: DataFrame, shards: int = 8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ident, size, text_crc32 (long), law ('rows'), shard (int), slot (long), grown_shard (null).

    Rows with the same text are linked. Shards 0 to ``shards`` - 1 get row counts at most one
    apart; slots count from 0 in each, without a gap. Size is the UTF-8 bytes of the text plus 1.
    A null text has size 1, crc 0 and no links; empty texts are the same text. Repeated rows are
    linked rows like any other, null ids are placed too, an empty table gives no rows. Columns
    beside ident (an integer) and text are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(ident).cast("long").alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("salt"),
        F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text), F.lit(1))).alias("g1"),
        F.xxhash64(F.col(text), F.lit(2)).alias("g2"),
    )
    return assign(rows, shards).select(
        F.col("id").alias(ident), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
