"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Texts with the same set of shingles are one class from the start, so a group of copies is one row
in all that follows. In each bucket of a band the members are first compared with the smallest one
alone; the links found join most of a bucket to one component. Only members that are still in
different components are compared further: by a join where such pairs are few, else by blocks of
members in one task each, which gives out the links that join components and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import WORD, in_arrow, ship, written
from flagstone.llm.components import components
from flagstone.llm.shingles import GOLDEN, mix, shingles, word_hashes

#: Positions of a signature: a prime, so that (start + rank * stride) runs through all of them, and
#: ranks at two positions are distributed as in a random permutation.
POSITIONS = 257
#: Bands of ROWS positions each. At similarity 0.85 a pair misses all bands once in 4e8 times.
BANDS, ROWS = 42, 6
#: A pair isn't compared in full if the share of equal positions lies this far below the least
#: similarity: over five standard deviations.
MARGIN = 0.12
#: A bucket whose open pairs are no more than this many times its members is joined with itself.
OPEN_PER_MEMBER = 2
#: Members and shingles of a block; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000

_INVERSE = np.array([0, *(pow(a, -1, POSITIONS) for a in range(1, POSITIONS))], np.int64)


def super_min_hash(elements: np.ndarray) -> np.ndarray:
    """Signature of distinct 64-bit hashes: at each position the smallest rank and value of an element.

    Each element visits all positions in an order of its own, the j-th with a value in [j, j+1). A
    position that holds a value of an earlier rank can't change any more, so ranks are gone through
    only until no position is empty: two or three for long texts.
    """
    start = (mix(elements ^ GOLDEN) % np.uint64(POSITIONS)).astype(np.int64)
    stride = 1 + (mix(elements + GOLDEN) % np.uint64(POSITIONS - 1)).astype(np.int64)
    if len(elements) <= 24:  # few elements go through nearly all ranks: take the rank of each position at once
        rank = (np.arange(POSITIONS) - start[:, None]) * _INVERSE[stride][:, None] % POSITIONS
        value = mix(elements[:, None] + (rank.astype(np.uint64) + np.uint64(1)) * GOLDEN) >> np.uint64(16)
        return (rank.astype(np.uint64) << np.uint64(48) | value).min(0)
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for j in range(POSITIONS):
        value = mix(elements + np.uint64((j + 1) * int(GOLDEN) & (2**64 - 1))) >> np.uint64(16)
        np.minimum.at(out, (start + j * stride) % POSITIONS, np.uint64(j << 48) | value)
        if out.max() < np.uint64((j + 1) << 48):
            break
    return out


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text1, text2, text) to doc, text1, text2, n_shingles, 128 bits of the set's hash and one byte per position of the signature."""
    for batch in batches:
        sizes, keys, marks = [], [], []
        for text in batch.column(3):
            found = np.unique(shingles(word_hashes(text.as_py())))
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            marks.append((mix(super_min_hash(found)) >> np.uint64(56)).astype(np.uint8).tobytes() if len(found) else None)
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(marks, pa.binary())],
            names=["doc", "text1", "text2", "n_shingles", "set1", "set2", "sig"],
        )


def likely(percent: int):
    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, sig_a, sig_b) to the pairs (a, b) whose signatures agree often enough."""
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
                good = pa.array((left == right).sum(1) >= (percent / 100 - MARGIN) * POSITIONS)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["a", "b"])

    return agreeing


def linked(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, text_a, text_b), sorted by a, to the pairs whose full sets of shingles are similar enough."""
        held, held_set = None, None
        for batch in batches:
            good = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                left, right = left.as_py(), right.as_py()
                if (a, left) != held:
                    held, held_set = (a, left), np.unique(shingles(word_hashes(left)))
                good.append(similar(held_set, np.unique(shingles(word_hashes(right))), percent))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["u", "v"])

    return verify


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linked_in_blocks(percent: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """The links that join components between a block of open members of a bucket and a block of all its members.

        Pairs are taken by falling likeness of their signatures and compared in full only while
        their documents are still apart, so what comes out is a forest. A pair of two open members is
        compared where the smaller one is on the open side, and a pair that shares several bands in
        the first of them.
        """
        docs, names, band = pdf["doc"].to_numpy(), pdf["root"].to_numpy(), int(pdf["band"].iloc[0])
        marks = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, POSITIONS)
        ours, theirs = np.flatnonzero(pdf["ours"]), np.flatnonzero(~pdf["ours"].to_numpy())
        both_open = pdf["open"].to_numpy()[theirs]
        rows = [np.zeros((0, 3), np.int64)]
        for at in range(0, len(ours), 32):
            part = ours[at : at + 32]
            equal = (marks[part, None] == marks[None, theirs]).sum(2)
            good = (equal >= (percent / 100 - MARGIN) * POSITIONS) & (names[part, None] != names[None, theirs])
            good &= ~both_open[None] | (docs[part, None] < docs[None, theirs])
            x, y = np.nonzero(good)
            rows.append(np.column_stack([-equal[x, y], part[x], theirs[y]]))
        pairs = np.concatenate(rows)
        if len(pairs):
            bands = marks[:, : BANDS * ROWS].reshape(len(docs), BANDS, ROWS)
            pairs = np.concatenate([p[(bands[p[:, 1]] == bands[p[:, 2]]).all(2).argmax(1) == band] for p in np.array_split(pairs, 1 + len(pairs) // 20_000)])
        pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
        top: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        texts = pdf["text"].tolist()

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingles(word_hashes(texts[k])))
            return sets[k]

        out = []
        for x, y in pairs[:, 1:].tolist():
            a, b = find(int(names[x])), find(int(names[y]))
            if a != b and similar(full(x), full(y), percent):
                top[a] = b
                out.append((docs[x], docs[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return compare


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets that aren't empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, as written (u, v)."""
    side = lambda df, k, c: df.select(F.col("doc").alias(k), F.col(c).alias(f"{c}_{k}"))
    near = pairs.join(side(sigs, "b", "sig"), "b").join(side(sigs, "a", "sig"), "a").select("a", "b", "sig_a", "sig_b")
    near = written(in_arrow(near, likely(percent), "a long, b long"), "pairs")
    full = near.join(side(texts, "b", "text"), "b").join(side(texts, "a", "text"), "a").select("a", "b", "text_a", "text_b")
    return written(in_arrow(full.sortWithinPartitions("a"), linked(percent), "u long, v long"), "links")


def open_links(members: DataFrame, roots: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members that share a bucket but no component; ``members`` are (bucket, band, doc, n).

    Members outside a bucket's largest component are open. With few open pairs they are joined with
    the others. Else blocks of open members meet blocks of all members, a pair of blocks in each task;
    blocks are bounded by members and by shingles.
    """
    labelled = members.join(roots.select(F.col("node").alias("doc"), F.col("root")), "doc", "left")
    labelled = written(labelled.select("bucket", "band", "doc", "n", F.coalesce("root", "doc").alias("root")), "members")
    parts = labelled.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    main = F.max(F.struct("c", "root", "n"))
    stats = parts.groupBy("bucket").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("n").alias("n"), main.alias("main"), F.count("*").alias("parts"))
    few = F.col("k") * F.col("k") - F.col("sq") <= 2 * OPEN_PER_MEMBER * F.col("k")
    blocks = lambda k, n: 1 + F.greatest(F.floor(k / BLOCK), F.floor(n / BLOCK_SHINGLES)).cast("int")
    stats = stats.filter("parts > 1").select(
        "bucket", F.col("main.root").alias("main"), few.alias("few"), blocks(F.col("k"), F.col("n")).alias("all_blocks"), blocks(F.col("k") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("open_blocks")
    )
    stats = written(stats, "buckets")

    ready = labelled.join(stats.filter("few"), "bucket")
    other = ready.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "root")])
    pairs = ready.filter("root <> main").join(other, "bucket")
    pairs = pairs.filter("root <> root_b and (root_b = main or doc < doc_b)").filter(similar_size(F.col("n"), F.col("n_b"), percent))
    narrow = pairs.select(F.least("doc", "doc_b").alias("a"), F.greatest("doc", "doc_b").alias("b"))

    wide = labelled.join(stats.filter("not few"), "bucket").withColumn("open", F.col("root") != F.col("main"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    fields = ["bucket", "band", "doc", "root", "open", "ours", "i", "j"]
    ours = wide.filter("open").withColumns({"ours": F.lit(True), "i": block("open_blocks")}).withColumn("j", every("all_blocks"))
    theirs = wide.withColumns({"ours": F.lit(False), "j": block("all_blocks")}).withColumn("i", every("open_blocks"))
    dealt = ours.select(fields).union(theirs.select(fields))
    links = verified(narrow.distinct(), sigs, texts, percent)
    ship(members.sparkSession)
    full = dealt.join(sigs, "doc").join(texts, "doc")
    return links.union(written(full.groupBy("bucket", "i", "j").applyInPandas(linked_in_blocks(percent), "u long, v long"), "links"))


def near_duplicates(docs: DataFrame, percent: int = 85, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ident, n_shingles, component_id (the smallest id reachable), kept (it is the row's own).

    Words are those of the contract of :func:`word_hashes`; a document's set are its distinct
    shingles of five words, the whole sequence if it has fewer. Documents are linked when 100 *
    intersection >= ``percent`` * union, confirmed on the full sets. Null and empty texts have an
    empty set and are linked with nothing. Rows with a null id are linked with nothing; their
    component is null and they are kept. Repeated rows are each returned; rows that share an id are
    linked with what any of their texts is. Columns beside ident (an integer) and text are not read.
    """
    kept = F.col(ident) == F.col("component_id")
    return labelled_rows(docs, percent, ident, text).select(
        F.col("doc").alias(ident), "n_shingles", F.col("component").alias("component_id")
    ).withColumn("kept", F.coalesce(kept, F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 85, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row per group of linked texts, that of the smallest id; all their columns.

    Rows with a null id take part here: of equal or linked texts without an id one row stays, and
    none if one of the group has an id. Of equal rows one stays. Texts without words have no group:
    all of them stay.
    """
    keys = ["no_id", "id", "text1", "text2"]
    by_key = lambda doc: {"no_id": doc.isNull(), "id": F.coalesce(doc, F.lit(0))}
    marks = labelled_rows(docs, percent, ident, text, null_ids=True).filter("n_shingles > 0").withColumns(by_key(F.col("doc")))
    first = marks.groupBy("group").agg(F.min(F.struct(*keys)).alias("f")).select("f.*").distinct()
    times = marks.groupBy(*keys).agg(F.count("*").alias("times"))
    first = written(first.join(times, keys), "firsts")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{ident}`").cast("long").alias("doc"), *[c.alias(n) for c, n in zip(text_keys(F.col(f"`{text}`")), keys[2:], strict=True)])
    row = row.withColumns(by_key(F.col("doc"))).drop("doc")
    once = row.join(first.filter("times = 1"), keys, "left_semi").select("row.*")
    # equal rows meet in part before the shuffle
    more = row.join(first.filter("times > 1"), keys, "left_semi").dropDuplicates(keys).select("row.*")
    empty = docs.filter(~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD))
    return once.union(more).union(empty)


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text that are made from the text, not from each other; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def labelled_rows(docs: DataFrame, percent: int, ident: str, text: str, null_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc, text1, text2 (:func:`text_keys`), n_shingles, group (null without words), component (smallest id of the group).

    Nodes of the links are the different sets of shingles. Rows with a null id have no group unless ``null_ids``.
    """
    keys = [c.alias(n) for c, n in zip(text_keys(F.col(f"`{text}`")), ("text1", "text2"), strict=True)]
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("doc"), *keys, F.col(f"`{text}`").alias("text"))
    marks = written(in_arrow(rows, sketched, "doc long, text1 long, text2 long, n_shingles long, set1 long, set2 long, sig binary"), "sketches")
    full = marks.filter("n_shingles > 0" if null_ids else "doc is not null and n_shingles > 0")
    # the row whose text stands for a set: that of the smallest id
    least = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text1", "text2")).alias("rep")
    classes = written(full.groupBy("set1", "set2").agg(least).withColumn("node", F.monotonically_increasing_id()), "classes")
    chosen = classes.select("node", F.col("rep.doc").alias("d"), F.col("rep.text1").alias("text1"), F.col("rep.text2").alias("text2"), "set1", "set2")
    is_rep = F.col("doc").eqNullSafe(F.col("d"))
    reps = full.join(chosen, ["text1", "text2", "set1", "set2"]).filter(is_rep).dropDuplicates(["node"]).select(F.col("node").alias("doc"), F.col("n_shingles").alias("n"), "sig")

    band = lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))).alias("bucket"))
    spread = reps.select("doc", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("x")).select("doc", "n", "x.*")
    shared = spread.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("least"), F.max("doc").alias("most"))
    shared = shared.filter("least.doc <> most").select("bucket", "least")
    members = written(spread.join(shared, "bucket").select("bucket", "band", "doc", "n", F.col("least.doc").alias("a"), F.col("least.n").alias("n_a")), "members")

    wanted = members.select("doc").distinct()
    sigs = written(reps.join(wanted, "doc", "left_semi").select("doc", "sig"), "signatures")
    keyed = chosen.join(wanted.withColumnRenamed("doc", "node"), "node", "left_semi").select("node", "d", "text1", "text2")
    texts = rows.join(keyed, ["text1", "text2"]).filter(is_rep).dropDuplicates(["node"])
    texts = written(texts.select(F.col("node").alias("doc"), "text"), "texts")

    star = members.filter("a <> doc").filter(similar_size(F.col("n"), F.col("n_a"), percent)).select("a", F.col("doc").alias("b")).distinct()
    links = verified(star, sigs, texts, percent)
    # texts that share an id are linked by it
    nodes = full.filter("doc is not null").select("doc", "set1", "set2").distinct().join(classes.select("set1", "set2", "node"), ["set1", "set2"])
    ends = nodes.groupBy("doc").agg(F.min("node").alias("u"), F.max("node").alias("m")).filter("u <> m")
    links = links.union(written(nodes.join(ends, "doc").filter("node <> u").select("u", F.col("node").alias("v")), "same-ids"))
    more = open_links(members.select("bucket", "band", "doc", "n"), components(links), sigs, texts, percent)
    roots = components(links.union(more))

    named = classes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("set1", "set2", "rep", F.coalesce("root", "node").alias("group"))
    named = written(named, "groups")
    smallest = named.groupBy("group").agg(F.min("rep.doc").alias("component"))
    out = marks.drop("sig").join(named.join(smallest, "group").drop("rep"), ["set1", "set2"], "left").drop("set1", "set2")
    alone = F.col("n_shingles") == 0
    in_links = F.lit(True) if null_ids else F.col("doc").isNotNull()
    return out.withColumn("component", F.when(alone, F.col("doc")).otherwise(F.when(F.col("doc").isNotNull(), F.col("component")))).withColumn(
        "group", F.when(~alone & in_links, F.col("group"))
    )
