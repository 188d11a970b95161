"""Line dedup against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest

from flagstone.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, keep_first):
    seen = defaultdict(set)
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for (i, lines), (_, t) in zip(texts, rows, strict=True):
        for p, line in enumerate(lines):
            seen[key(line)].add((i is not None, i or 0, t))
    often = {k for k, docs in seen.items() if k and len(docs) >= least}
    first = {}
    for i, lines in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, line in enumerate(lines):
            first.setdefault(key(line), (i, p))
    out = []
    for i, lines in texts:
        kept = [x for p, x in enumerate(lines) if key(x) not in often or (keep_first and first[key(x)] == (i, p))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(docs, **kw):
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **kw))
    return sorted(map(tuple, done.select("doc_id", "line_dedup.*").collect()), key=str)


def fixture():
    rng = random.Random(1)
    common = ["Hot line", " hot LINE\t", "Other", "É", "é", "x"]
    rows = [(i, "\n".join(rng.choice([*common, "", "  ", f"own {i}", f"own {i % 7}"]) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    return [*rows, (900, None), (901, ""), (902, "\n\n"), (None, "Hot line\nalone"), (903, "long " * 50000 + "\nhot line")]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_equals_plain_version(spark, keep_first, partitions):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, min_docs=10, keep_first=keep_first, partitions=partitions) == plain(rows, 10, keep_first)


def test_repeated_rows_tied_ids_and_clashing_columns(spark):
    rows = [(1, "a\nb", 5), (1, "a\nb", 5), (1, "a\nc", 6), (2, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int").withColumnsRenamed({"pos": "row"})
    # the repeated row is one document, the tied id is another: 'a' is in three
    assert got(docs, min_docs=3) == sorted([(1, 2, 1, "b"), (1, 2, 1, "b"), (1, 2, 1, "c"), (2, 1, 1, "")], key=str)
    assert got(docs, min_docs=4) == sorted([(1, 2, 0, "a\nb"), (1, 2, 0, "a\nb"), (1, 2, 0, "a\nc"), (2, 1, 0, "a")], key=str)
    assert got(docs.limit(0)) == []


@pytest.mark.parametrize("keep_first", [False, True])
def test_stream_in_any_cuts(keep_first):
    """The same rows in batches and partitions of any size give the same decisions."""
    rng = np.random.default_rng(3)
    keys = np.sort(rng.choice([1, 2, 3, 4, 5, 6], 300, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]))
    rows = np.unique(np.column_stack([keys, keys, rng.integers(0, 40, 300), np.zeros(300, int), rng.integers(0, 3, 300)]), axis=0)

    def decided(parts, size):
        out = []
        for part in parts:
            s = line_dedup.Stream(10, keep_first)
            for at in range(0, len(part), size):
                s.feed(part[at : at + size])
            s.close(True)
            out += s.taken().to_pylist()
        marks, edges = defaultdict(list), [x for x in out if x["kind"] == line_dedup.EDGE]
        for x in out:
            if x["kind"] == line_dedup.MARK:
                marks[x["h1"]].append((x["n_docs"], (x["doc"], x["pos"])))
        lost = {(x["h1"], x["doc"], x["pos"]) for x in out if x["kind"] == line_dedup.DROP}
        for x in edges:
            total, first = sum(n for n, _ in marks[x["h1"]]), min(f for _, f in marks[x["h1"]])
            if total >= 10 and not (keep_first and (x["doc"], x["pos"]) == first):
                lost.add((x["h1"], x["doc"], x["pos"]))
        return lost

    # partitions never cut a document's rows of one key
    cuts = [k for k in range(1, len(rows)) if (rows[k, :3] != rows[k - 1, :3]).any()]
    want = decided([rows], 10**6)
    for size in (1, 3, 50):
        for n in (1, 2, 7, 30):
            at = sorted(rng.choice(cuts, n, replace=False))
            assert decided(np.split(rows, at), size) == want


def test_clashing_names_stay(spark):
    names = ["__doc", "__row", "__map", "doc", "row", "keep_bitmap"]
    rows = [(i, f"own {i}\nshared", *names) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert done.columns == [*docs.columns, "line_dedup"]
    for r in done.collect():
        assert [r[n] for n in names] == names and r["line_dedup"]["kept_text"] == f"own {r['doc_id']}"
