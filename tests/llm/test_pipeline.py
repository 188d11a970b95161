"""The pipeline stage by stage, on the smallest table with planted rows."""

import hashlib

import pytest
import tiktoken

import corpus_pipeline
from flagstone.llm import bpe, quality
from tests.conftest import SF001
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dup import plain as plain_near


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "word " * 300, "en", "s", 1), (9001, None, "en", "s", 0)], docs.schema)
    now, out = docs.union(odd), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF001)
        rows = after.collect()
        out.append((name, now, rows))
        now = spark.createDataFrame(rows, after.schema)
    return out


def test_names_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]
    for _, before, _ in stages[1:]:
        assert before.columns == stages[0][1].columns


def test_quality_stage(stages):
    _, before, rows = stages[0]
    want = {(r.doc_id, r.quality.clean_text) for r in quality.judge(before).collect() if r.quality.kept}
    assert {(r.doc_id, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and not {r.doc_id for r in rows} & {9001, 9002, 9003}


def test_line_stage(stages):
    _, before, rows = stages[1]
    want = {(i, t) for i, _, _, t in plain_lines([(r.doc_id, r.text) for r in before.collect()], 10, True) if t.split()}
    assert {(r.doc_id, r.text) for r in rows} == want


def test_near_copies_stage(stages):
    _, before, rows = stages[2]
    want = {i for i, _, _, kept in plain_near([(r.doc_id, r.text) for r in before.collect()], 80) if kept}
    assert {r.doc_id for r in rows} == want


def test_mixing_stage_keeps_about_its_share(stages):
    _, before, rows = stages[3]
    assert 0.6 * before.count() < len(rows) < before.count()
    assert set(rows) <= set(before.collect())


def test_token_stage_and_run(spark, stages):
    _, before, rows = stages[4]
    with open(corpus_pipeline.RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    want = set()
    for r in before.collect():
        ids = library.encode_ordinary(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert set(map(tuple, rows)) == want
    assert corpus_pipeline.run(spark, SF001).count() > 0
