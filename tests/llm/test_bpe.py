"""Byte-level BPE against the tokenizer library, and the streaming decoder."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from flagstone.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces(ranks):
    return bpe.Pieces(bpe.Transducer(bpe.Vocabulary(ranks)))


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "aa", "th", "e", "é", "中文", "😀", " ", "the", "0", "!!", "--", "\n", "  ", "\t", "zz", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return [*texts, "", " ", "\n\n", "a" * 5000, "".join(rng.choice("abcdeth") for _ in range(20000))]


def test_pieces_equal_the_library(pieces, library):
    split = regex.compile(PATTERN).findall
    for text in odd_texts():
        assert pieces.encode([split(text)])[0].tolist() == library.encode_ordinary(text)


def test_one_by_one_equals_lock_step(pieces):
    short = [x.encode() for x in ("therehad", "ndthingly", "éêeauxtion", "zzzzzzzzzz", "aaaaaaa") if x.encode() not in pieces.transducer.vocabulary.ranks]
    many = pieces.transducer.run_many(short)
    assert [list(memoryview(x).cast("i")) for x in many] == [pieces.transducer.run(x) for x in short]


def test_a_full_store_of_states_starts_afresh(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    small = bpe.Pieces(bpe.Transducer(bpe.Vocabulary(ranks)))
    split = regex.compile(PATTERN).findall
    for text in odd_texts()[:60]:
        assert small.encode([split(text)])[0].tolist() == library.encode_ordinary(text)


def test_stream_cuts_inside_characters():
    text = "aé中😀z" * 3
    data = text.encode()
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        got = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(got) + stream.end() == text
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xf0\x9f") == "a" and stream.end() == "�"


def test_frame_with_nulls_ties_and_clashing_columns(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "y"), (2, "", "z"), (None, "Ünï 中", None), (1, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = bpe.digests(bpe.round_trip(docs, RANKS, PATTERN))
    got = sorted(map(tuple, both.collect()), key=str)
    want = []
    for ident, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((ident, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS).collect() == []
