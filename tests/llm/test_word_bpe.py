"""Word-end BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flagstone.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return word_bpe.WordBpe(f.read())


def expected(library, text):
    return library.encode(text, add_special_tokens=False).ids


def texts(seed=3):
    rng = random.Random(seed)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ABCéèüÖßİıǅ", "0123456789²½", "  \t\n\r\x0b\x0c\x85\xa0\x1c\x1f", "'s't're've'm'll'd''", "!?.,;:#*()[]", "日本語ひらがな漢字", "Σςσ́̈ẹ", "😀🎉‍", "\x00\x07 　 ՘֋"]
    out = ["", " ", "Hello, World's it'll I'VE", "<|endoftext|>a<|startoftext|><|endoftext|> b<|endoftext", "a" * 5000, "ab" * 700 + "!" * 900, "é" * 300, "x<|endoftext|>" * 40]
    for _ in range(400):
        kinds = rng.choices(letters, k=3)
        out.append("".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 200))))
    return out


def test_every_single_character_below_the_bound(library, own):
    for code in range(0x300):
        text = f"a{chr(code)}b {chr(code)}{chr(code)}'s"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected(library, text), hex(code)


def test_equals_the_library(library, own):
    for text in texts():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected(library, text), text


def test_joins_and_heap_equal_the_plain_merges(own):
    rng = random.Random(5)
    words = ["the", "tion", "ing", "aaaa", "ab", "inter", "national", "zq", "eee", "anan"]
    for size in (1, 2, 63, 64, 65, 66, 130, 1000):
        symbols = own.symbols("".join(rng.choices(words, k=size)).encode())
        plain = own._merged_by_heap(symbols)
        assert own.halved(symbols) == plain
        assert own.spelled(plain) == symbols
        at = rng.randrange(len(symbols) + 1)
        assert own.joined(own._merged_by_heap(symbols[:at]), own._merged_by_heap(symbols[at:])) == plain
        if size < 40:
            assert own.merged(symbols) == plain


def test_windows_grow_until_both_sides_agree(own, monkeypatch):
    """With the smallest first window and the smallest leaves nearly every join has to grow."""
    monkeypatch.setattr(word_bpe, "WINDOW", 1)
    monkeypatch.setattr(word_bpe, "LEAF", 1)
    rng = random.Random(9)
    for _ in range(300):
        symbols = own.symbols("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 120))).encode())
        assert own.halved(symbols) == own._merged_by_heap(symbols)


def test_whole_rows_nulls_repeats_and_extra_columns(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(4)[:60])] + [(7, None, "y"), (None, "no id", "z"), (1, "twice", "a"), (1, "twice", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, word_bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = expected(library, t or "")
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = word_bpe.decode(word_bpe.encode(docs, PATH), PATH).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in back) == sorted(str((i, library.decode(expected(library, t or ""), skip_special_tokens=False))) for i, t, _ in rows)


def test_unsplit_texts_over_many_tasks(spark, library):
    """Pieces of more than one row of the tree, two rounds deep, at the module's own bounds."""
    rng = random.Random(8)
    long = "".join(rng.choice(["the", "tion", "ing", "aaa", "zq", "é"]) for _ in range(30_000))
    very = "".join(rng.choice("aeinrst") for _ in range(word_bpe.SPREAD * 34 + 5))
    rows = [(1, long), (2, f"before {long}! after <|endoftext|>{long[:-3]} 's"), (3, very), (4, "short"), (1, long), (5, "q" * (word_bpe.SPREAD + 1))]
    got = word_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = [(i, expected(library, t)) for i, t in rows]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)


def test_empty_table_and_foreign_files(spark, tmp_path):
    assert word_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError, match="not implemented"):
        word_bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
