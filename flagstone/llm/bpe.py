"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled into a trie of the tokens and a test that tells which two tokens may stand
side by side (no merge of the rank order crosses their border). A sequence is what the merges make
of its bytes exactly if all neighbours may stand side by side, and each prefix has one such
sequence. The transducer follows, byte by byte, every position from which a token can still grow,
each with the token that ends there; no such position is further back than the longest token. The
tokens to which all of them lead back are certain and are emitted. States are made when first
reached and kept.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import in_arrow

#: States and pieces that a worker keeps before it starts afresh; both only save time.
MAX_STATES = 120_000
MAX_PIECES = 75_000
#: Longer pieces go through the transducer one by one.
LONG_PIECE = 64
#: Texts that are split before their pieces are encoded.
TEXTS = 512
#: Largest rank file that is sent to the executors.
MAX_RANK_BYTES = 64 * 1024 * 1024


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """The tokens, how each is merged together, and which may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.edges: tuple[dict, dict] = ({}, {})

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None if the merges of its bytes end elsewhere."""
        pieces, found = [token[i : i + 1] for i in range(len(token))], None
        while len(pieces) > 1:
            rank, at = min((self.ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)))
            if rank == math.inf:
                return None
            found = (pieces[at], pieces[at + 1])
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return found

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """What stands at one end of ``token`` while it is merged together, with the ranks that make and end it."""
        known = self.edges[side]
        if token not in known:
            out, end, part = [(token, self.ranks[token], math.inf)], self.ranks[token], token
            while len(part) > 1:
                part = self.halves(part)[side]
                out.append((part, self.ranks[part], end))
                end = self.ranks[part]
            known[token] = out
        return known[token]

    def neighbours(self, a: int, b: int) -> bool:
        """True if no merge crosses the border between ``a`` and ``b``."""
        ranks, left = self.ranks, self.edge(self.token[b], 0)
        for x, x_made, x_ends in self.edge(self.token[a], 1):
            for y, y_made, y_ends in left:
                m = ranks.get(x + y)
                # of two equal merges the left one goes first
                if m is not None and max(m, x_made, y_made) < x_ends and max(m, x_made, y_made) <= y_ends:
                    return False
        return True


class Steps(dict):
    """(state times 256 + byte): the step from there, made when first needed."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, key: int) -> tuple[int, int]:
        self[key] = got = self.transducer.step(key >> 8, key & 255)
        return got


class StepTable:
    """The same for many keys at once: a hash table in arrays, open addressing."""

    def __init__(self, transducer: Transducer, bits: int = 17):
        self.transducer, self.size = transducer, 0
        self.resize(bits)

    def resize(self, bits: int) -> None:
        self.bits, self.mask = bits, np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.states, self.tokens = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the empty slot where it would be."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        astray = np.flatnonzero((held != keys) & (held != -1))
        while len(astray):
            slot[astray] = (slot[astray] + 1) & self.mask
            held = self.keys[slot[astray]]
            astray = astray[(held != keys[astray]) & (held != -1)]
        return slot

    def add(self, keys: np.ndarray, states: np.ndarray, tokens: np.ndarray) -> None:
        """Adds distinct keys that aren't held."""
        if 2 * (self.size + len(keys)) > self.mask:
            full = self.keys >= 0
            old = self.keys[full], self.states[full], self.tokens[full]
            self.size = 0
            self.resize(self.bits + 1)
            self.add(*old)
            self.add(keys, states, tokens)
            return
        self.size += len(keys)
        while len(keys):  # of keys that want the same slot one gets it, the others look again
            slot = self.slots(keys)
            self.keys[slot] = keys
            won = self.keys[slot] == keys
            self.states[slot[won]], self.tokens[slot[won]] = states[won], tokens[won]
            keys, states, tokens = keys[~won], states[~won], tokens[~won]

    def go(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the tokens that end there; unknown steps are made first."""
        slot = self.slots(keys)
        new = np.unique(keys[self.keys[slot] != keys])
        if len(new):
            made = [self.transducer.step(k >> 8, k & 255) for k in new.tolist()]
            self.add(new, np.array([x[0] for x in made], np.int64), np.array([x[1] for x in made], np.int32))
            slot = self.slots(keys)
        return self.states[slot], self.tokens[slot]


class Transducer:
    """Bytes of one piece in, tokens out.

    A state holds the live positions: for each the trie node that its bytes have reached and the
    token that ends there. A step tells the next state and the one token that ends at the byte.
    """

    BITS = 21  # of a token + 1, in the ints that stand for live positions

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for token, rank in vocabulary.ranks.items():
            node = 0
            for byte in token:
                if node << 8 | byte not in self.child:
                    self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = self.child[node << 8 | byte]
            if len(token) == 1 or vocabulary.halves(token):
                self.ends[node] = rank
        self.grows = {key >> 8 for key in self.child}
        self.longest = max(map(len, vocabulary.ranks))
        self.lengths = np.zeros(max(vocabulary.token) + 1, np.int64)
        for token, rank in vocabulary.ranks.items():
            self.lengths[rank] = len(token)
        self.fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.table = Steps(self), StepTable(self)
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {(0,): 0}

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, times 256, and the token that ends at ``byte``."""
        bits, low, ends, grown, border = self.BITS, (1 << self.BITS) - 1, self.ends, [], -1
        for live in self.states[state]:
            node = self.child.get(live >> bits << 8 | byte)
            if node is None:
                continue
            token, before = ends[node], (live & low) - 1
            if token >= 0 and border < 0:
                fit = before < 0 or self.fits.get(before << bits | token)
                if fit is None:
                    fit = self.fits[before << bits | token] = self.vocabulary.neighbours(before, token)
                if fit:
                    border = token
            if node in self.grows:
                grown.append(node << bits | live & low)
        if border < 0:
            raise ValueError("the ranks lack a single byte")
        grown.append(border + 1)
        live = tuple(grown)
        number = self.numbers.get(live)
        if number is None:
            number = self.numbers[live] = len(self.states)
            self.states.append(live)
        return number << 8, border

    def run(self, piece: bytes) -> list[int]:
        """The tokens of one piece. Each is certain once all live positions lead back to it."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) >= MAX_STATES:
            self.forget()
        state, known, out, longest = 0, self.known, [], 64 * self.longest
        marks: list[int] = []  # the token that ends at each byte since the last one emitted
        for start in range(0, len(piece), longest):
            for byte in piece[start : start + longest]:
                state, token = known[state | byte]
                marks.append(token)
            if start + longest < len(piece):
                out += self.certain(marks)
        return out + self.back(marks, len(marks))

    def run_many(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of short pieces that aren't tokens themselves, as bytes of 32-bit numbers: all go in lock step."""
        if len(self.states) >= MAX_STATES:
            self.forget()
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")  # those with bytes left are then always the first
        size, flat = size[order], np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begin = (np.cumsum([0, *map(len, pieces)])[:-1])[order]
        marks, state = np.zeros((len(pieces), size[0]), np.int32), np.zeros(len(pieces), np.int64)
        for j in range(size[0]):
            n = int(np.searchsorted(-size, -j))
            state[:n], marks[:n, j] = self.table.go(state[:n] | flat[begin[:n] + j])
        end, back, live = size.copy(), [], np.arange(len(pieces))
        while len(live):
            token = marks[live, end[live] - 1]
            back.append((live, token))
            end[live] -= self.lengths[token]
            live = live[end[live] > 0]
        count = np.zeros(len(pieces), np.int64)
        for row, _ in back:
            count[row] += 1
        ends = np.cumsum(count)
        out = np.zeros(ends[-1], np.int32)
        for k, (row, token) in enumerate(back):
            out[ends[row] - 1 - k] = token
        data, ends = out.tobytes(), (4 * ends).tolist()
        got = [b""] * len(pieces)
        for at, start, stop in zip(order.tolist(), [0, *ends[:-1]], ends, strict=True):
            got[at] = data[start:stop]
        return got

    def back(self, marks: list[int], end: int) -> list[int]:
        """The tokens that lead to ``end``."""
        token, out = self.vocabulary.token, []
        while end > 0:
            out.append(marks[end - 1])
            end -= len(token[marks[end - 1]])
        return out[::-1]

    def certain(self, marks: list[int]) -> list[int]:
        """Emits the tokens that every position still live leads back to, and drops their marks."""
        token, end = self.vocabulary.token, len(marks)
        borders = set(range(end - self.longest, end + 1))  # all live positions are among them
        while len(borders) > 1:
            last = max(borders)
            borders.remove(last)
            borders.add(last - len(token[marks[last - 1]]))
        cut = borders.pop()
        out = self.back(marks, cut)
        del marks[:cut]
        return out


class Pieces:
    """Tokens of the pieces met lately, as bytes of 32-bit numbers, in two generations: pieces that come back stay."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The tokens of each text, given as its pieces."""
        if len(self.now) >= MAX_PIECES:
            self.older, self.now = self.now, {}
        now, older, ranks, new = self.now, self.older, self.transducer.vocabulary.ranks, []
        for piece in set(chain.from_iterable(texts)).difference(now):
            ids = older.get(piece)
            if ids is None:
                data = piece.encode()
                if data in ranks:
                    ids = ranks[data].to_bytes(4, "little")
                elif len(data) > LONG_PIECE:
                    ids = np.array(self.transducer.run(data), np.int32).tobytes()
                else:
                    new.append(piece)
                    continue
            now[piece] = ids
        if new:
            now.update(zip(new, self.transducer.run_many([p.encode() for p in new]), strict=True))
        return [np.frombuffer(b"".join(map(now.__getitem__, pieces)), "<i4") for pieces in texts]


class Utf8Stream:
    """Text of bytes that come in chunks; a character cut by a chunk's end waits for its other bytes."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, chunk: bytes) -> str:
        """Text of all characters complete by now; bytes that no character can have become U+FFFD."""
        data = self.waiting + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: 2 to 4 bytes long
                if back < 2 + (byte >= 0xE0) + (byte >= 0xF0):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


_LOADED: dict[str, tuple[Vocabulary, Pieces]] = {}


def loaded(data: bytes) -> tuple[Vocabulary, Pieces]:
    """What a worker has compiled from a rank file; one file at a time."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        vocabulary = Vocabulary(parse_ranks(data))
        _LOADED[key] = (vocabulary, Pieces(Transducer(vocabulary)))
    return _LOADED[key]


def sent(df: DataFrame, rank_file: str):
    """The rank file as a broadcast; its size is that of a vocabulary, and checked."""
    with open(rank_file, "rb") as f:
        data = f.read()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file of {len(data)} bytes; at most {MAX_RANK_BYTES}")
    return df.sparkSession.sparkContext.broadcast(data)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encoder(ranks, pattern: str):
    """Batches (ident ..., text) to (ident ..., ids)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = loaded(ranks.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = pieces.encode([split(x.as_py() or "") for x in part.column(part.num_columns - 1)])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "ids"])

    return encoded


def decoder(ranks, out: str, keep_ids: bool, chunk: int = 4096):
    """Batches (..., ids) to (..., out), or (..., ids, out)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = loaded(ranks.value)[0].token.__getitem__
        for batch in batches:
            texts = []
            for value in batch.column(batch.num_columns - 1):
                if not value.is_valid:
                    texts.append(None)
                    continue
                stream, got = Utf8Stream(), value.values.to_numpy(zero_copy_only=False)
                parts = [stream.feed(b"".join(map(token, got[i : i + chunk].tolist()))) for i in range(0, len(got), chunk)]
                texts.append("".join([*parts, stream.end()]))
            kept = batch.num_columns - (not keep_ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(texts, pa.string())], names=[*batch.schema.names[:kept], out])

    return decoded


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident and ``ids``, the tokens of each whole text, row by row without a shuffle.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A null text is
    encoded like an empty one, to no tokens. Repeated rows and null or tied ids are kept as they
    are; other columns are not read.
    """
    rows = docs.select(F.col(ident), F.col(text).alias("__text"))
    return in_arrow(rows, encoder(sent(docs, rank_file), pattern), f"{schema_of(rows.select(ident))}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out``, the text of the tokens in ``ids``, in place of ``ids``.

    The bytes go through :class:`Utf8Stream`. Null ids give a null text, no ids an empty one; an id
    outside the vocabulary is an error.
    """
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != ids], F.col(ids))
    schema = ", ".join(x for x in (schema_of(rows.drop(ids)), f"`{out}` string") if x)
    return in_arrow(rows, decoder(sent(encoded, rank_file), out, False), schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, ``ids`` and ``decoded``: the tokens of each whole text and the text decoded from them.

    :func:`encode` and :func:`decode` in one pass; their docstrings hold for nulls and the like.
    """
    ranks = sent(docs, rank_file)
    first, second = encoder(ranks, pattern), decoder(ranks, "decoded", True)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return second(first(batches))

    rows = docs.select(F.col(ident), F.col(text).alias("__text"))
    return in_arrow(rows, both, f"{schema_of(rows.select(ident))}, ids array<int>, decoded string")


def digests(encoded: DataFrame, ident: str = "doc_id") -> DataFrame:
    """ident, n_tokens long, ids_sha256 and decoded_sha256 of the rows of :func:`round_trip`."""
    return encoded.select(
        ident,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
