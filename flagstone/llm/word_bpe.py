"""Word-end BPE of a tokenizer file by tree concatenation.

A text is split into pieces, and each piece is encoded by itself. A short piece is merged as a whole.
A long one is cut into halves down to leaves; the leaves are encoded independently, and two
neighbouring results are put together by encoding anew a window around their join, which grows until
its first and last token are the ones that stood there. Why this is exact: merges are used in the
order of their rank and every part of a merge is made by an earlier one (checked when a file is
read), so a row of tokens is the encoding of its text if each two neighbours are the encoding of
theirs. Left of the window's first token and right of its last one nothing changed, and inside the
window the encoding is right, so all neighbours are.

Pieces above :data:`SPREAD` characters are cut into rows of their own, encoded by many tasks and put
together by rounds of a tree in Spark.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flagstone.llm.bpe import TEXTS, schema_of
from flagstone.llm.common import in_arrow, ship

#: Symbols of a leaf. Pieces up to this length are merged as a whole.
LEAF = 64
#: Symbols up to which the next merge is found by looking at all pairs.
SCAN = 96
#: Tokens on each side of a join that the first window takes.
WINDOW = 4
#: A piece with more characters is spread over tasks, in rows of this length.
SPREAD = 65_536
#: Neighbouring rows that one round puts together. Three rounds take the longest string that Spark has.
FAN, ROUNDS = 32, 3
#: Pieces that a worker keeps before it starts afresh; this only saves time.
MAX_PIECES = 400_000
#: Above every rank.
NO_MERGE = 1 << 64
#: Largest tokenizer file that is sent to the executors.
MAX_FILE_BYTES = 64 * 1024 * 1024

# Fixed values of the file's steps: what this module implements.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "byte_level": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    "added_token": {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False},
}
#: Beyond these characters the Unicode tables of the libraries at hand differ; such texts are split by the tokenizers library.
BEYOND = regex.compile(r"[^\u0000-\u02FF]")


def byte_letters() -> list[str]:
    """The letter for each byte: itself where it can be printed, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Tokens as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBpe:
    """A tokenizer file: its special strings, its pieces and its merges."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, split = file["model"], file["pre_tokenizer"]
        special = [t for t in file["added_tokens"] if {k: t[k] for k in STEPS["added_token"]} == STEPS["added_token"]]
        if (
            file["normalizer"] != STEPS["normalizer"]
            or split["type"] != "Sequence"
            or [s["type"] for s in split["pretokenizers"]] != ["Split", "ByteLevel"]
            or split["pretokenizers"][1] != STEPS["byte_level"]
            or (split["pretokenizers"][0]["behavior"], split["pretokenizers"][0]["invert"]) != ("Removed", True)
            or {k: model.get(k) for k in STEPS["model"]} != STEPS["model"]
            or len(special) != len(file["added_tokens"])
            or file["decoder"] is not None
        ):
            raise ValueError("the tokenizer file has steps that are not implemented")
        self.library = Tokenizer.from_str(data.decode())
        self.find = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in special}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if special else lambda text: [text]

        ids, end = model["vocab"], STEPS["model"]["end_of_word_suffix"]
        self.token = {i: t for t, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.letter = byte_letters()
        self.inner = [ids[c] for c in self.letter]
        self.last = [ids[c + end] for c in self.letter]
        self.merges: dict[tuple[int, int], int] = {}  # pair to rank * 2**32 + the token that it makes
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair, made = (ids[a], ids[b]), ids[a + b]
            if made in self.parts or pair in self.merges or any(p not in self.parts and len(self.token[p].removesuffix(end)) > 1 for p in pair):
                raise ValueError(f"merge {rank} makes or uses a token out of order")
            self.merges[pair], self.parts[made] = rank << 32 | made, pair
        self.known: dict[str, bytes] = {}

    def symbols(self, piece: bytes, ends: bool = True) -> list[int]:
        """Tokens of the bytes; the last one marks the end of a word if ``ends``."""
        got = [self.inner[b] for b in piece]
        if ends and piece:
            got[-1] = self.last[piece[-1]]
        return got

    def spelled(self, tokens: list[int]) -> list[int]:
        """The symbols that tokens were merged from."""
        out, todo = [], tokens[::-1]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                todo += (b, a)
            else:
                out.append(t)
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """All merges in order of rank, ties from the left."""
        if len(ids) > SCAN:
            return self._merged_by_heap(ids)
        ids, get, none = list(ids), self.merges.get, NO_MERGE
        ranks = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merges.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            merge, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # merged otherwise by now
            ids[i], ids[j], after[i] = merge & 0xFFFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from the encodings of each."""
        size = WINDOW
        while left and right:
            a, b = left[-size:], right[:size]
            window = self.merged(self.spelled(a) + self.spelled(b))
            starts = size >= len(left) or window[0] == a[0]
            if starts and (size >= len(right) or window[-1] == b[-1]):
                return left[:-size] + window + right[size:]
            size *= 2
        return left + right

    def tree(self, rows: list[list[int]]) -> list[int]:
        """The encoding of neighbouring texts from the encodings of each, halves first."""
        while len(rows) > 1:
            rows = [self.joined(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return rows[0] if rows else []

    def halved(self, symbols: list[int]) -> list[int]:
        """Encodes halves, and their halves down to leaves, and joins them."""
        if len(symbols) <= LEAF:
            return self.merged(symbols)
        mid = len(symbols) // 2
        return self.joined(self.halved(symbols[:mid]), self.halved(symbols[mid:]))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if text.isascii() or not BEYOND.search(text):
            return self.find(text.lower())  # blanks are in no piece; nothing here composes
        # pre_tokenize_str gives letters for bytes; its spans give the pieces
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_piece(self, piece: str) -> bytes:
        """Tokens of a piece as 32-bit numbers."""
        return packed(self.halved(self.symbols(piece.encode())))

    def runs(self, text: str) -> Iterator[bytes | str]:
        """Tokens of neighbouring pieces together, and each piece of more than SPREAD characters as it is."""
        known, run = self.known, []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                run.append(packed([self.special[part]]))
                continue
            pieces = self.pieces(part)
            found = list(map(known.get, pieces))
            if None not in found:
                run += found
                continue
            for piece, got in zip(pieces, found, strict=True):
                if got is None and (got := known.get(piece)) is None:
                    if len(piece) > SPREAD:
                        yield b"".join(run)
                        yield piece
                        run = []
                        continue
                    got = self.encode_piece(piece)
                    if len(piece) <= LEAF:
                        if len(known) >= MAX_PIECES:
                            known.clear()
                        known[piece] = got
                run.append(got)
        yield b"".join(run)

    def encode(self, text: str) -> bytes:
        """Tokens of a text as 32-bit numbers."""
        return b"".join(self.encode_piece(x) if isinstance(x, str) else x for x in self.runs(text))


_LOADED: dict[str, WordBpe] = {}


def loaded(data: bytes) -> WordBpe:
    """What a worker has read from a tokenizer file; one file at a time."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


def sent(df: DataFrame, path: str):
    """The tokenizer file as a broadcast; its size is that of a vocabulary, and checked. Raises for files of another kind."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer file of {len(data)} bytes; at most {MAX_FILE_BYTES}")
    WordBpe(data)
    return df.sparkSession.sparkContext.broadcast(data)


def id_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def id_rows(lists: pa.ListArray) -> list[np.ndarray | None]:
    """The numbers of each row; None for a null row."""
    flat, ends, valid = lists.values.to_numpy(), lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist()
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)]


def encoder(file):
    """Batches (ident, text) to (ident, ids)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(file.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = id_lists([encode(x.as_py() or "") for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[part.schema.names[0], "ids"])

    return encoded


def decoder(file):
    """Batches (ident, ids) to (ident, ids, decoded)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = loaded(file.value).token.__getitem__
        for batch in batches:
            texts = [None if x is None else " ".join(map(token, x.tolist())) for x in id_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[batch.schema.names[0], "ids", "decoded"])

    return decoded


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (ident, ids, decoded) to (ident, n_tokens, ids_sha256, decoded_sha256)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        rows = id_rows(batch.column(1))
        counts = [len(x) for x in rows]
        ids = [sha(x.astype("<u4").tobytes()) for x in rows]
        texts = [sha(x.as_py().encode()) for x in batch.column(2)]
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


def spread_encoded(rows: DataFrame, file) -> DataFrame:
    """(ident, ids) of rows (ident, text) whose long pieces are encoded by many tasks.

    A text becomes rows (row, part, node): runs of shorter pieces, already encoded, and stretches of
    long ones. Each round joins ``FAN`` neighbouring nodes of a part. What a task holds is bounded by
    one text.
    """
    ident = rows.columns[0]
    fields = f"{schema_of(rows.select(ident))}, row long, part int, node int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        names = [ident, "row", "part", "node", "raw", "ends", "ids"]
        for batch in batches:
            for at in range(batch.num_rows):
                out = []
                for part, run in enumerate(bpe.runs(batch.column(1)[at].as_py())):
                    if isinstance(run, bytes):
                        out.append((part, 0, None, True, run))
                        continue
                    raw = run.encode()
                    starts = range(0, len(raw), SPREAD)
                    out += [(part, n, raw[s : s + SPREAD], s + SPREAD >= len(raw), None) for n, s in enumerate(starts)]
                again = lambda c: batch.column(c).take(pa.array([at] * len(out)))  # noqa: B023, E731
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays([again(0), again(2), *columns], names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            ids = []
            for raw, ends, done in zip(*batch.columns[4:], strict=True):
                made = done.as_py() if done.is_valid else packed(bpe.halved(bpe.symbols(raw.as_py(), ends.as_py())))
                ids.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=[*batch.schema.names[:4], "ids"])

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        if table.num_rows > 1:
            rows = [np.frombuffer(x, "<u4").tolist() for x in table.column("ids").to_pylist()]
            whole = packed(loaded(file.value).tree(rows))
            table = table.slice(0, 1).set_column(table.schema.get_field_index("ids"), "ids", pa.array([whole], pa.binary()))
        return table.set_column(table.schema.get_field_index("node"), "node", pa.array([table.column("node")[0].as_py() // FAN], pa.int32()))

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table([table.column(ident).slice(0, 1), id_lists([b"".join(table.column("ids").to_pylist())])], names=[ident, "ids"])

    ship(rows.sparkSession)
    parts = in_arrow(rows.withColumn("row", F.monotonically_increasing_id()), cut, f"{fields}, raw binary, ends boolean, ids binary")
    nodes = in_arrow(parts.repartition("row", "part", "node"), leaves, f"{fields}, ids binary")
    for _ in range(ROUNDS):
        nodes = nodes.groupBy("row", "part", F.floor(F.col("node") / FAN)).applyInArrow(put_together, f"{fields}, ids binary")
    return nodes.groupBy("row").applyInArrow(whole, f"{schema_of(rows.select(ident))}, ids array<int>")


def _rows(docs: DataFrame, text: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """(ident, text) of the texts without and with a stretch of more than SPREAD characters without a blank."""
    rows = docs.select(F.col(f"`{ident}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    unsplit = F.exists(F.split("__text", r"\s"), lambda x: F.length(x) > SPREAD)
    long = F.when(F.length("__text") > SPREAD, unsplit).otherwise(False)
    return rows.filter(~long), rows.filter(long)


def encode(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident and ``ids``: the tokens of each whole text, special strings in it included, none added.

    A null text is encoded like an empty one, to no tokens. Repeated rows and null or tied ids are
    kept as they are; other columns are not read, whatever their names. The tokenizer file's
    truncation and padding are not used. Rows go through without a shuffle, but for texts with more
    than SPREAD characters without a blank.
    """
    file = sent(docs, path)
    short, long = _rows(docs, text, ident)
    return in_arrow(short, encoder(file), f"{schema_of(short.select(ident))}, ids array<int>").union(spread_encoded(long, file))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(ident, ids) with ``decoded``: the tokens' strings with a blank between each two, as a file without a decoder has it.

    Null ids give null, no ids an empty text; an id outside the vocabulary is an error.
    """
    return in_arrow(encoded, decoder(sent(encoded, path)), f"{schema_of(encoded)}, decoded string")


def digests(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256.

    :func:`encode` and :func:`decode` in one pass; their docstrings hold for nulls and the like.
    """
    file = sent(docs, path)
    first, second = encoder(file), decoder(file)
    short, long = _rows(docs, text, ident)
    schema = f"{schema_of(short.select(ident))}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digested(second(first(batches)))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digested(second(batches))

    return in_arrow(short, whole, schema).union(in_arrow(spread_encoded(long, file), rest, schema))
