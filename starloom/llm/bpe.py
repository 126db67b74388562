"""Byte-level BPE encoding and decoding in linear time.

A text is cut by the tokenizer's pattern; each piece is encoded on its own. The
bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary gives the longest token at every byte. Starting
from the longest match, the encoder goes left to right and falls back to
shorter tokens, or one token back, where two neighbours could not have come out
of the merges. A sequence of tokens is the result of the merges exactly if each
adjacent pair is; whether a pair is, is found by undoing merges of its two
sides, and remembered. A byte position that turned out a dead end is never
entered again, hence the linear time.

Null texts count as empty. Rows stay rows: repeated ids, null ids and extra
columns do no harm. There is no shuffle; the vocabulary (a fixed file) is read
by the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import text_column

#: Entries a worker remembers before it starts afresh; they bound memory, not results.
PIECES, PAIRS, LONG_PIECE = 400_000, 500_000, 64
UINT32 = "I"
#: Bytes of ids in one batch that leaves a task.
BATCH_BYTES = 8_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a rank file."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def last_merges(tokens: list[bytes]) -> np.ndarray:
    """For each token the two tokens that its last merge joins; a single byte has itself twice."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = np.empty((len(tokens), 2), dtype=np.int32)
    for number, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [rank.get(a + b, number) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best >= number:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[number] = rank[parts[0]], rank[parts[1]]
        else:
            out[number] = number
    return out


class Codec:
    """Encoder and decoder of one vocabulary; lives in a worker."""

    def __init__(self, tokens: list[bytes], merges: np.ndarray, pattern: str):
        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = merges[:, 0].tolist(), merges[:, 1].tolist()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), number)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        codec = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = array(UINT32, codec.encode_piece(piece.encode())).tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(self) >= PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def prefix_below(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            whole = self.tokens[token]
            ends = (self.rank.get(whole[:end], -1) for end in range(len(whole) - 1, 0, -1))
            found = self.shorter[token] = next((t for t in ends if t >= 0), -1)
        return found

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the bytes of both tokens ends in exactly these two."""
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(first, second)
        return known

    def _compatible(self, first: int, second: int) -> bool:
        # Undo the merges on both sides of the border, latest first. A merge
        # across the border that comes before the one just undone would have
        # been preferred. ``limit`` is the rank from which on it is too late.
        left, right, joined = self.left, self.right, self.joined
        limit = len(self.tokens)
        while True:
            across = joined.get((first, second))
            if across is not None and across < limit:
                return False
            if first > second:
                limit, inner = first, right[first]
                if inner != first:
                    first = inner
                    continue
                limit, inner = second + 1, left[second]
                if inner == second:
                    return True
                second = inner
            else:
                limit, inner = second + 1, left[second]
                if inner != second:
                    second = inner
                    continue
                limit, inner = first, right[first]
                if inner == first:
                    return True
                first = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        lengths, pairs = self.lengths, self.pairs
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends only grow, so the last one is the longest
        out: list[int] = []
        position, size = 0, len(piece)
        open_ends = bytearray(b"\x01") * (size + 1)
        token = longest[0]
        while position < size:
            end = position + lengths[token]
            if open_ends[end]:
                fits = not out or pairs.get(out[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            else:
                fits = False
            if fits:
                out.append(token)
                position = end
                if end < size:
                    token = longest[end]
                continue
            token = self.prefix_below(token)
            if token < 0:  # a dead end: one token back, and never here again
                open_ends[position] = 0
                token = out.pop()
                position -= lengths[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_PREPARED: dict[str, tuple[list[bytes], np.ndarray]] = {}
_CODECS: dict[str, Codec] = {}


def prepare(path: str) -> tuple[list[bytes], np.ndarray]:
    if path not in _PREPARED:
        tokens = read_ranks(path)
        _PREPARED[path] = tokens, last_merges(tokens)
    return _PREPARED[path]


def codec_of(name: str, tokens: list[bytes], merges: np.ndarray, pattern: str) -> Codec:
    if name not in _CODECS:
        _CODECS[name] = Codec(tokens, merges, pattern)
    return _CODECS[name]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WITH_IDS = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    tokens, merges = prepare(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, merges))
    name = hashlib.sha256(pattern.encode() + b"".join(tokens)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(name, *shared.value, pattern)

        def flush() -> pa.RecordBatch:
            columns = [
                pa.array([r[0] for r in rows], type=pa.int64()),
                pa.array([len(r[1]) // 4 for r in rows], type=pa.int64()),
            ]
            names = ["doc_id", "n_tokens"]
            if keep_ids:
                ends = np.cumsum([0, *[len(r[1]) // 4 for r in rows]], dtype=np.int32)
                values = np.frombuffer(b"".join(r[1] for r in rows), dtype="<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                names.append("ids")
            columns.append(pa.array([r[2] for r in rows], type=pa.string()))
            columns.append(pa.array([r[3] for r in rows], type=pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=[*names, "ids_sha256", "decoded_sha256"])

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = codec.encode(text.as_py())
                decoded = codec.decode(ids)
                digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
                rows.append((doc_id, ids, *digests))
                held += len(ids)
                if held > BATCH_BYTES:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return slim.mapInArrow(run, WITH_IDS if keep_ids else DIGESTS)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Text bytes of rows with ``ids``; null ids count as none."""
    tokens, _ = prepare(path)
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            texts = [b"".join([parts[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id long, decoded binary"
    )
