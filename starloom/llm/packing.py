"""Mixture-controlled packing by deficit round-robin over source queues.

Every source has a queue: its documents in the order of the stored table, one
token run after the other. A scheduler goes round the queues. In each round a
queue is credited its share of a window (``length`` tokens times its target
proportion), sends what its credit allows, and carries the rest, its deficit,
into the next round. A queue whose share is below ``least`` tokens a round waits
until its deficit has grown to ``least`` tokens, so that pieces do not become crumbs.
What is sent, round after round, is cut into sequences of ``length`` tokens, so
each sequence holds the target proportions up to the carried deficits; when
queues run dry the others go on in proportion to each other.

The credit is a fixed integer per round (in 1/65536 tokens), hence the tokens a
queue has sent by the end of round ``w`` are a closed formula of ``w``, and so is the
place of each token in the whole. Scheduling therefore needs no pass over the
rounds: the deficits carried from partition to partition are the prefix sums of
the tokens per (partition, queue), a table of a few numbers per task. After them
every document finds its pieces by itself, and no text and no token id is shuffled
(the ids are only joined with their partition's prefix sums, broadcast up to
``BROADCAST_ROWS`` of these).

Padding: what is left at the end, less than ``length`` tokens, goes into sequences
whose lengths are powers of two, which need none.

Up to ``OWN_QUEUES`` sources, those with most tokens, have a queue of their own; smaller
ones share ``REST_QUEUES`` queues by hash, one source after the other. A null source
counts as the empty name. Null texts are empty: they consist of the end token alone.
Repeated rows and ids are documents of their own; extra columns do no harm; an empty
table gives no pieces. A queue may hold up to 10^14 tokens.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, repeat_ranges, text_bytes

LENGTH = 2048
END_TOKEN = 1
LEAST = 64
OWN_QUEUES, REST_QUEUES = 1024, 64
#: Prefix sums that are sent to every task; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
ONE = 1 << 16  # a token of credit

#: Parts of texts longer than this (in bytes) are not remembered; of others up to twice so many.
PART_BYTES, PARTS_KEPT = 48, 300_000
#: Parts that are encoded as one text; bytes of texts that are split together (a longer text goes alone).
PARTS_AT_ONCE, BYTES_AT_ONCE = 500, 1 << 22

# Fixed values of the vocabulary's splitting, for UTF-8 bytes of ASCII and Latin-1 letters. The latter are the byte
# ``LEAD`` and a second one, but with 0x97 and 0xB7 (signs of multiplication and division).
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
LEAD = 0xC3


def byte_class(b: int) -> int:
    if b in b"\t\n\x0b\x0c\r ":
        return SPACE
    if b < 128:
        c = chr(b)
        return LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN if c.isprintable() else ODD
    return LETTER if b == LEAD or b < 0xC0 and b not in (0x97, 0xB7) else ODD


CLASSES = bytes(map(byte_class, range(256)))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))

TOKENS = "chunk int, doc_id long, source string, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"
_TOKENS = pa.schema(
    [("chunk", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
)
_PIECES = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in PIECES.split(", ")])


class Remembered:
    """What was found for a key; when full, it starts anew and keeps the one before to look up what comes again."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: list) -> list:
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        absent = [k for k in keys if k not in self.now]
        old = {k: self.before[k] for k in absent if k in self.before}
        self.now.update(old)
        return [k for k in absent if k not in old]

    def forget_long(self, keys: list) -> None:
        for key in keys:
            if len(key) > PART_BYTES:
                del self.now[key]


def odd_words(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places of all bytes of the words that are not plain: other letters or control characters, or "<|"."""
    lead, second = data == LEAD, (data & 0xC0) == 0x80
    alone = np.flatnonzero(lead[:-1] != second[1:])  # one byte of a letter without the other
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    odd = np.concatenate((np.flatnonzero(classes == ODD), np.where(lead[alone], alone, alone + 1), special))
    change = np.diff((classes != SPACE).view(np.int8))
    first, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    words = np.unique(np.searchsorted(first, odd, "right") - 1)
    return repeat_ranges(first[words], end[words] - first[words])


def split(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Parts of the texts, all found together: where each text's begin, their numbers, the distinct ones, which are odd.

    Parts of plain words are in lower case. Words that are not plain are odd parts, whole and as they stand.
    """
    joined = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(joined.translate(LOWER), dtype=np.uint8)
    classes = np.frombuffer(bytearray(joined.translate(CLASSES)), dtype=np.uint8)
    stand = np.frombuffer(joined, dtype=np.uint8)
    if not joined.isascii() or b"<|" in joined or (classes == ODD).any():
        odd = odd_words(stand, classes)
        classes[odd] = ODD
        data = data.copy()
        data[odd] = stand[odd]
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = ((classes[1:] != classes[:-1]) | (classes[1:] == DIGIT)) & (classes[1:] != SPACE)
    # 's 't 'm 'd 're 've 'll after anything but a sign are parts, whatever follows.
    quote = np.flatnonzero((data[:-1] == ord("'")) & (classes[:-1] == SIGN) & begins[:-1] & (classes[1:] == LETTER))
    one, two = data[quote + 1], data[quote + 2]
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    letters = np.where(np.isin(one, list(b"stmd")), 1, np.where(pair, 2, 0))
    quote, letters = quote[letters > 0], letters[letters > 0]
    begins[quote + 1] = False
    begins[quote + 1 + letters] |= classes[quote + 1 + letters] != SPACE
    start = np.flatnonzero(begins)
    end = np.flatnonzero((begins[1:] | (classes[1:] == SPACE)) & (classes[:-1] != SPACE)) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[classes != SPACE])]
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
    is_odd = np.zeros(len(parts.dictionary), dtype=bool)
    is_odd[parts.indices.to_numpy()[classes[start] == ODD]] = True
    first = np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    return first, parts.indices, parts.dictionary, is_odd


class WordIds:
    """Token ids of texts, as bytes of unsigned 32-bit numbers, through the library.

    The vocabulary first splits a text into parts and encodes each by itself, so a part that was seen
    is not encoded again, and a part that comes often is looked up once per call. In plain words, of ASCII
    and Latin-1 letters, the parts are found here; words (never joined across ASCII white space) that are not
    plain go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_parts = Tokenizer.from_file(path)  # for parts, which are normalised and split already
        self.of_parts.normalizer = normalizers.Sequence([])
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Remembered(PARTS_KEPT)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        found = self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False) if texts else ()
        return [np.array(f.ids, dtype="<u4").tobytes() for f in found]

    def encode_parts(self, parts: list[bytes]) -> Iterator[bytes]:
        """A part's last token, and no other, is one that ends a word: so parts can be encoded together."""
        for low in range(0, len(parts), PARTS_AT_ONCE):
            some = parts[low : low + PARTS_AT_ONCE]
            found = self.of_parts.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some):
                yield from self.encode(some)
                continue
            data = ids.tobytes()
            yield from (data[a:b] for a, b in zip([0, *cuts], cuts))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        first, numbers, distinct, is_odd = split(texts)
        if not len(numbers):
            return [b""] * len(texts)
        keys = distinct.to_numpy(zero_copy_only=False).tolist()
        odd = {keys[k] for k in np.flatnonzero(is_odd).tolist()}
        new = self.known.missing(keys)
        parts, words = [k for k in new if k not in odd], [k for k in new if k in odd]
        self.known.now.update(zip(parts, self.encode_parts(parts)))
        self.known.now.update(zip(words, self.encode(words)))
        found = pa.array(list(map(self.known.now.__getitem__, keys)), pa.large_binary()).take(numbers)
        self.known.forget_long(new)
        _, offsets, data = found.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int64)[first].tolist()
        ids = memoryview(data) if data else b""
        return [bytes(ids[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process: later tasks find the words that earlier ones have seen."""
    return WordIds(path)


def tokenise(docs: DataFrame, path: str, end_token: int, source: str) -> DataFrame:
    """The documents' ids with each one's place among its source's tokens of the same task (``chunk``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, chunk = word_ids(path), TaskContext.get().partitionId()
        end = np.array([end_token], dtype="<u4").tobytes()
        sent: dict[str, int] = {}
        for batch in batches:
            upto, low = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(), dtype=np.int64), 0
            while low < batch.num_rows:
                most = BYTES_AT_ONCE + (upto[low - 1] if low else 0)
                high = max(low + 1, int(np.searchsorted(upto, most, "right")))
                part, low = batch.slice(low, high - low), high
                sources = part.column(1).to_pylist()
                ids = [i + end for i in ids_of(part.column(2).to_pylist())]
                counts = [len(i) // 4 for i in ids]
                before = []
                for name, count in zip(sources, counts):
                    before.append(sent.get(name, 0))
                    sent[name] = before[-1] + count
                values = [chunk] * len(ids), part.column(0), sources, before, counts, ids
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, _TOKENS)], schema=_TOKENS)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text_bytes())
    return slim.mapInArrow(run, TOKENS)


class Schedule:
    """The round-robin as formulas: who has sent how much after which round, and where it stands."""

    def __init__(self, totals: list[int], weights: list[float], length: int = LENGTH, least: int = LEAST):
        share = np.array(weights, dtype=float) / max(sum(weights), 1e-300)
        self.length = length
        self.totals = np.array(totals, dtype=np.int64)
        self.credit = np.maximum(1, np.rint(share * length * ONE)).astype(np.int64)
        self.quantum = np.where(self.credit < least * ONE, least, 1).astype(np.int64)
        self.tokens = int(self.totals.sum())
        self.full = self.tokens // length  # sequences of the whole length
        left = self.tokens % length
        self.rest = np.cumsum([0] + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1])

    def sent(self, queue, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue (a number, or one per round) has sent by the end of these rounds."""
        quantum = self.quantum[queue]
        return np.minimum(self.totals[queue], rounds * self.credit[queue] // (ONE * quantum) * quantum)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round, from 1, that sends this token of the queue."""
        quantum = self.quantum[queue]
        return -(-(token // quantum + 1) * ONE * quantum // self.credit[queue])

    def edge(self, sequence: np.ndarray) -> np.ndarray:
        """The first token of a sequence in the whole."""
        after = np.clip(sequence - self.full, 0, len(self.rest) - 1)
        return np.minimum(sequence, self.full) * self.length + self.rest[after]

    def sequence_of(self, place: np.ndarray) -> np.ndarray:
        after = np.searchsorted(self.rest, place - self.full * self.length, "right") - 1
        return np.where(place < self.full * self.length, place // self.length, self.full + after)

    def pieces(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, start in the document, length, sequence and offset of all pieces of these documents.

        ``first`` is a document's place in its queue, ``count`` its tokens. A queue that
        sends every round is cut by rounds, one that waits by the quanta it sends.
        """
        waits = self.quantum[queue] > 1
        last = first + count - 1
        low = np.where(waits, first // self.quantum[queue], self.round_of(queue, first))
        high = np.where(waits, last // self.quantum[queue], self.round_of(queue, last))
        steps = high - low + 1
        doc = np.repeat(np.arange(len(queue)), steps)
        step, q = repeat_ranges(low, steps), queue[doc]
        rounds = np.where(waits[doc], self.round_of(q, step * self.quantum[q]), step)
        began = self.sent(q, rounds - 1)
        start, end = np.maximum(first[doc], began), np.minimum(first[doc] + count[doc], self.sent(q, rounds))
        some = end > start
        doc, q, rounds, began, start, end = (x[some] for x in (doc, q, rounds, began, start, end))
        place = start - began
        for other in range(len(self.totals)):
            earlier = self.sent(other, rounds - 1)
            place += np.where(other < q, self.sent(other, rounds), earlier)
        # Cut where sequences end, then join what stayed together.
        low, high = self.sequence_of(place), self.sequence_of(place + end - start - 1)
        cuts = high - low + 1
        row, sequence = np.repeat(np.arange(len(doc)), cuts), repeat_ranges(low, cuts)
        at = np.maximum(place[row], self.edge(sequence))
        to = np.minimum((place + end - start)[row], self.edge(sequence + 1))
        begin = start[row] + at - place[row] - first[doc[row]]
        doc, offset, length = doc[row], at - self.edge(sequence), to - at
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (at[1:] != to[:-1])
        heads = np.flatnonzero(new)
        length = np.add.reduceat(length, heads) if len(heads) else length
        return doc[heads], begin[heads], length, sequence[heads], offset[heads]


def queue_table(amounts: DataFrame, work: Workspace, own: int, shared: int, mixture: dict[str, float] | None):
    """The queue of every source that has its own, and all queues' tokens and weights (bounded lists)."""
    per_source = work.save(amounts.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    largest = per_source.orderBy(F.desc("n"), "source").limit(own).select("source")
    numbered = work.save(largest.select("source", (F.row_number().over(W.orderBy("source")) - 1).cast("int").alias("queue")), "queues")
    shared_queue = F.lit(own) + F.pmod(F.xxhash64("source"), F.lit(shared)).cast("int")
    weight = F.col("n").cast("double")
    if mixture is not None:
        given = amounts.sparkSession.createDataFrame(list(mixture.items()), "source string, weight double")
        per_source, weight = per_source.join(F.broadcast(given), "source", "left"), F.coalesce("weight", F.lit(0.0))
    found = (
        per_source.join(F.broadcast(numbered), "source", "left")
        .groupBy(F.coalesce("queue", shared_queue).alias("queue"))
        .agg(F.sum("n").alias("n"), F.sum(weight).alias("weight"))
        .orderBy("queue")
        .collect()
    )
    dense = {r.queue: k for k, r in enumerate(found)}
    return numbered, shared_queue, dense, [r.n for r in found], [r.weight for r in found]


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    length: int = LENGTH,
    end_token: int = END_TOKEN,
    source: str = "source",
    mixture: dict[str, float] | None = None,
    least: int = LEAST,
    own_queues: int = OWN_QUEUES,
    broadcast_rows: int = BROADCAST_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """The pieces of all documents: where each stands in which sequence, with a digest of its ids.

    ``mixture`` gives the target proportions by source; a source that it leaves out gets
    the least credit. Without it the target is the corpus' own mixture, so
    that all queues end together.
    """
    work = work or Workspace(docs.sparkSession, "packing")
    stored = work.save(tokenise(docs, tokenizer, end_token, source), "tokens")
    amounts = work.save(stored.groupBy("chunk", "source").agg(F.sum("n").alias("n")), "amounts")
    numbered, shared_queue, dense, totals, weights = queue_table(amounts, work, own_queues, REST_QUEUES, mixture)
    plan = Schedule(totals, weights, length, least)
    in_order = W.partitionBy("queue").orderBy("chunk", "source").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        amounts.join(F.broadcast(numbered), "source", "left")
        .withColumn("queue", F.coalesce("queue", shared_queue))
        .select("chunk", "source", "queue", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("earlier"))
    )
    offsets = work.save(offsets, "offsets")
    if offsets.count() <= broadcast_rows:
        offsets = F.broadcast(offsets)
    queued = stored.join(offsets, ["chunk", "source"]).select("doc_id", "queue", (F.col("before") + F.col("earlier")).alias("first"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                yield cut(batch.slice(low, 512))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        queue = np.array([dense[q] for q in part.column(1).to_pylist()], dtype=np.int64)
        first, count = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        doc, start, size, sequence, offset = plan.pieces(queue, first, count)
        ids = [memoryview(i) for i in part.column(4).to_pylist()]
        spans = zip(doc.tolist(), (start * 4).tolist(), ((start + size) * 4).tolist())
        digest = np.fromiter((zlib.crc32(ids[d][a:b]) for d, a, b in spans), dtype=np.int64, count=len(doc))
        columns = part.column(0).take(pa.array(doc)), start, size, digest, count[doc], sequence, offset, queue[doc]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return queued.mapInArrow(run, PIECES)
