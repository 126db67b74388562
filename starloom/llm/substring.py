"""Substring dedup with fixed-block anchors.

A passage counts as repeated if a window of ``window`` consecutive words stands
anywhere else, too. Every window holds a whole block of ``window // 2`` words
when a document is cut into such blocks from its start. So:

1. *Index* the non-overlapping blocks of all documents, and *probe* them with
   the rolling runs of the same length: a block whose words start anywhere else
   is an anchor.
2. *Extend* anchors word by word: all windows over an anchor are looked up by
   96 bits of their hash (and the bucket it falls into), and those that stand twice
   are taken; neighbouring ones join to maximal repeats. Counting windows in place of comparing pairs
   keeps a passage that stands in a third of all documents linear.
3. Cut the words of taken windows out.

The documents are stored once as chunks, a few thousand documents each, in a
table bucketed by chunk. Steps 1 and 2 send nothing but hashes, dealt by value
over many buckets, once per chunk and value; the answer is a bit per hash sent,
in the order sent. Hence the answers find their chunk without moving any text.
A hash that is wrong by chance in step 1 costs a lookup, no more; the 96 bits and
the bucket decide in step 2, words are not compared.

Words are split at the ASCII white space. Null texts have no words. Every row
is a document of its own, repeated and null ids included; extra columns do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, gram_hashes, shuffle_width, text_bytes, word_bounds

WINDOW = 35
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8_000_000
BUCKETS_PER_PARTITION = 8

CHUNKS = "chunk long, ids array<long>, texts array<binary>"
SENT = "bucket int, chunk long, probes binary, asked binary"
ANSWER = "chunk long, bucket int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def make_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of about ``chunk_bytes`` of text, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = xxhash.xxh64(f"{TaskContext.get().partitionId()}/{number}")
            for text in texts:
                name.update(text)
            values = [name.intdigest() - (1 << 63)], [ids], [texts]
            types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types)], names=["chunk", "ids", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(b" ".join(text.split()))
                held += len(texts[-1]) + 16
                if held >= chunk_bytes:
                    yield flush()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, CHUNKS)


def strong(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece)


class Keys:
    """Hashes of a chunk, once per value, in an order that groups them by bucket.

    ``rows`` has one or two 64-bit numbers per hash; the first one is dealt by
    its high bits, so sorting by it sorts by bucket.
    """

    def __init__(self, rows: list[np.ndarray], buckets: int):
        order = np.lexsort(rows[::-1])
        ranked = [r[order] for r in rows]
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for r in ranked:
            new[1:] |= r[1:] != r[:-1]
        place = np.cumsum(new) - 1
        self.inverse = np.empty(len(order), dtype=np.int64)
        self.inverse[order] = place
        self.values = [r[new] for r in ranked]
        self.times = np.bincount(place, minlength=len(self.values[0]))
        bucket = ((self.values[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        self.parts = {
            int(bucket[a]): slice(a, b)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)])
            if b > a
        }

    def packed(self, part: slice, width: int) -> bytes:
        """The low ``width`` bytes of every number, row by row."""
        low = [v[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width] for v in self.values]
        return np.concatenate(low, axis=1).tobytes()

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answered bit of every hash, in the order given; unanswered buckets are all zero."""
        out = np.zeros(len(self.values[0]), dtype=bool)
        for bucket, bits in answers.items():
            part = self.parts[bucket]
            count = part.stop - part.start
            out[part] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=count).astype(bool)
        return out[self.inverse]


#: Bytes sent of each 64-bit number, besides what the bucket tells.
BLOCK_WIDTH, WINDOW_WIDTH = 5, 6


def unpacked(data: bytes, width: int) -> np.ndarray:
    """The sent rows as one comparable value each."""
    return np.frombuffer(data, dtype=f"V{width}")


class Chunk:
    """The documents of a chunk and the hashes asked about them."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts, self.window, self.block = texts, window, (window + 1) // 2
        self.bounds = [word_bounds(t) for t in texts]

    def runs(self, step: int) -> np.ndarray:
        """Hashes of runs of block length in all documents that hold a window."""
        parts = [
            gram_hashes(t, *b, self.block, strong, step)
            for t, b in zip(self.texts, self.bounds)
            if len(b[0]) >= self.window
        ]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)

    def windows(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Per document the starts of the windows over an anchor."""
        out, at = [], 0
        for starts, _ in self.bounds:
            words = len(starts)
            if words < self.window:
                out.append(np.empty(0, dtype=np.int64))
                continue
            blocks = -(-(words - self.block + 1) // self.block)
            found = np.flatnonzero(anchors[at : at + blocks]) * self.block
            at += blocks
            # The first whole block of a window starts less than a block after it.
            first = (found[:, None] - np.arange(self.block)[None, :]).ravel()
            out.append(np.unique(first[(first >= 0) & (first <= words - self.window)]))
        return out

    def window_keys(self, windows: list[np.ndarray], buckets: int) -> Keys:
        """The 128-bit hashes of all these windows."""
        rows = []
        for text, (starts, ends), own in zip(self.texts, self.bounds, windows):
            if len(own):
                first, last = starts[own].tolist(), ends[own + self.window - 1].tolist()
                rows.append(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(first, last)]))
        halves = np.frombuffer(b"".join(rows), dtype="<u8").reshape(-1, 2)
        return Keys([halves[:, 0], halves[:, 1]], buckets)

    def cut(self, windows: list[np.ndarray], taken: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Words, removed words and the kept text of each document."""
        at = 0
        for text, (starts, ends), own in zip(self.texts, self.bounds, windows):
            words = len(starts)
            hit = own[taken[at : at + len(own)]]
            at += len(own)
            if not len(hit):
                yield words, 0, text
                continue
            change = np.zeros(words + 1, dtype=np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + self.window, -1)
            kept = np.cumsum(change[:words]) == 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.astype(np.int8), [0]))))
            spans = zip(starts[edges[::2]].tolist(), ends[edges[1::2] - 1].tolist())
            yield words, int(words - kept.sum()), b" ".join([text[a:b] for a, b in spans])


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("probes", pa.binary()), ("asked", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _send_blocks(buckets: int, name: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """All rolling runs as probes (twice if they stand more than once in the chunk), and the blocks."""
    rolling, blocks = Keys([chunk.runs(1)], buckets), Keys([chunk.runs(chunk.block)], buckets)
    rows = []
    for bucket, part in rolling.parts.items():
        probes = rolling.packed(part, BLOCK_WIDTH)
        again = rolling.times[part] > 1
        if again.any():
            probes += unpacked(probes, BLOCK_WIDTH)[again].tobytes()
        asked = blocks.parts.get(bucket)
        rows.append((bucket, name, probes, blocks.packed(asked, BLOCK_WIDTH) if asked else b""))
    yield from _rows(_SENT, rows)


def _send_windows(buckets: int, name: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    """The windows, and a bit for those that stand more than once in the chunk."""
    rows = [
        (bucket, name, keys.packed(part, WINDOW_WIDTH), np.packbits(keys.times[part] > 1).tobytes())
        for bucket, part in keys.parts.items()
    ]
    yield from _rows(_SENT, rows)


def _numbers(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of at most eight bytes as numbers."""
    data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), dtype=np.uint8)
    out[:, :width] = data
    return out.view("<u8").ravel()


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones: one pass for all chunks of a bucket."""
    if not len(ranked):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[place] == values


def _answer_blocks(group: pa.Table) -> pa.Table:
    """A block is an anchor if its value was probed at least twice: once by itself."""
    bucket = group.column("bucket")[0].as_py()
    probes = np.sort(_numbers(group.column("probes").to_pylist(), BLOCK_WIDTH))
    shared = np.unique(probes[1:][probes[1:] == probes[:-1]])
    asked = group.column("asked").to_pylist()
    hit = _among(_numbers(asked, BLOCK_WIDTH), shared)
    rows, at = [], 0
    for name, sent in zip(group.column("chunk").to_pylist(), asked):
        own = hit[at : at + len(sent) // BLOCK_WIDTH]
        at += len(own)
        if own.any():
            rows.append((name, bucket, np.packbits(own).tobytes()))
    return pa.Table.from_batches(_rows(_ANSWER, rows), schema=_ANSWER)


def _answer_windows(group: pa.Table) -> pa.Table:
    """A window is taken if another chunk sent it, too, or it stands twice in its own."""
    bucket = group.column("bucket")[0].as_py()
    sent = group.column("probes").to_pylist()
    counts = [len(s) // (2 * WINDOW_WIDTH) for s in sent]
    halves = np.frombuffer(b"".join(sent), dtype=np.uint8).reshape(-1, WINDOW_WIDTH)
    wide = np.zeros((len(halves), 8), dtype=np.uint8)
    wide[:, :WINDOW_WIDTH] = halves
    pairs = wide.view("<u8").reshape(-1, 2)
    keys = Keys([pairs[:, 0], pairs[:, 1]], 1)
    several = (keys.times > 1)[keys.inverse]
    rows, at = [], 0
    for name, count, twice in zip(group.column("chunk").to_pylist(), counts, group.column("asked").to_pylist()):
        hit = several[at : at + count] | np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=count).astype(bool)
        at += count
        if hit.any():
            rows.append((name, bucket, np.packbits(hit).tobytes()))
    return pa.Table.from_batches(_rows(_ANSWER, rows), schema=_ANSWER)


def _answers(data: list | None) -> dict[int, bytes]:
    return {a["bucket"]: a["bits"] for a in data or ()}


def cut_repeats(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, work: Workspace | None = None
) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (UTF-8 bytes, joined by a space) of every document."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "substring")
    width = shuffle_width(spark)
    buckets = width * BUCKETS_PER_PARTITION
    name = f"chunks_{uuid.uuid4().hex}"
    stored = make_chunks(docs, chunk_bytes)
    stored.write.bucketBy(width, "chunk").option("path", f"{work.path}/chunks").saveAsTable(name)
    chunks = spark.table(name)

    def each(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one = {c: batch.column(k)[row].as_py() for k, c in enumerate(batch.schema.names)}
                    yield from make(one, Chunk(one["texts"], window))

        return run

    def ask(sent: DataFrame, answer, step: str) -> DataFrame:
        got = sent.groupBy("bucket").applyInArrow(answer, ANSWER)
        return work.save(got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(step)), step)

    def anchored_windows(one: dict, chunk: Chunk) -> list[np.ndarray]:
        return chunk.windows(Keys([chunk.runs(chunk.block)], buckets).answered(_answers(one["anchors"])))

    def send_blocks(one: dict, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        yield from _send_blocks(buckets, one["chunk"], chunk)

    def send_windows(one: dict, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        yield from _send_windows(buckets, one["chunk"], chunk.window_keys(anchored_windows(one, chunk), buckets))

    def finish(one: dict, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        windows = anchored_windows(one, chunk)
        hit = chunk.window_keys(windows, buckets).answered(_answers(one["taken"]))
        rows = [(i, *cut) for i, cut in zip(one["ids"], chunk.cut(windows, hit))]
        yield from _rows(_RESULT, rows)

    anchors = ask(chunks.select("chunk", "texts").mapInArrow(each(send_blocks), SENT), _answer_blocks, "anchors")
    anchored = chunks.select("chunk", "texts").join(anchors, "chunk")
    taken = ask(anchored.mapInArrow(each(send_windows), SENT), _answer_windows, "taken")
    answers = anchors.join(taken, "chunk", "left")
    result = chunks.join(answers, "chunk", "left").mapInArrow(each(finish), RESULT)
    # The catalog's entry is needed to plan by buckets only; the files stay, as the table has a path of its own.
    spark.sql(f"DROP TABLE {name}")
    return result
