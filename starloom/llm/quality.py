"""Quality classifier: votes of the nearest labelled documents in a latent space.

The terms of a document are its trigrams of character classes (small, capital,
digit, space, kinds of punctuation) and its repetitions (words equal to the one
before, words seen before). A truncated singular value decomposition of the
labelled sample's term matrix gives the latent space. The labelled vectors are
broadcast; every document gets its exact cosine with each of them, block by
block, and its score is the similarity-weighted share of label 1 among the
nearest ``neighbours``.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of
their id, hence what is broadcast has a fixed bound (``SAMPLE`` vectors of
``DIMENSIONS`` numbers and the projection). Scoring reads every whole text once and shuffles nothing.

Null texts count as empty; a text without any term has no neighbours and gets
the sample's share of label 1. Without any training row the score is 0.5.
Labels that are null are left out; a document with several labels counts once
for each. Repeated documents are scored each; extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import text_bytes, text_column

SAMPLE, DIMENSIONS, NEIGHBOURS, THRESHOLD = 6_000, 48, 15, 0.3
#: Rows per block of the cosine product.
BLOCK = 256

CLASSES = 12
_CLASS = np.full(256, 11, dtype=np.uint16)
for _symbols, _number in ((b" ", 0), (b"\t\n\x0b\x0c\r", 1), (b".", 6), (b",;:", 7), (b"!?", 8), (b"|", 9), (b"#*$%&", 10)):
    _CLASS[list(_symbols)] = _number
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
TERMS = CLASSES**3 + 3


def terms(text: bytes) -> np.ndarray:
    """Square roots of the shares of each term, as a unit vector (or zero)."""
    out = np.zeros(TERMS, dtype=np.float32)
    if len(text) >= 3:
        kind = _CLASS[np.frombuffer(text, dtype=np.uint8)]
        grams = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        out[: CLASSES**3] = np.bincount(grams, minlength=CLASSES**3) / len(grams)
    words = text.split()
    if words:
        again = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        known = 1 - len(set(words)) / len(words)
        # Without these, a text of one repeated word looks like prose.
        out[CLASSES**3 :] = again, known * known, 1 / len(words)
    out = np.sqrt(out)
    size = np.linalg.norm(out)
    return out / size if size else out


@dataclass
class Model:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weight) @ self.basis
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Votes for a block of term vectors."""
        prior = np.full(len(rows), self.prior)
        if not len(self.labels):
            return prior
        similar = self.project(rows) @ self.vectors.T
        k = min(self.neighbours, similar.shape[1])
        nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, nearest, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[nearest]).sum(axis=1)
        return np.clip(np.divide(votes, total, out=prior, where=total > 0), 0, 1)


def decompose(rows: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int) -> Model:
    """The latent space of a labelled term matrix. Terms weigh by their spread, as frequent ones tell least."""
    if not len(rows):
        empty = np.zeros((TERMS, 1), dtype=np.float32)
        return Model(np.ones(TERMS, np.float32), empty, np.zeros((0, 1), np.float32), labels, 0.5, neighbours)
    deviation = rows.std(axis=0, dtype=np.float64)
    weight = (1 / np.sqrt(deviation + 0.01)).astype(np.float32)
    scaled = rows * weight
    values, vectors = np.linalg.eigh((scaled.T @ scaled).astype(np.float64))
    basis = vectors[:, ::-1][:, : min(dimensions, len(rows))]
    basis = (basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])).astype(np.float32)
    model = Model(weight, basis, np.zeros((0, basis.shape[1]), np.float32), labels, float(labels.mean()), neighbours)
    model.vectors = model.project(rows)
    return model


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows outside the held-out fold, the same ones at every run."""
    key = F.col("doc_id").cast("long")
    return (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select(key.alias("doc_id"), F.col("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64(key), key, "label")
        .limit(sample)
    )


def held_out(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS
) -> Model:
    chosen = F.broadcast(training_rows(labels, sample))  # at most ``sample`` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).join(chosen, "doc_id")
    texts = texts.select("doc_id", "label", F.xxhash64("text").alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t).tobytes() for t in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array(rows, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "digest", "terms"])

    # Repeated ids could make the sample larger than its bound: rows count once, and those that stay are
    # chosen by what they are. The choice is made on three numbers a row, the terms follow.
    key = ["doc_id", "label", "digest"]
    stay = texts.select(*key).distinct().orderBy(F.xxhash64(*key), *key).limit(sample)
    found = texts.join(F.broadcast(stay), key, "left_semi").dropDuplicates(key)
    rows = found.mapInArrow(run, "doc_id long, label double, digest long, terms binary").toArrow()
    order = np.lexsort([rows.column(c).to_numpy() for c in reversed(key)])
    flat = b"".join(rows.column("terms").to_pylist())
    matrix = np.frombuffer(flat, dtype=np.float32).reshape(-1, TERMS)[order]
    return decompose(matrix, rows.column("label").to_numpy()[order], dimensions, neighbours)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    out = []
    for at in range(0, len(texts), BLOCK):
        part = texts.slice(at, BLOCK).cast(pa.binary()).to_pylist()
        out.append(model.score(np.array([terms(t or b"") for t in part], dtype=np.float32)))
    return np.concatenate(out)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], names=["doc_id", "score"]
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = _scores(shared.value, batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
