"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors come in blocks of about ``ANCHORS`` rows, dealt by hash. A block's minimum spanning tree
(by Euclidean distance) is sent to all tasks, and each task goes down the tree for its
candidates: a candidate's score with an anchor differs from its score with the parent by at most
the edge's length times the candidate's norm. Where that interval misses all windows
of the anchor, the candidate is passed over and the interval, widened, serves the anchor's
children; otherwise the score is computed. A window is an interval of scores of which the
best ``k`` candidates are wanted; its lower end rises to the k-th best score found so far.

The search runs twice over all rows for each block: for the positives (one open window per anchor,
rows of the same label) and for the negatives (a window per positive, rows of other labels). A task
hands on at most ``k`` rows per window, and the best of these are picked by window functions.
Blocks of anchors against all rows is the work asked for; no table of pairs is made.

Scores are inner products of vectors of whole numbers, exact below 2^53. Shorter vectors count
as filled up with zeros. Rows with a null id, label, vector or component, or a component
that is not finite, take no part. Rows with equal ids are rows of their own; ties go by id.
An empty table, or one without anchors, gives no rows; extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Workspace

ANCHORS = 1024
CANDIDATES_AT_ONCE = 2048

FOUND = "anchor int, slot int, score long, vec_id long, row long"
_FOUND = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vector(name: str, scale: int) -> Column:
    """Components as floor(scale * x); null where one is null or not finite."""
    sound = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(name, lambda x: F.floor(scale * x.cast("double")).cast("double")))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent (-1 for the root) and edge length of each anchor, by Prim's rule."""
    count = len(vectors)
    parent, edge = np.full(count, -1), np.zeros(count)
    near, best = np.zeros(count, dtype=np.int64), np.full(count, np.inf)
    out, order = np.ones(count, dtype=bool), []
    at = 0
    for _ in range(count):
        order.append(at)
        out[at] = False
        away = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        closer = out & (away < best)
        best[closer], near[closer] = away[closer], at
        if not out.any():
            break
        at = int(np.argmin(np.where(out, best, np.inf)))
        parent[at], edge[at] = near[at], best[at]
    return np.array(order, dtype=np.int64), parent, edge


@dataclass
class Block:
    """Anchors with their tree; ``windows[a]`` are the (low, high) scores wanted of anchor ``a``."""

    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    windows: list[list[tuple[float, float]]]
    same: bool
    k: int


class Search:
    """The best candidates of a task, window by window."""

    def __init__(self, block: Block):
        self.block = block
        self.low = [[low for low, _ in w] for w in block.windows]
        self.best = {(a, s): np.empty((0, 3), dtype=np.int64) for a, w in enumerate(block.windows) for s in range(len(w))}
        self.scored = 0

    def feed(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        b = self.block
        norms = np.sqrt((vectors**2).sum(axis=1))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a in b.order.tolist():
            if b.parent[a] < 0:
                need = np.ones(len(ids), dtype=bool)
                low, high = np.empty(len(ids)), np.empty(len(ids))
            else:
                reach = b.edge[a] * norms
                reach += 1e-6 * (1 + reach)  # rounding
                low, high = bounds[b.parent[a]]
                low, high = low - reach, high + reach
                need = np.zeros(len(ids), dtype=bool)
                for (_, top), bottom in zip(b.windows[a], self.low[a]):
                    need |= (high >= bottom) & (low <= top)
                need &= ((labels == b.labels[a]) == b.same) & (rows != b.rows[a])
            at = np.flatnonzero(need)
            score = vectors[at] @ b.vectors[a]
            low[at] = high[at] = score
            bounds[a] = low, high
            self.scored += len(at)
            if b.parent[a] < 0:
                fit = ((labels == b.labels[a]) == b.same) & (rows != b.rows[a])
                at, score = at[fit], score[fit]
            for slot, (_, top) in enumerate(b.windows[a]):
                hit = (score >= self.low[a][slot]) & (score <= top)
                if hit.any():
                    self.take(a, slot, at[hit], score[hit], ids, rows)

    def take(self, a: int, slot: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        new = np.stack([score.astype(np.int64), ids[at], rows[at]], axis=1)
        held = np.concatenate([self.best[a, slot], new])
        held = held[np.lexsort((held[:, 2], held[:, 1], -held[:, 0]))[: self.block.k]]
        self.best[a, slot] = held
        if len(held) == self.block.k:
            self.low[a][slot] = max(self.low[a][slot], float(held[-1, 0]))

    def found(self) -> pa.RecordBatch:
        keys = [k for k, v in self.best.items() if len(v)]
        sizes = [len(self.best[k]) for k in keys]
        held = np.concatenate([self.best[k] for k in keys]) if keys else np.empty((0, 3), dtype=np.int64)
        names = np.repeat(np.array(keys, dtype=np.int32).reshape(-1, 2), sizes, axis=0)
        columns = names[:, 0], names[:, 1], held[:, 0], held[:, 1], held[:, 2]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter lists are filled up, what is longer meets zeros only."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    for k, (start, size) in enumerate(zip(starts, np.minimum(sizes, width))):
        out[k, :size] = flat[start : start + size]
    return out


def search(rows: DataFrame, block: Block) -> DataFrame:
    """The ``k`` best rows of every window: columns of ``FOUND`` and ``rank``."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Search(sent.value)
        width = sent.value.vectors.shape[1]
        for batch in batches:
            for low in range(0, batch.num_rows, CANDIDATES_AT_ONCE):
                part = batch.slice(low, CANDIDATES_AT_ONCE)
                ids, labels, keys = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                task.feed(ids, labels, keys, matrix(part.column(3), width))
        yield task.found()

    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    told = rows.select("vec_id", "label", "row", "vector").mapInArrow(run, FOUND)
    return told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= block.k)


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    anchors_at_once: int = ANCHORS,
    work: Workspace | None = None,
) -> DataFrame:
    """Per anchor and positive the best negatives that score ``low_percent`` to ``high_percent`` of the positive.

    ``rows`` has ``vec_id``, ``label`` and ``vector`` (whole numbers as doubles, see ``whole_vector``).
    """
    spark = rows.sparkSession
    work = work or Workspace(spark, "negatives")
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    slim = rows.filter(known).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", is_anchor.alias("is_anchor")
    )
    stored = work.save(slim.withColumn("row", F.monotonically_increasing_id()), "rows")
    anchors = work.save(stored.filter("is_anchor"), "anchors")
    blocks = -(-anchors.count() // anchors_at_once)
    parts = []
    for number in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").collect()
        if not own:
            continue
        width = max(1, max(len(r.vector) for r in own))
        vectors = np.zeros((len(own), width))
        for k, r in enumerate(own):
            vectors[k, : len(r.vector)] = r.vector
        open_window = [(-np.inf, np.inf)]
        ids = np.array([r.vec_id for r in own])
        shape = vectors, np.array([r.label for r in own]), np.array([r.row for r in own]), *spanning_tree(vectors)
        near = work.save(search(stored, Block(*shape, [open_window] * len(own), True, positives)), f"positives-{number}")
        windows: list[list[tuple[float, float]]] = [[] for _ in own]
        asked = []
        for p in near.orderBy("anchor", "rank").collect():  # a bounded block's positives
            low, high = -(-low_percent * p.score // 100), high_percent * p.score // 100
            if low <= high:
                asked.append((p.anchor, len(windows[p.anchor]), int(ids[p.anchor]), p.vec_id, p.score))
                windows[p.anchor].append((float(low), float(high)))
        if not asked:
            continue
        far = search(stored, Block(*shape, windows, False, negatives))
        told = spark.createDataFrame(asked, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        mined = far.join(F.broadcast(told), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        work.save(mined, f"mined/block={number}")
        parts.append(f"mined/block={number}")
    return work.load(MINED, *parts) if parts else spark.createDataFrame([], MINED)
