"""Exact dedup: an index of live digests behind a cuckoo filter.

The index has *members* (one row per live document with its digest), and *keys*
(one row per distinct digest). Keys are spread over shards by digest. In a
shard a cuckoo filter answers "may be there"; a hit is verified against the
content stored for the two buckets of the fingerprint: the whole SHA-256 of the
normalised text, its length and a second hash. A filter that overflows is built
anew, twice as large, from the stored keys.

Each task first folds its own rows by digest, so a text that makes up a third
of the corpus reaches its shard as one row per task. Shards hold distinct
digests, which are spread evenly whatever the texts are. Members are joined to
the keys by digest; Spark may split a hot digest there, as the keys' side is
unique.

Null texts count as empty; null ids are kept and sort last; every input row is
a document of its own, repeated ids included. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, fresh_names, text_column

SLOTS = 4
MAX_KICKS = 200
#: Members per shard, about: a shard's distinct keys are held by one task.
ROWS_PER_SHARD = 250_000

MEMBER = "doc_id long, digest binary, content_length long, content_check long, n_chars long"
KEY = (
    "shard int, kind int, digest binary, content_length long, content_check long, "
    "live long, best_chars long, best_id long"
)
FILTER, STORED, ADD, SET = range(4)


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots, each with two possible buckets."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7 | 1) & (self.buckets - 1))

    def may_contain(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        return mark in self.table[first].tolist() or mark in self.table[second].tolist()

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket].tolist()
        if 0 in row:
            self.table[bucket, row.index(0)] = mark
            return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the table must then be built anew from the keys."""
        mark, bucket, second = self.places(digest)
        if self._put(bucket, mark) or self._put(second, mark):
            return True
        for kick in range(MAX_KICKS):
            slot = (mark + kick) % SLOTS
            out = int(self.table[bucket, slot])
            self.table[bucket, slot] = mark
            mark, bucket = out, self.other(bucket, out)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take one fingerprint out. Only for digests known to be in."""
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            row = self.table[bucket].tolist()
            if mark in row:
                self.table[bucket, row.index(mark)] = 0
                return True
        return False


class ShardIndex:
    """One shard: the filter and the stored content, by pair of buckets."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.filter = CuckooFilter(buckets, table)
        self.content: dict[int, list[list]] = {}
        self.size = 0
        self.resizes = 0

    def _home(self, digest: bytes) -> int:
        _, first, second = self.filter.places(digest)
        return min(first, second)

    def load(self, entry: list) -> None:
        """Take over a key whose fingerprint is in the filter already."""
        self.content.setdefault(self._home(entry[0]), []).append(entry)
        self.size += 1

    def find(self, digest: bytes, length: int, check: int) -> list | None:
        if not self.filter.may_contain(digest):
            return None
        for entry in self.content.get(self._home(digest), ()):  # verified, not believed
            if entry[0] == digest and entry[1] == length and entry[2] == check:
                return entry
        return None

    def insert(self, entry: list) -> None:
        if self.filter.insert(entry[0]):
            self.load(entry)
        else:
            self.rebuild([*self.entries(), entry], self.filter.buckets * 2)

    def rebuild(self, entries: list[list], buckets: int) -> None:
        self.resizes += 1
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(e[0]) for e in entries):
                break
            buckets *= 2
        self.content, self.size = {}, 0
        for e in entries:
            self.load(e)

    def delete(self, entry: list) -> None:
        home = self._home(entry[0])
        self.filter.delete(entry[0])
        self.content[home].remove(entry)
        if not self.content[home]:
            del self.content[home]
        self.size -= 1

    def entries(self) -> list[list]:
        return [e for bucket in self.content.values() for e in bucket]


def better(chars: int, doc_id: int | None, than_chars: int, than_id: int | None) -> bool:
    """More code points first, then the smaller id, null last."""
    if chars != than_chars:
        return chars > than_chars
    return doc_id is not None and (than_id is None or doc_id < than_id)


_KEY = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary())]
    + [(c, pa.int64()) for c in ("content_length", "content_check", "live", "best_chars", "best_id")]
)


def update_shard(group: pa.Table) -> pa.Table:
    """State and changes of a shard in, new state out."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in _KEY.names)), key=lambda r: r[1])
    shard, index = rows[0][0], ShardIndex()
    for _, kind, digest, length, check, live, chars, best_id in rows:
        if kind == FILTER:
            table = np.frombuffer(digest, dtype=np.uint16).reshape(live, SLOTS)
            index = ShardIndex(live, table.copy())
            continue
        if kind == STORED:
            index.load([digest, length, check, live, chars, best_id])
            continue
        entry = index.find(digest, length, check)
        if entry is None:
            if live:
                index.insert([digest, length, check, live, chars, best_id])
        elif kind == ADD:
            entry[3] += live
            if better(chars, best_id, entry[4], entry[5]):
                entry[4:] = [chars, best_id]
        elif live:
            entry[3:] = [live, chars, best_id]
        else:
            index.delete(entry)
    out = [(shard, FILTER, index.filter.table.tobytes(), 0, 0, index.filter.buckets, 0, None)]
    out += [(shard, STORED, *e) for e in index.entries()]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _KEY)], schema=_KEY)


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task folded by digest; memory is bounded by flushing."""
    best: dict[tuple, list] = {}

    def flush():
        rows = [[*k, v[0], v[1], v[2]] for k, v in best.items()]
        best.clear()
        names = ["digest", "content_length", "content_check", "live", "best_chars", "best_id"]
        kinds = [pa.binary(), *[pa.int64()] * 5]
        columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("digest", "content_length", "content_check", "n_chars", "doc_id"))
        for digest, length, check, chars, doc_id in zip(*columns):
            key = (digest, length, check)
            entry = best.get(key)
            if entry is None:
                best[key] = [1, chars, doc_id]
            else:
                entry[0] += 1
                if better(chars, doc_id, entry[1], entry[2]):
                    entry[1:] = [chars, doc_id]
        if len(best) > 100_000:
            yield flush()
    if best:
        yield flush()


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_column(name), "[\\x20\\x09-\\x0D]+", "")


def digest_columns(name: str = "text") -> dict[str, Column]:
    return {
        "digest": F.unhex(F.sha2(F.col("_normal"), 256)),
        "content_length": F.length("_normal").cast("long"),
        "content_check": F.xxhash64("_normal"),
        "n_chars": F.length(text_column(name)).cast("long"),
    }


def member_rows(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", normalised().alias("_normal"))
    made = digest_columns()
    return slim.select("doc_id", *[c.alias(n) for n, c in made.items()])


class ExactIndex:
    """A live index in a shared folder. Every change writes a new version; nothing is overwritten."""

    def __init__(
        self, spark: SparkSession, work: Workspace | None = None, shards: int | None = None, rows_per_shard: int = ROWS_PER_SHARD
    ):
        self.spark = spark
        self.work = work or Workspace(spark, "exact-index")
        self.shards, self.rows_per_shard = shards, rows_per_shard
        self.version = 0
        self.members: DataFrame = spark.createDataFrame([], MEMBER)
        self.state: DataFrame = spark.createDataFrame([], KEY)

    def _shard(self) -> Column:
        return F.pmod(F.conv(F.hex(F.substring("digest", 11, 4)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    def _deal(self, more: int) -> None:
        """Shards for the stored keys and ``more`` new ones; stored keys go to their new shards as if they were added."""
        known = self.state.filter(F.col("kind") == STORED)
        wanted = -(-((known.count() if self.version else 0) + more) // self.rows_per_shard)
        if self.shards is None:
            self.shards = max(16, wanted)
        elif wanted > self.shards:
            self.shards = 2 * wanted
            self.state = known.withColumns({"shard": self._shard(), "kind": F.lit(ADD)})

    def _change(self, changes: DataFrame, kind: int, members: DataFrame) -> None:
        rows = changes.select(
            self._shard().alias("shard"), F.lit(kind).alias("kind"), *changes.columns
        ).select(self.state.columns)
        state = rows if self.version == 0 else self.state.unionByName(rows)
        self.version += 1
        self.state = self.work.save(
            state.groupBy("shard").applyInArrow(update_shard, KEY), f"v{self.version}/keys"
        )
        self.members = members

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add documents; returns their member rows."""
        fresh = self.work.save(member_rows(docs), f"v{self.version + 1}/members")
        self._deal(fresh.count())
        folded = fresh.mapInArrow(
            fold_batches,
            "digest binary, content_length long, content_check long, live long, best_chars long, best_id long",
        )
        self._change(folded, ADD, fresh if self.version == 0 else self.members.unionByName(fresh))
        return fresh

    def delete(self, ids: DataFrame) -> None:
        """Take all documents with these ids out; digests without a document leave the filter."""
        if self.version == 0:
            return
        gone = ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("_gone"))
        stay = self.work.save(self.members.join(gone, match, "left_anti"), f"v{self.version + 1}/members")
        key = ["digest", "content_length", "content_check"]
        touched = self.members.join(gone, match, "left_semi").select(*key).distinct()
        order = F.struct("n_chars", F.col("doc_id").isNotNull(), -F.col("doc_id"))
        left = stay.groupBy(*key).agg(
            F.count(F.lit(1)).alias("live"),
            F.max("n_chars").alias("best_chars"),
            F.max_by("doc_id", order).alias("best_id"),
        )
        changes = touched.join(left, key, "left").select(
            *key, F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("best_chars", F.lit(0)).alias("best_chars"), "best_id"
        )
        self._change(changes, SET, stay)

    def keys(self) -> DataFrame:
        """One row per distinct text: digest, number of live documents, the one that stays."""
        return self.state.filter(F.col("kind") == STORED).select(
            "digest",
            F.col("live").alias("group_size"),
            F.col("best_id").alias("keep_id"),
            "best_chars",
        )

    def groups(self) -> DataFrame:
        """One row per live document with the document that stays for it."""
        stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars"))
        return self.members.join(self.keys(), "digest").select(
            "doc_id", "keep_id", "group_size", stays.alias("kept"), "digest"
        )


def exact_groups(docs: DataFrame) -> DataFrame:
    """All documents with the id that stays for each, through a fresh index."""
    index = ExactIndex(docs.sparkSession)
    index.insert(docs)
    return index.groups()


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows with one id and text one stays."""
    index = ExactIndex(docs.sparkSession)
    index.insert(docs)
    digest, key, keep, best = fresh_names(docs, "digest", "key", "keep", "best")
    keys = index.keys().select(
        F.col("digest").alias(key), F.col("keep_id").alias(keep), F.col("best_chars").alias(best), (F.col("group_size") == 1).alias("single")
    )
    own = docs.withColumn(digest, F.unhex(F.sha2(normalised(), 256)))
    on = (
        (F.col(digest) == F.col(key))
        & F.col("doc_id").cast("long").eqNullSafe(F.col(keep))
        & (F.length(text_column()) == F.col(best))
    )
    # Digest and id together are the join's key, so a hot text does not gather in one task. Only rows
    # of texts that stand several times are dealt out to keep one of them.
    alone = own.join(keys.filter("single"), on, "left_semi")
    several = own.join(keys.filter("NOT single"), on, "left_semi").dropDuplicates([digest, "doc_id"])
    return alone.unionByName(several).select(*docs.columns)
