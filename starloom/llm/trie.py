"""Conversation prefix trie with sums over subtrees, rolled up by depth bands.

A node is a distinct sequence of first turns (role, text) of the conversations, the
root the empty one. Its key is the exclusive or of 120-bit digests of
(depth, role, text) of its turns, so keys are prefix sums and need no chain.

*Rows.* Turns are numbered within their conversation by ranges, not by groups: the rows
are range partitioned by (conversation, turn, role, text), numbered per partition, and
partitions that go on with a conversation add the counts of the partitions before (at
most one number per partition). Prefix keys are built within blocks of ``BLOCK`` turns and
then over blocks. So no task needs a whole conversation.

*Rollup.* Sums over subtrees go by bands of ``HEIGHT`` depths. Within its band a node
explodes to its ancestors, at most ``HEIGHT`` of them; this completes the lowest band and
gives all others their part. The tops of the bands (every ``HEIGHT``-th depth) form
a trie of their own, ``HEIGHT`` times lower, whose sums are found in the same way,
and so on; then each completed top is handed to its ancestors in the band above. That takes
log(depth) / log(HEIGHT) levels, and a node makes at most 2 * HEIGHT rows a level.
A node's ancestors are read off the path of its smallest member, so only paths of
conversations that own a node are looked at, however many copies they have.

Turns are ordered by turn (null first), then role and text; null roles and texts
are empty. Repeated rows are turns of their own. Rows without ``conv_id`` belong to no
conversation and are left out. An empty table has no conversation, hence no node, not
even a root. Extra columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, shuffle_width

HEIGHT = 16
BLOCK = 256
IDS_PER_BLOCK = 4096
KEY = ["depth", "k1", "k2"]

_NUMBERED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("words", pa.int64())])
NUMBERED = "conv_id long, part int, local long, d1 long, d2 long, words long"
_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
ENDS = "depth long, k1 long, k2 long, ends_sha256 string"


def sixty_bits(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little") >> 4, int.from_bytes(digest[8:16], "little") >> 4


def numbered_turns(conversations: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, ``i`` (place in the conversation from 1), a digest of (role, text), and the text's words."""
    spark = conversations.sparkSession
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = slim.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                count = count + 1 if conv == last else 1
                last = conv
                digest = hashlib.blake2b(role + b"\0" + text, digest_size=16, salt=len(role).to_bytes(8, "little")).digest()
                rows.append((conv, part, count, *sixty_bits(digest), len(text.split())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NUMBERED)], schema=_NUMBERED)

    turns = dealt.select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary")).mapInArrow(run, NUMBERED)
    turns = work.save(turns, "turns")
    # Only a partition's first conversation can have begun in an earlier one: a row per partition at most.
    counts = turns.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = counts.select("conv_id", "part", before.alias("before")).filter("before > 0")
    return turns.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("i"), "d1", "d2", "words"
    )


def shared_head(conv: Column) -> Column:
    """How many turns a conversation takes from its base (0 to 3)."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt_turns(conversations: DataFrame, work: Workspace, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, digest, words), and all ids with their length.

    A conversation begins with the first ``shared_head`` turns of its base, the one whose id is the next
    lower multiple of ``every``, and goes on with its own turns after as many.
    """
    turns = work.save(numbered_turns(conversations, work), "numbered")
    ids = turns.groupBy("conv_id").agg(F.max("i").alias("own")).withColumn("h", shared_head(F.col("conv_id")))
    ids = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    # At most three turns of a base, asked for by at most 2 * every - 1 conversations.
    heads = turns.filter((F.col("i") <= 3) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.max("i").alias("n"))
    taken = F.least("h", F.coalesce("n", F.lit(0)))
    ids = ids.join(lengths, "base", "left").withColumn("taken", taken)
    ids = work.save(ids.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "ids")
    first = ids.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("i <= taken")
    rest = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("i > h")
    made = first.select("conv_id", F.col("i").alias("depth"), "d1", "d2", "words").unionByName(
        rest.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "words")
    )
    return made, ids.select("conv_id", "length")


def prefix_paths(turns: DataFrame, ids: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, depth, the key of the prefix and of its parent, and the words of its last text; depth 0 included."""

    def term(seed: int) -> Column:
        return F.shiftright(F.xxhash64(F.lit(seed), "depth", "d1", "d2"), 4)

    block = F.floor((F.col("depth") - 1) / BLOCK)
    inside = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    terms = turns.withColumns({"block": block, "t1": term(17), "t2": term(71)})
    local = terms.withColumns({"k1": F.bit_xor("t1").over(inside), "k2": F.bit_xor("t2").over(inside)})
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = terms.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("t1").over(earlier).alias("b1"), F.bit_xor("t2").over(earlier).alias("b2"))
    joined = local.join(blocks.filter("block > 0"), ["conv_id", "block"], "left")

    def whole(key: str, carried: str) -> Column:
        return F.col(key).bitwiseXOR(F.coalesce(carried, F.lit(0)))

    paths = joined.withColumns({"k1": whole("k1", "b1"), "k2": whole("k2", "b2")}).select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "words"
    )
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "words")])
    return work.save(paths.unionByName(roots), "paths")


def subtree_sums(paths: DataFrame, nodes: DataFrame, values: list[str], work: Workspace, height: int = HEIGHT, level: int = 0) -> DataFrame:
    """The ``values`` of every node summed over its subtree: columns ``depth``, ``k1``, ``k2`` and the sums.

    ``nodes`` are the nodes with their smallest member ``conv_id``; ``paths`` holds (conv_id, depth, key)
    of all prefixes. Depths count in steps of this level.
    """
    band = F.floor(F.col("depth") / height)
    slim = nodes.select("conv_id", *KEY, *values)
    owned = slim.groupBy("conv_id").agg(F.min("depth").alias("first"))
    # Of a path, the nodes it owns are its end; above them the band's other nodes are wanted.
    above = (
        paths.join(owned, "conv_id")
        .filter((F.col("depth") < F.col("first")) & (band == F.floor(F.col("first") / height)))
        .select("conv_id", *KEY, *[F.lit(None).cast("long").alias(v) for v in values])
    )
    down = W.partitionBy("conv_id", band).orderBy("depth")  # at most ``height`` rows
    chains = slim.unionByName(above).withColumn("up", F.collect_list(F.struct(*KEY)).over(down))
    sums = [F.sum(v).alias(v) for v in values]
    inside = (
        chains.filter(F.col(values[0]).isNotNull())
        .select(F.explode("up").alias("a"), *values)
        .groupBy(*[F.col(f"a.{k}").alias(k) for k in KEY])
        .agg(*sums)
    )
    inside = work.save(inside, f"inside-{level}")
    if (inside.agg(F.max("depth")).first()[0] or 0) < height:
        return inside
    step = (F.col("depth") / height).cast("long")
    tops = inside.filter(F.col("depth") % height == 0)
    tops = tops.join(nodes.select("conv_id", *KEY), KEY).withColumn("depth", step)
    tops = work.save(tops.select("conv_id", *KEY, *values), f"tops-{level}")
    higher = paths.filter(F.col("depth") % height == 0).select("conv_id", step.alias("depth"), "k1", "k2")
    done = subtree_sums(higher, tops, values, work, height, level + 1)
    # A completed top belongs to its ancestors in the band above, all on the path of its smallest member.
    handed = (
        tops.select("conv_id", *KEY)
        .join(done, KEY)
        .filter("depth > 0")
        .select("conv_id", (F.col("depth") - 1).alias("band"), *values)
        .join(paths.select("conv_id", band.alias("band"), *KEY), ["conv_id", "band"])
        .select(*KEY, *values)
    )
    return work.save(inside.unionByName(handed).groupBy(*KEY).agg(*sums), f"sums-{level}")


def end_digests(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """SHA-256 of the members that end at a node, as decimals in order, joined by commas.

    Members are first joined to strings of up to ``IDS_PER_BLOCK`` neighbouring ids; the digest reads a
    node's strings in order, one at a time.
    """
    ends = paths.join(ids.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", *KEY)
    block = F.floor(F.col("conv_id") / IDS_PER_BLOCK).cast("long")
    strings = ends.groupBy(*KEY, block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = strings.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, F.col("ids").cast("binary").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for *key, some in zip(*(c.to_pylist() for c in batch.columns)):
                if key == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                digest.update(some)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENDS)], schema=_ENDS)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*last, digest.hexdigest()), _ENDS)], schema=_ENDS)

    return dealt.mapInArrow(run, ENDS)


def prefix_trie(conversations: DataFrame, every: int = 20, height: int = HEIGHT, work: Workspace | None = None) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    work = work or Workspace(conversations.sparkSession, "trie")
    turns, ids = rebuilt_turns(conversations, work, every)
    paths = prefix_paths(turns, ids, work)
    nodes = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "words")]
    )
    nodes = work.save(nodes, "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns(
        {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    )
    nodes = work.save(nodes, "counted")
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(paths.select("conv_id", *KEY), nodes, values, work, height)
    above = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    up = (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop(*values)
        .join(above, up, "left")
        .join(sums, KEY)
        .join(end_digests(paths, ids), KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )


