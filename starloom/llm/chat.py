"""Chat formatting of reply trees.

Messages name their parent. Self-joins that double their reach give every
message its root, its depth and the summed score of its branch; leaves are
ranked by that score within their tree, and the path of each chosen leaf is
formatted as one conversation. A round joins the messages that have no root yet
with all messages on their unique id; a logarithm of the depth of rounds is
enough, with a table in the shared folder after each. Branches that are not chosen never get their paths built.

The template is ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Inside a
text every ``<``, backslashes, ``|`` gets one backslash more, so no text can
hold a control string, and taking one away restores it. In a role, backslashes
and line ends are escaped as well. The loss mask covers the texts of the trained role.

Null texts and roles count as empty, null scores as 0. A message whose parent
is null or absent is a root; messages on a cycle have no root and are left out.
Ids must be unique; of rows with one id and parent, the first by role and text
is taken. Ties in score go to the deeper branch, then to the smaller leaf id. Extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Workspace

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # An even run of backslashes before an n is no line end: split at escaped backslashes first.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def branches(messages: DataFrame, work: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth and branch score of every message, and its ancestors 1, 2, 4, ... steps up."""
    known = messages.select(F.col("id").alias("_known"))
    parents = messages.join(known, F.col("parent") == F.col("_known"), "left")
    state = parents.select(
        "id",
        F.col("_known").alias("up"),
        F.when(F.col("_known").isNull(), F.col("id")).alias("root"),
        F.when(F.col("_known").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"),
    )
    state = work.save(state, "branches-0")
    settled = state.filter("up IS NULL").drop("up")
    waiting = state.filter("up IS NOT NULL")
    hops: list[DataFrame] = []
    left = waiting.count()
    limit = left.bit_length() + 1
    while left and len(hops) <= limit:  # what is left after that runs in circles
        hops.append(waiting.select("id", "up"))
        # Only messages without a root go on; they look their ancestor up among all.
        target = settled.withColumn("up", F.lit(None).cast(waiting.schema["up"].dataType)).unionByName(waiting)
        above = target.select(F.col("id").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "root", "depth", "total")])
        state = work.save(
            waiting.join(above, "up").select(
                "id",
                F.col("_up").alias("up"),
                F.col("_root").alias("root"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("total") + F.col("_total")).alias("total"),
            ),
            f"branches-{len(hops)}",
        )
        settled = settled.unionByName(state.filter("up IS NULL").drop("up"))
        waiting = state.filter("up IS NOT NULL")
        left = waiting.count()
    return settled, hops


def choose_leaves(messages: DataFrame, settled: DataFrame, best: int | None) -> DataFrame:
    """Leaves with their rank in the tree; ``best`` keeps that many branches of each tree, None all."""
    inner = messages.select(F.col("parent").alias("id")).filter("id IS NOT NULL").distinct()
    leaves = settled.join(inner, "id", "left_anti")
    order = W.partitionBy("root").orderBy(F.col("total").desc(), F.col("depth").desc(), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def paths(leaves: DataFrame, hops: list[DataFrame], settled: DataFrame, work: Workspace) -> DataFrame:
    """Every message of the chosen branches: leaf, root, rank, id and depth. Each round doubles the part walked."""
    walked = work.save(leaves.select(F.col("id").alias("leaf"), "root", "rank", "id"), "paths-0")
    for number, hop in enumerate(hops):
        further = walked.join(hop, "id").select("leaf", "root", "rank", F.col("up").alias("id"))
        walked = work.save(walked.unionByName(further), f"paths-{number + 1}")
    return walked.join(settled.select("id", "depth"), "id")


def format_trees(messages: DataFrame, best: int | None = 1, trained: str = TRAINED, work: Workspace | None = None) -> DataFrame:
    """One row per chosen branch: root, leaf, rank, score, turns, formatted, mask.

    ``messages`` has ``id``, ``parent``, ``role``, ``text`` and ``score``.
    ``mask`` holds the start and end (code points) of each trained text in ``formatted``.
    """
    work = work or Workspace(messages.sparkSession, "chat")
    slim = messages.select(
        "id",
        "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "score",
    ).filter("id IS NOT NULL")
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    stored = work.save(slim.groupBy("id").agg(first).select("id", "m.*"), "messages")
    settled, hops = branches(stored.select("id", "parent", "score"), work)
    leaves = choose_leaves(stored.select("id", "parent"), settled, best)
    steps = paths(leaves, hops, settled, work).join(stored.select("id", "role", "text"), "id")
    turn = F.struct(
        "depth",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained).alias("trained"),
    )
    grouped = steps.groupBy("root", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail)))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)").alias("spans")),
        lambda state, t: F.struct(
            (state["at"] + F.length(t["head"]) + F.length(t["body"]) + len(tail)).alias("at"),
            F.when(
                t["trained"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(t["head"])).alias("start"),
                            (state["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return grouped.select(
        "root",
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(pieces, "").alias("formatted"),
        walk["spans"].alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>\n")), lambda p: p != "")
    def turn(part: Column) -> Column:
        cut = F.locate("\n", part)
        return F.struct(
            unescape_role(F.substring(part, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape(F.substring(part, cut + 1, F.length(part))).alias("text"),
        )
    return F.transform(parts, turn)


def read_masked(formatted: Column, mask: Column) -> Column:
    """The trained texts, in order, nothing between."""
    return F.array_join(
        F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees of one branch: each row answers the one before it.

    Rows are in order of turn, then role and text; repeated rows stay turns of
    their own. Rows without a conversation id are left out.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).filter("conv_id IS NOT NULL").withColumn("n", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.struct("conv_id", "n").alias("id"),
        F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n"))).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )
