r"""Conversations from reply trees.

Messages form trees by their parents.  Every message learns its root, its
depth and the score of its path by pointer doubling: a self-join in each
round lets it see twice as far up, so a tree of depth d takes log2(d) rounds.
The leaves of a tree are ranked by the score of their paths, and the chosen
paths are spelled out by the same pointers and formatted.

A turn is written ``<turn>ROLE\nTEXT</turn>\n``.  A control string inside a
text (``<turn`` or ``</turn``, with any number of backslashes behind its
``<``) gets one more backslash there, and reading takes one away, so every
text comes back as it was.  In a role ``%``, ``<`` and line breaks are written
``%25``, ``%3C`` and ``%0A``, so a control string in a role ends no turn.  The
loss mask is a list of spans, in characters of the formatted string, that hold
the texts of the assistant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.plans.staging import discard, stage

OPEN, CLOSE = "<turn>", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


#: What is escaped in a role; the sign that escapes comes first.
ROLE_ESCAPES = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))


def escape_role(role: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ROLE_ESCAPES, role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ROLE_ESCAPES), role)


def _resolved(rows: DataFrame) -> DataFrame:
    """``uid, tree, node, score, up``: each message's number, and that of its parent, if it is there."""
    rows = rows.select("uid", "tree", "node", "parent", "score")
    named = rows.where("node is not null").groupBy(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"))
    named = named.agg(F.min("uid").alias("up"))
    same = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("parent") == F.col("p_node"))
    up = F.when(F.col("up") != F.col("uid"), F.col("up"))
    return rows.join(named, same, "left").select("uid", "tree", "node", "score", up.alias("up"))


def _doubled(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth and score sum of every message that has a root, and the pointers of each round.

    Table k of the pointers has, for messages at least 2**k deep, the
    ancestor so far above them.
    """
    # seen: messages from this one up to, but not with, `up`
    open_ = nodes.select("uid", "up", F.lit(1).alias("seen"), F.col("score").alias("sum"), F.col("uid").alias("top"))
    open_ = stage(open_, "chat-pointers")
    done, levels, left = [], [], open_.where("up is not null").count()
    while left:
        levels.append(open_)
        # messages that have come to their root stay out, where the others find them
        far = reduce(DataFrame.unionAll, done, open_).select(
            F.col("uid").alias("up"), F.col("up").alias("up2"), F.col("seen").alias("seen2"), F.col("sum").alias("sum2"), F.col("top").alias("top2")
        )
        done.append(open_.where("up is null"))
        open_ = open_.where("up is not null").join(far, "up").select(
            "uid",
            F.col("up2").alias("up"),
            (F.col("seen") + F.col("seen2")).alias("seen"),
            (F.col("sum") + F.col("sum2")).alias("sum"),
            F.col("top2").alias("top"),
        )
        open_ = stage(open_, "chat-pointers")
        now = open_.where("up is not null").count()
        if now == left:  # messages whose parents go round in a circle
            break
        left = now
    return reduce(DataFrame.unionAll, done, open_.where("up is null")), levels


def choose_paths(rows: DataFrame, top: int = 1) -> DataFrame:
    """Messages of the best ``top`` root-to-leaf paths of each tree.

    ``rows`` has ``tree, node, parent, role, text, score``.  Gives ``tree,
    path, rank, step, role, text``; ``step`` counts from the root.  A path's
    score is the mean of its messages' (null: 0); of equal paths the longer
    comes first, then the one whose leaf comes first.
    """
    said = rows.withColumns({"score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)), "uid": F.monotonically_increasing_id()})
    said = stage(said.select("uid", "tree", "node", "parent", "role", "text", "score"), "chat-rows")
    nodes = stage(_resolved(said), "chat-nodes")
    reached, levels = _doubled(nodes)
    parents = nodes.select(F.col("up").alias("uid")).where("uid is not null").distinct()
    leaves = reached.join(parents, "uid", "left_anti")
    leaves = leaves.join(nodes.select("uid", "tree", "node"), "uid")
    best = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("seen")).desc(), F.col("seen").desc(), "node", "uid")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = leaves.select(F.col("uid").alias("path"), "uid", "rank", (F.col("seen") - 1).alias("step"))
    for k, level in enumerate(levels):
        up = paths.join(level.where("up is not null").select("uid", F.col("up")), "uid")
        up = up.select("path", F.col("up").alias("uid"), "rank", (F.col("step") - (1 << k)).alias("step"))
        longer = stage(paths.unionByName(up), "chat-paths")
        discard(paths)
        paths = longer
    if levels:
        discard(nodes, *levels)
    return paths.join(said.select("uid", "tree", "role", "text"), "uid").select("tree", "path", "rank", "step", "role", "text")


def format_paths(messages: DataFrame) -> DataFrame:
    """One row a path: ``tree, path, rank, formatted, loss_spans``.

    ``loss_spans`` are structs ``start, length, turn, at``: characters from 0,
    and the same place as the number of its turn and the characters from
    there, for readers that go turn by turn.  The place of each turn is a
    running sum, so the work is in proportion to the length of a conversation.  A conversation is one record and is put
    together in one task; nothing but its length bounds that task.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    parts = messages.withColumn("head", F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))).withColumn("body", text)
    parts = parts.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0)) + F.char_length("head")
    span = F.struct(
        start.alias("start"), F.char_length("body").cast("long").alias("length"),
        F.col("step").cast("long").alias("turn"), F.char_length("head").cast("long").alias("at"),
    )
    parts = parts.withColumn("span", F.when(F.col("role") == ASSISTANT, span))
    turns = F.sort_array(F.collect_list(F.struct("step", "turn", "span")))
    made = parts.groupBy("tree", "path", "rank").agg(turns.alias("turns"))
    return made.select(
        "tree", "path", "rank",
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_reply_trees(rows: DataFrame, top: int = 1) -> DataFrame:
    """``tree, path, rank, formatted, loss_spans`` of the best paths of every tree.

    Null texts and roles are empty; control strings in roles and texts come
    back as they were; a null tree is a tree like others; a
    parent that is null, missing or the message itself makes a root; of
    messages with one node id the first is the parent of replies to it, and
    every one is a message; a message without a node id has no replies;
    messages whose parents form a circle have no root and are on no path; an
    empty table gives no rows; other columns are ignored.
    """
    return format_paths(choose_paths(rows.select("tree", "node", "parent", "role", "text", "score"), top))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read from the formatted strings.

    Adds ``roles`` and ``texts`` (arrays, as they were before formatting) and
    ``loss_text``.  Every turn is read once, so the work is in proportion to
    the length of a conversation.
    """
    turns = F.filter(F.split("formatted", CLOSE), lambda t: F.startswith(t, F.lit(OPEN)))
    out = formatted.withColumn("__turns", turns)
    inside = lambda t: F.substr(t, F.lit(len(OPEN) + 1))
    roles = F.transform("__turns", lambda t: unescape_role(F.substring_index(inside(t), "\n", 1)))
    texts = F.transform("__turns", lambda t: unescape(F.substr(t, F.instr(t, F.lit("\n")) + 1)))
    turn = lambda s: F.get("__turns", s["turn"].cast("int"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(turn(s), (s["at"] + 1).cast("int"), s["length"].cast("int"))))
    return out.withColumns({"roles": roles, "texts": texts, "loss_text": F.array_join(loss, "")}).drop("__turns")


def chain(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as reply trees without branches.

    Each turn replies to the one before it in order of ``turn``, then of role
    and text where turns tie; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text", F.lit(0.0).alias("score")
    ).withColumn("parent", F.col("node") - 1)
