"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees: each names its parent.  Unary stretches (a message whose
parent has no other reply) are first contracted to segments by pointer jumping,
so a conversation of a million turns takes twenty rounds and not a million.
Root-to-leaf paths are then enumerated by iterative self-joins over segments that
double the way looked at each round, so ten thousand branchings on a path take
fourteen rounds; branches are ranked by score, and each chosen path is written as
one conversation with a mask over the text that a model should learn.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` for each turn.  Inside
texts and roles a backslash becomes two, and the first character of any control
string becomes ``\\l`` (for ``<``) or ``\\k`` (for ``[``), so no control string
is left in them and the change can be undone exactly.  A role's line feeds become
``\\n``, so it stands on one line.

Defined results: a null text or role is empty; a message whose parent is missing
or is itself is a root; messages on a cycle hang from no root and give no
conversation; repeated keys (tree, node) count once, the smallest row; equal
scores rank by leaf id; messages without a tree or node key name no place in a
tree and are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.workspace import stage

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates (fixed values).
CONTROLS = r"<(?=/?s>|\|[A-Za-z_]+\|>|</?SYS>>)"
BRACKETS = r"\[(?=/?INST\]|/?AVAILABLE_TOOLS\]|TOOL_CALLS\]|/?TOOL_RESULTS\])"
#: Pointer jumping halves what is left each round; chains of 2^40 messages end within it.
MAX_ROUNDS = 40


def escape(text: Column, lines: bool = False) -> Column:
    """Remove control strings reversibly, and with ``lines`` line feeds as well."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    if lines:
        text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    text = F.regexp_replace(text, CONTROLS, r"\\l")
    return F.regexp_replace(text, BRACKETS, r"\\k")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    back = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), back), "\\")


def _segments(nodes: DataFrame) -> DataFrame:
    """Each message with the head of its unary stretch and its distance from it."""
    replies = nodes.where("parent is not null").groupBy("tree", "parent").agg(F.count("*").alias("replies"))
    parents = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = (
        nodes.join(parents, ["tree", "parent"], "left")
        .join(replies, ["tree", "parent"], "left")
        .select(
            "tree",
            "node",
            F.when(F.col("known"), F.col("parent")).alias("parent"),
            "score",
            F.when(F.col("known") & (F.col("replies") == 1), F.col("parent")).alias("up"),
        )
    )
    # head: the message reached so far; open: the stretch may go on above it
    state = stage(
        linked.select(
            "tree", "node", "parent", "score", F.coalesce("up", "node").alias("head"), F.col("up").isNotNull().cast("long").alias("dist"), F.col("up").isNotNull().alias("open")
        ),
        "chat-links",
    )
    closed, left = state.where("not open"), state.where("open")
    waiting = left.count()
    for _ in range(MAX_ROUNDS):
        if not waiting:
            break
        lookup = closed.unionByName(left).select("tree", F.col("node").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"))
        # only messages that have not reached the head of their stretch are joined again
        moved = stage(
            left.join(lookup, ["tree", "head"]).select(
                "tree", "node", "parent", "score", F.col("head2").alias("head"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("open2").alias("open")
            ),
            "chat-jump",
        )
        closed, left = closed.unionByName(moved.where("not open")), moved.where("open")
        before, waiting = waiting, left.count()
        if waiting == before:
            break  # only cycles are left
    else:
        if waiting:
            raise RuntimeError(f"stretches did not end in {MAX_ROUNDS} rounds")
    return closed


def leaf_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """The ``top_k`` best root-to-leaf paths of each tree's roots.

    Returns tree, root, leaf, path_score, rank and a row for each message on the
    path with its position.  ``nodes``: tree, node, parent, score.
    """
    rows = stage(_segments(nodes), "chat-segments")
    heads = rows.groupBy("tree", "head").agg(
        F.max_by("parent", F.when(F.col("dist") == 0, 1).otherwise(0)).alias("above"),
        F.max("dist").alias("last"),
        F.sum("score").alias("seg_score"),
        F.max_by("node", "dist").alias("tail"),
    )
    below = rows.select("tree", F.col("node").alias("above"), F.col("head").alias("seg_above"))
    segs = stage(heads.join(below, ["tree", "above"], "left"), "chat-heads")
    parents = segs.where("seg_above is not null").select("tree", F.col("seg_above").alias("head"), F.lit(True).alias("inner")).distinct()
    segs = stage(segs.join(parents, ["tree", "head"], "left"), "chat-tree")
    # each segment's way to its root by doubling: where it leads, how many segments it takes and their scores
    state = segs.select(
        "tree", "head", "tail", "inner", F.col("seg_above").alias("up"), F.when(F.col("above").isNull(), F.col("head")).alias("root"),
        F.when(F.col("above").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("seg_score").alias("score"),
    )
    ended, left = state.where("up is null"), state.where("up is not null")
    steps, waiting = [], left.count()
    for _ in range(MAX_ROUNDS):
        if not waiting:
            break
        steps.append(left.select("tree", "head", "up"))
        ahead = ended.unionByName(left).select("tree", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        moved = stage(
            left.join(ahead, ["tree", "up"]).select(
                "tree", "head", "tail", "inner", F.col("up2").alias("up"), F.col("root2").alias("root"),
                (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"),
            ),
            "chat-ways",
        )
        ended, left = ended.unionByName(moved.where("up is null")), moved.where("up is not null")
        before, waiting = waiting, left.count()
        if waiting == before:
            break  # only what hangs from cycles is left
    else:
        if waiting:
            raise RuntimeError(f"paths did not reach their roots in {MAX_ROUNDS} rounds")
    rows = rows.select("tree", "head", "node", "dist")
    done = ended.where("root is not null and inner is null")
    ranked = stage(
        done.withColumn("rank", F.row_number().over(W.partitionBy("tree", "root").orderBy(F.col("score").desc_nulls_last(), "tail"))).where(F.col("rank") <= top_k), "chat-ranked"
    )
    # the segments of chosen paths alone: each round adds those as far above again as its table leads
    own = ranked.select("tree", "root", F.col("tail").alias("leaf"), F.col("score").alias("path_score"), "rank", "head")
    for table in reversed(steps):
        own = stage(own.unionByName(own.join(table, ["tree", "head"]).drop("head").withColumnRenamed("up", "head")), "chat-paths")
    parts = own.join(ended.select("tree", "head", F.col("depth").alias("seg_no")), ["tree", "head"])
    return parts.join(rows, ["tree", "head"]).drop("head")


def format_chats(messages: DataFrame, top_k: int = 1, learn_role: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path.

    ``messages``: tree, node, parent, role, text, score.  Returns tree, root,
    leaf, rank, path_score, formatted, and loss_mask (start from 1 and length, in
    code points of ``formatted``, of each text of ``learn_role``).
    """
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    own = stage(
        own.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select(
            "tree", "node", F.when(F.col("m.parent") != F.col("node"), F.col("m.parent")).alias("parent"), "m.role", "m.text", "m.score"
        ),
        "chat-messages",
    )
    steps = leaf_paths(own.select("tree", "node", "parent", "score"), top_k)
    texts = own.select("tree", "node", "role", escape(F.col("text")).alias("body")).select(
        "tree",
        "node",
        F.concat(F.lit(START), escape(F.col("role"), lines=True), F.lit("\n")).alias("opening"),
        F.col("body"),
        (F.col("role") == learn_role).alias("learn"),
    )
    turns = (
        steps.join(texts, ["tree", "node"])
        .groupBy("tree", "root", "leaf", "rank", "path_score")
        .agg(F.array_sort(F.collect_list(F.struct("seg_no", "dist", "opening", "body", "learn"))).alias("turns"))
    )
    closing = F.lit(END + "\n")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def step(acc, t):
        body = F.length(t["body"]).cast("long")
        begin = acc["at"] + F.length(t["opening"])
        span = F.array(F.struct((begin + 1).alias("start"), body.alias("len")))
        return F.struct(
            (begin + body + F.length(closing)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return turns.select(
        "tree", "root", "leaf", "rank", "path_score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["opening"], t["body"], closing)), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda a: a["spans"]).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1)
            ).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["len"].cast("int")))), "")
