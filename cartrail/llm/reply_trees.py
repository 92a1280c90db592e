"""Chat formatting of reply trees, in DataFrame functions only.

A message names its parent in the same tree. Self-joins of the table with
itself double the distance that each message looks up: after k rounds a message
knows its ancestor 2^k steps above, its distance from the root as far as seen,
and the score on the way. So a tree of any depth takes a logarithm of rounds.
The branches of a tree, one for each leaf, are ranked by their score, and the
same tables then list the messages of the chosen branches, again doubling.

In the output ``<|im_start|>`` and ``<|im_end|>`` stand around turns only. In
texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, a line end in
a role ``\\n``; that can be undone, and no text can end or begin a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.llm.common import lookup_by_key, stored

# The marks of a turn, and the role that is learned from.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

# The conversation that every table of conversations is given.
PROBE_ID, PROBE_TEXT = -1, "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    """``text`` with no ``<|`` in it; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def plain(text: Column) -> Column:
    """What ``escaped`` was given."""
    # Pairs of backslashes are found from the left, so none is split.
    parts = F.split(text, r"\\\\")
    return F.array_join(
        F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\"
    )


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def _named(messages: DataFrame) -> DataFrame:
    """Messages with ``_tree`` and ``_node``, keys that are never null, once for each key."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    row = F.struct("parent_id", "role", "text", "score")
    return (
        messages.groupBy(name("tree_id").alias("_tree"), name("message_id").alias("_node"))
        .agg(F.min("tree_id").alias("tree_id"), F.min("message_id").alias("message_id"), F.min(row).alias("_row"))
        .select("_tree", "_node", "tree_id", "message_id", "_row.*")
        .withColumn("_parent", F.concat(F.lit("="), F.col("parent_id").cast("string")))
    )


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The messages that have a root: (_tree, _node, depth, total); and the table of each round.

    Round k holds the messages (_tree, _node, up) with the ancestor ``up``
    that stands 2^k above. ``nodes`` are (_tree, _node, _parent, score). A parent that the tree does not
    hold makes a root. Messages above which a circle stands have no root.
    """
    known = nodes.select("_tree", F.col("_node").alias("_parent"), F.lit(True).alias("_here"))
    state = stored(
        nodes.join(known, ["_tree", "_parent"], "left").select(
            "_tree",
            "_node",
            F.when(F.col("_here"), F.col("_parent")).alias("up"),
            F.when(F.col("_here"), 1).otherwise(0).cast("bigint").alias("depth"),
            F.coalesce("score", F.lit(0.0)).cast("double").alias("total"),
        )
    )
    count = state.count()
    rounds: list[DataFrame] = []
    while True:
        open_rows = state.filter("up is not null")
        going = open_rows.count()
        if not going or 2 ** len(rounds) > count:
            break
        rounds.append(open_rows.select("_tree", "_node", "up"))
        wanted = open_rows.groupBy("_tree", "up").agg(F.count(F.lit(1)).alias("n"))
        above = stored(
            wanted.join(
                state.select("_tree", F.col("_node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total")),
                ["_tree", "up"],
            )
        )
        # A message may be the ancestor of a third of all rows.
        moved = lookup_by_key(open_rows, above, ["_tree", "up"], "n", going).select(
            "_tree",
            "_node",
            F.col("_up").alias("up"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("total") + F.col("_total")).alias("total"),
        )
        state = stored(state.filter("up is null").unionByName(moved))
    return state.filter("up is null").drop("up"), rounds


def _chosen(named: DataFrame, best: int) -> DataFrame:
    """The messages of the ``best`` branches of each tree: (_tree, _leaf, _node, rank, total, pos, turns).

    A branch's score is the sum over its messages, a null score counting 0;
    ties go to the smaller leaf id. ``pos`` counts from the root.
    """
    nodes = stored(named.select("_tree", "_node", "_parent", "score"))
    rooted, rounds = climbed(nodes)
    parents = nodes.select("_tree", F.col("_parent").alias("_node")).distinct()
    leaves = rooted.join(parents, ["_tree", "_node"], "left_anti")
    # Each task first keeps its own best of a tree.
    order = Window.partitionBy("_tree").orderBy(F.col("total").desc(), F.length("_node"), "_node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    paths = stored(
        chosen.select("_tree", F.col("_node").alias("_leaf"), "_node", "rank", "total", F.col("depth").alias("pos"), (F.col("depth") + 1).alias("turns"))
    )
    for k, jump in enumerate(rounds):
        # At most ``best`` branches of a tree meet in a message.
        further = paths.join(jump, ["_tree", "_node"]).select(
            "_tree", "_leaf", F.col("up").alias("_node"), "rank", "total", (F.col("pos") - 2**k).alias("pos"), "turns"
        )
        paths = stored(paths.unionByName(further))
    return paths


def formatted_branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row per chosen branch: tree_id, rank, total, leaf, n_turns, formatted, loss_spans.

    ``messages`` has tree_id, message_id, parent_id, role, text and score; other
    columns are not read. Rows with equal tree_id and message_id are one
    message, the smallest of them. Null ids are ids like others, but a null parent_id
    makes a root. ``formatted`` is the branch as one text; ``loss_spans``
    are its stretches to learn from, (start, length) in code points from 0, one
    for each assistant turn. One branch has to fit a row; nothing else does. An
    empty table gives no rows.
    """
    named = stored(_named(messages))
    paths = _chosen(named, best)
    head = _head(F.col("role"))
    body = escaped(F.col("text"))
    turns = (
        paths.join(named.drop("_parent", "parent_id", "score"), ["_tree", "_node"])
        .withColumn("head", head)
        .withColumn("body", body)
        .withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    )
    before = Window.partitionBy("_tree", "_leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    span = F.struct(
        (F.col("start") + F.char_length("head")).alias("start"), F.char_length("body").cast("bigint").alias("length")
    )
    rows = (
        turns.withColumn("start", start)
        .groupBy("_tree", "_leaf")
        .agg(
            F.min("tree_id").alias("tree_id"),
            F.min("rank").alias("rank"),
            F.min("total").alias("total"),
            F.max_by("message_id", "pos").alias("leaf"),
            F.array_sort(F.collect_list(F.struct("pos", "piece", F.when(F.col("role") == LEARNED, span).alias("span")))).alias("turns"),
        )
    )
    return rows.select(
        "tree_id",
        "rank",
        "total",
        "leaf",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.split(formatted, r"<\|im_start\|>")

    def turn(piece: Column) -> Column:
        inner = F.substring_index(piece, END, 1)
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.char_length(role) + 2, F.char_length(inner))
        return F.struct(plain(role).alias("role"), plain(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    # Four bytes a code point, so that every span is found at once.
    wide = F.array(F.encode(formatted, "UTF-32"))

    def cut(data: Column) -> Column:
        return F.transform(
            spans,
            lambda s: plain(
                F.decode(F.substring(data, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32")
            ),
        )

    return F.transform(wide, cut)[0]


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees in which each turn answers the one before.

    Turns go by ``turn``, null first, then by role and text; repeated rows are turns of
    their own, as they stand beside each other. Conversation PROBE_ID is added.
    """
    rows = conversations.select(F.col("conv_id").alias("tree_id"), "turn", "role", "text")
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(0, "user"), (1, LEARNED)], "turn long, role string").select(
        F.lit(PROBE_ID).cast(rows.schema["tree_id"].dataType).alias("tree_id"),
        F.col("turn").cast(rows.schema["turn"].dataType).alias("turn"),
        "role",
        F.lit(PROBE_TEXT).alias("text"),
    )
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    return (
        rows.unionByName(probe)
        .withColumn("message_id", F.row_number().over(order).cast("bigint"))
        .withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
        .withColumn("score", F.lit(0.0))
        .drop("turn")
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Each conversation formatted, and what is read back from that.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A
    null role is read as empty. An empty table leaves conversation PROBE_ID.
    """
    done = formatted_branches(chains(conversations))
    turns = F.array_join(
        F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "")
    return done.select(
        F.col("tree_id").alias("conv_id"),
        F.size(read_turns(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
