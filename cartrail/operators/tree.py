"""Inductive process discovery: a process tree, and the BPMN flows it stands for.

All open nodes of the tree are split in the same round. A round takes the
relations between neighbouring events of every node from the event rows, lets
``functions.cuts`` choose each node's operator from those relations (and those of
all nodes below that follow from them), and moves the event rows to the children.
Rows stay rows throughout, one per event of a distinct trace, so neither the log
nor a trace has to fit one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.cuts import ENDS, STARTS, split_nodes
from cartrail.functions.durable import durable
from cartrail.functions.lookup import settled
from cartrail.functions.ordering import Ordered, hot_keys
from cartrail.operators.traces import variants
from cartrail.spec import EventLog

TREE = "node string, kind string, activity string"


def _distinct_traces(log: EventLog) -> DataFrame:
    """Event rows (node, trace, pos, activity) of one case per distinct trace."""
    s = log.spec
    shown = variants(log, collapse=False).select(F.col("first_case").alias(s.case))
    return (
        log.sequences()
        .numbered("pos")
        .rows()
        .join(shown, s.case, "left_semi")
        .select(
            F.lit("0").alias("node"),
            F.col(s.case).cast("string").alias("trace"),
            "pos",
            F.col(s.activity).alias("activity"),
        )
    )


def _facts(rows: DataFrame, ordered: Ordered) -> DataFrame:
    """Per node: points, edges, starts, ends, and activities every trace has exactly once."""
    before = ordered.over(1, lambda df, w: df.withColumn("prev", F.lag("activity").over(w)))
    neighbours = (
        before.rows()
        .select(
            "node",
            F.when(F.col("prev").isNull(), "start").otherwise("edge").alias("kind"),
            F.coalesce("prev", "activity").alias("a"),
            F.col("activity").alias("b"),
        )
        .distinct()
    )
    per_trace = rows.groupBy("node", "trace", "activity").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")
    )
    ends = per_trace.groupBy("node", "trace").agg(F.max_by("activity", "last").alias("a"))
    traces = ends.groupBy("node").agg(F.count(F.lit(1)).alias("traces"))
    once = (
        per_trace.groupBy("node", "activity")
        .agg(F.count(F.lit(1)).alias("seen"), F.max("n").alias("most"))
        .filter("most = 1")
        .join(traces, "node")
        .filter("seen = traces")
    )

    def single(df: DataFrame, kind: str, column: str) -> DataFrame:
        name = F.col(column)
        return df.select("node", F.lit(kind).alias("kind"), name.alias("a"), name.alias("b")).distinct()

    return (
        neighbours.unionByName(single(ends, "end", "a"))
        .unionByName(single(once, "once", "activity"))
        .unionByName(single(per_trace, "point", "activity"))
    )


def _runs(rows: DataFrame, ordered: Ordered) -> DataFrame:
    """(node, activity, before, after): what stands around the runs of each activity.

    ``before`` is null where a run begins its trace, ``after`` where it ends it.
    """
    same = F.col("activity") == F.col("prev")
    runs = (
        ordered.over(1, lambda df, w: df.withColumn("prev", F.lag("activity").over(w)))
        .filter(F.col("prev").isNull() | ~same)
        .over(1, lambda df, w: df.withColumn("prev2", F.lag("prev").over(w)))
    )
    between = runs.rows().filter("prev is not null").select(
        "node", F.col("prev").alias("run"), F.col("prev2").alias("before"), F.col("activity").alias("after")
    )
    last = runs.rows().groupBy("node", "trace").agg(F.max_by(F.struct("activity", "prev"), "pos").alias("l"))
    closing = last.select(
        "node", F.col("l.activity").alias("run"), F.col("l.prev").alias("before"), F.lit(None).cast("string").alias("after")
    )
    return between.unionByName(closing).distinct()


def _without_each(facts: DataFrame, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The facts of the given nodes without each of their activities in turn.

    Taking an activity out joins what stands before and after its runs and
    changes nothing else, so the new facts are the old ones that do not name it,
    with those joints. The node without activity a is called ``node~a``.
    """
    facts, runs = facts.join(nodes, "node"), runs.join(nodes, "node")
    out = facts.filter("kind = 'point'").select("node", F.col("a").alias("run"))
    kept = facts.filter("kind <> 'once'").join(out, "node").filter("a <> run and b <> run")
    before, after = F.col("before"), F.col("after")
    joints = runs.filter("before is not null or after is not null").select(
        "node",
        "run",
        F.when(before.isNull(), "start").when(after.isNull(), "end").otherwise("edge").alias("kind"),
        F.coalesce(before, after).alias("a"),
        F.coalesce(after, before).alias("b"),
    )
    return (
        kept.select("node", "run", "kind", "a", "b")
        .unionByName(joints)
        .select(F.concat_ws("~", "node", "run").alias("node"), "kind", "a", "b")
        .distinct()
    )


def _tree_row(node: Column, kind: Column, activity: Column | None = None) -> Column:
    activity = F.lit(None).cast("string") if activity is None else activity
    return F.struct(node.alias("node"), kind.alias("kind"), activity.alias("activity"))


def _round_nodes(decided: DataFrame, marked: DataFrame, optional: DataFrame) -> DataFrame:
    """The tree rows of one round; an operator appears once per activity of its node."""
    op, activity = F.col("op"), F.col("activity")
    silent, flower = op.isin("strict_tau_loop", "tau_loop"), op == "flower"

    def below(name: str, step) -> Column:
        return F.concat_ws(".", F.col(name), F.lit(step) if isinstance(step, str) else step)

    own = _tree_row(F.col("node"), F.when(silent | flower, F.lit("loop")).otherwise(op))
    leaf_at = F.when(F.col("optional"), below("child", "1")).otherwise(F.col("child"))
    leaf = _tree_row(leaf_at, F.lit("activity"), activity)
    rows = F.when(
        op == "activity", F.array(_tree_row(F.col("node"), F.lit("activity"), activity))
    ).when(
        # A flower is a silent body that any activity may repeat.
        flower,
        F.array(
            own,
            _tree_row(below("node", "0"), F.lit("tau")),
            _tree_row(below("node", F.col("part") + 1), F.lit("activity"), activity),
        ),
    ).otherwise(
        F.concat(
            F.array(own),
            F.when(silent, F.array(_tree_row(below("node", "1"), F.lit("tau")))).otherwise(F.array()),
            F.when(F.col("leaf"), F.array(leaf)).otherwise(F.array()),
        )
    )
    nodes = decided.join(marked, "child", "left").select(F.explode(rows).alias("r")).select("r.*")
    skips = optional.select(
        F.explode(
            F.array(
                _tree_row(F.col("child"), F.lit("xor")),
                _tree_row(below("child", "0"), F.lit("tau")),
            )
        ).alias("r")
    ).select("r.*")
    return nodes.unionByName(skips)


def _grow(rows: DataFrame, hot_rows: int, has_hot: bool) -> DataFrame:
    """All tree nodes before nested operators are joined: (node, kind, activity)."""
    rows = durable(rows)
    tree = rows.sparkSession.createDataFrame([], TREE)
    op, part = F.col("op"), F.col("part")
    silent = op.isin("strict_tau_loop", "tau_loop")
    ends_here = op.isin("activity", "flower")
    child = F.concat_ws(".", "node", F.when(silent, 0).otherwise(part))
    is_open = not rows.isEmpty()

    while is_open:
        hot = hot_keys(rows, "trace", hot_rows) if has_hot else []
        ordered = Ordered.of(rows, "trace", ["pos"], hot, hot_rows)
        facts = settled(_facts(rows, ordered))
        runs = _runs(rows, ordered)
        without = functools.partial(_without_each, facts, runs)
        decided = settled(split_nodes(facts, without)).withColumn("child", child)
        skipped = decided.filter("optional").select("child")
        decided = decided.drop("optional")
        splits = decided.filter("last").filter(~ends_here).drop("node").withColumnRenamed("root", "node")
        moved = _move(ordered, splits)
        # Projection leaves some traces without an event: the child is optional.
        parallel = F.col("op") == "parallel"
        if not splits.filter(parallel).isEmpty():
            traces = rows.select("node", "trace").distinct().groupBy("node").agg(
                F.count(F.lit(1)).alias("all")
            )
            kept = (
                moved.filter(parallel)
                .select("node", "child", "trace")
                .distinct()
                .groupBy("node", "child")
                .agg(F.count(F.lit(1)).alias("kept"))
            )
            skipped = skipped.unionByName(
                kept.join(traces, "node").filter(F.col("kept") < F.col("all")).select("child")
            )
        optional = settled(skipped.distinct())
        marked = optional.withColumn("optional", F.lit(True))
        place = F.when(F.col("optional"), F.concat_ws(".", "child", F.lit("1"))).otherwise(
            F.col("child")
        )
        tree = tree.unionByName(_round_nodes(decided, marked, optional))
        is_open = not splits.filter("NOT leaf").isEmpty()
        if is_open:
            rows = durable(
                moved.filter("NOT leaf")
                .join(marked, "child", "left")
                .select(
                    place.alias("node"),
                    F.md5(F.concat_ws("|", "child", "moved_trace")).alias("trace"),
                    "pos",
                    "activity",
                )
            )
    return settled(tree.distinct())


def _move(ordered: Ordered, splits: DataFrame) -> DataFrame:
    """Send each event to the child its activity belongs to.

    Loops also cut traces: at each change of part, or, for loops with a silent
    redo, where a new start follows (after an end, if the loop is strict).
    """
    def place(df: DataFrame) -> DataFrame:
        return df.join(splits, ["node", "activity"])

    placed = Ordered(
        ordered.key,
        ordered.order,
        ordered.block_rows,
        place(ordered.cold),
        None if ordered.hot is None else place(ordered.hot),
        # Rows of finished nodes are gone, but whole traces at a time.
        ordered.gaps,
    )
    op, part, before = F.col("op"), F.col("part"), F.col("_before")
    starts = part.bitwiseAND(STARTS) != 0
    ended = before.bitwiseAND(ENDS) != 0
    cut = (
        F.when(before.isNull(), False)
        .when(op == "loop", part != before)
        .when(op == "strict_tau_loop", starts & ended)
        .when(op == "tau_loop", starts)
        .otherwise(False)
    )
    loops = op.isin("loop", "strict_tau_loop", "tau_loop")
    return (
        placed.over(1, lambda df, w: df.withColumn("_before", F.lag("part").over(w)))
        .running_sum(F.when(cut, 1).otherwise(0).cast("bigint"), "_run")
        .rows()
        .select(
            "node",
            "trace",
            "child",
            "op",
            "leaf",
            F.when(loops, F.concat_ws("/", "trace", "_run"))
            .otherwise(F.col("trace"))
            .alias("moved_trace"),
            "pos",
            "activity",
        )
    )


def process_tree(log: EventLog) -> DataFrame:
    """The tree as rows (node, parent, position, kind, activity).

    ``kind`` is xor, sequence, parallel, loop, activity or tau. An operator
    directly under the same operator is joined with it, except loops. The
    first child of a loop is its body, the others are its redo parts.
    """
    return grown_trees(_distinct_traces(log), log.hot_rows, bool(log.hot(log.spec.case)))


def grown_trees(rows: DataFrame, hot_rows: int, has_hot: bool = False) -> DataFrame:
    """The trees of several logs at once, as rows like those of ``process_tree``.

    ``rows`` are the events (node, trace, pos, activity) of distinct traces; ``node`` is
    a number that names the log and then the root of its tree. Trace names are not shared.
    """
    grown = _grow(rows, hot_rows, has_hot)
    path = F.split("node", r"\.")
    parent = F.array_join(F.slice(path, 1, F.size(path) - 1), ".")
    nodes = grown.withColumn("parent", F.when(F.size(path) > 1, parent))
    kinds = nodes.select(F.col("node").alias("parent"), F.col("kind").alias("parent_kind"))
    nested = nodes.join(kinds, "parent", "left").withColumn(
        "joined",
        F.coalesce(
            (F.col("kind") == F.col("parent_kind")) & F.col("kind").isin("xor", "sequence", "parallel"),
            F.lit(False),
        ),
    )
    kept = nested.filter("NOT joined").select("node", "kind", "activity")
    # Every node looks up its ancestors by name and keeps the nearest one left.
    path = F.split("node", r"\.")
    ancestors = kept.withColumn(
        "ancestor",
        F.explode_outer(
            F.when(
                F.size(path) > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size(path) - 1),
                    lambda n: F.array_join(F.slice(path, 1, n), "."),
                ),
            )
        ),
    )
    names = kept.select(F.col("node").alias("ancestor"), F.lit(True).alias("here"))
    parents = (
        ancestors.join(names, "ancestor", "left")
        .groupBy("node", "kind", "activity")
        .agg(F.max_by("ancestor", F.when(F.col("here"), F.length("ancestor"))).alias("parent"))
    )
    steps = F.transform(F.split("node", r"\."), lambda x: x.cast("int"))
    by_place = Window.partitionBy("parent").orderBy(steps)
    return parents.select(
        "node",
        "parent",
        (F.row_number().over(by_place) - 1).cast("bigint").alias("position"),
        "kind",
        "activity",
    )


def bpmn_flows(log: EventLog) -> DataFrame:
    """Flows (source, target) between tasks, gateways and the two events.

    xor and parallel nodes become a split and a join gateway, a loop a join
    before its body and a split after it. A silent step is a plain flow.
    """
    return tree_flows(settled(process_tree(log)))


def tree_flows(tree: DataFrame) -> DataFrame:
    def gate(kind: Column, node: Column, side: str) -> Column:
        return F.concat(kind, F.lit(f"_{side}_"), node)

    kind, node = F.col("kind"), F.col("node")
    ends = tree.select(
        "node",
        "parent",
        "position",
        "kind",
        F.when(kind == "activity", F.concat(F.lit("task_"), "activity"))
        .when(kind == "loop", gate(kind, node, "join"))
        .when(kind.isin("xor", "parallel"), gate(kind, node, "split"))
        .alias("enter"),
        F.when(kind == "activity", F.concat(F.lit("task_"), "activity"))
        .when(kind == "loop", gate(kind, node, "split"))
        .when(kind.isin("xor", "parallel"), gate(kind, node, "join"))
        .alias("leave"),
    )
    # A sequence is entered at its first child and left at its last; a child of
    # a sequence is never a sequence itself.
    outer = ends.filter("kind = 'sequence'").select(F.col("node").alias("parent"))
    spans = (
        ends.join(outer, "parent")
        .groupBy(F.col("parent").alias("node"))
        .agg(F.min_by("enter", "position").alias("first"), F.max_by("leave", "position").alias("last"))
    )
    known = (
        ends.join(spans, "node", "left")
        .withColumn("enter", F.coalesce("enter", "first"))
        .withColumn("leave", F.coalesce("leave", "last"))
        .select("node", "parent", "position", "kind", "enter", "leave")
    )
    above = known.select(
        F.col("node").alias("parent"),
        F.col("kind").alias("p_kind"),
        F.col("enter").alias("p_enter"),
        F.col("leave").alias("p_leave"),
    )
    children = known.join(above, "parent")
    flow = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    outside_in, outside_out = F.col("p_enter"), F.col("p_leave")
    redo = (F.col("p_kind") == "loop") & (F.col("position") > 0)
    begin = F.when(redo, outside_out).otherwise(outside_in)
    finish = F.when(redo, outside_in).otherwise(outside_out)
    within = (
        children.filter("p_kind <> 'sequence'")
        .select(
            F.explode(
                F.when(F.col("kind") == "tau", F.array(flow(begin, finish))).otherwise(
                    F.array(flow(begin, F.col("enter")), flow(F.col("leave"), finish))
                )
            ).alias("f")
        )
        .select("f.*")
    )
    following = F.lead("enter").over(Window.partitionBy("parent").orderBy("position"))
    along = (
        children.filter("p_kind = 'sequence'")
        .select(F.col("leave").alias("source"), following.alias("target"))
        .filter("target IS NOT NULL")
    )
    root = known.filter("parent IS NULL")
    outer_flows = root.select(F.lit("start").alias("source"), F.col("enter").alias("target")).unionByName(
        root.select(F.col("leave").alias("source"), F.lit("end").alias("target"))
    )
    return within.unionByName(along).unionByName(outer_flows)
