"""How the nodes of a process tree split, found on rows for all open nodes at once.

A node is known by its facts, rows (node, kind, a, b): ``point`` for each of its
activities, ``edge`` where a is directly followed by b, ``start``, ``end``, and
``once`` for an activity that every trace has exactly once (a = b in those).
Everything is joins and sums over these rows. No task needs all facts of a node,
and no table grows with the square of its activities unless its edges do.

* Components: the smallest label spreads over pairs and is looked up once more.
* Order: the smallest labels that reach an activity and that it reaches divide
  the activities again and again, until what is left together is strongly
  connected. Along an edge the first label can only fall and the second only
  rise, so the division also puts the parts in a topological order.
* Sequence: a cut between places of that order holds if every last part before it
  directly precedes every first part after it; both are counted as ranges.
* Parallel: components of the pairs that are *not* linked both ways. A label is
  out of reach of an activity only if all its holders are linked to it, so
  counting links by label finds the smallest label in reach without those pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.lookup import kept

STARTS, ENDS = 1, 2


def by_merge(df: DataFrame) -> DataFrame:
    """Small tables as one partition merge without an exchange, large ones by shuffle."""
    return df.hint("merge")


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def points(facts: DataFrame) -> DataFrame:
    return of_kind(facts, "point").select("node", F.col("a").alias("x"))


def edges(facts: DataFrame) -> DataFrame:
    return of_kind(facts, "edge").select("node", "a", "b")


def _seen_from(side: str, rows: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """``rows`` about x, to be joined with edges by their column ``side``."""
    return rows.select("node", F.col("x").alias(side), *[F.col(c).alias(prefix + c) for c in columns])


def _with_lower(wider: DataFrame, labels: DataFrame, name: str, pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``wider`` with what may lower ``name``: the least label next to x, and the label of its label."""
    found = (
        pairs.join(by_merge(_seen_from(source, labels, [name])), ["node", source])
        .groupBy("node", F.col(target).alias("x"))
        .agg(F.min(name).alias(f"_next_{name}"))
    )
    beyond = labels.select("node", F.col("x").alias(name), F.col(name).alias(f"_beyond_{name}"))
    return wider.join(by_merge(found), ["node", "x"], "left").join(by_merge(beyond), ["node", name], "left")


def _until_still(labels: DataFrame, ways: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Lower each label along its pairs, given as (pairs, source, target), until none changes.

    A step reads only the labels before it, so its plan stays flat.
    """
    names = list(ways)
    others = [c for c in labels.columns if c not in names]
    while True:
        wider = labels
        for name, (pairs, source, target) in ways.items():
            wider = _with_lower(wider, labels, name, pairs, source, target)
        lowest = [F.least(n, f"_next_{n}", f"_beyond_{n}") for n in names]
        moved = functools.reduce(lambda a, b: a | b, [low < F.col(n) for n, low in zip(names, lowest)])
        after = kept(wider.select(*others, *[low.alias(n) for n, low in zip(names, lowest)], moved.alias("_moved")))
        labels = after.drop("_moved")
        if after.filter("_moved").isEmpty():
            return labels


def components(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, x, label): the smallest member that each is connected to, in either direction."""
    both = pairs.filter(F.col("a") != F.col("b"))
    both = kept(both.unionByName(both.select("node", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = members.withColumn("label", F.col("x"))
    return _until_still(labels, {"label": (both, "a", "b")})


def ordered_parts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, x, c): strongly connected parts numbered from 0 in a topological order."""
    state = kept(members.withColumn("c", F.lit(0).cast("bigint")))
    inner = kept(pairs.filter(F.col("a") != F.col("b")))
    parts = state.select("node").distinct().count()
    while not inner.isEmpty():
        labels = state.withColumn("before", F.col("x")).withColumn("after", F.col("x"))
        labels = _until_still(labels, {"before": (inner, "a", "b"), "after": (inner, "b", "a")})
        place = Window.partitionBy("node").orderBy("c", F.col("before").desc(), "after")
        state = kept(labels.select("node", "x", (F.dense_rank().over(place) - 1).cast("bigint").alias("c")))
        now = state.select("node", "c").distinct().count()
        if now == parts:
            break
        parts = now
        inner = kept(
            inner.join(by_merge(_seen_from("a", state, ["c"], "a_")), ["node", "a"])
            .join(by_merge(_seen_from("b", state, ["c"], "b_")), ["node", "b"])
            .filter("a_c = b_c")
            .select("node", "a", "b")
        )
    return state


def _sequence_groups(parts: DataFrame, across: DataFrame) -> DataFrame:
    """(node, c, g): the groups of a sequence, in order; a node without such a cut has one.

    ``across`` holds the steps (node, u, v) from one part to another.
    """
    nexts = across.groupBy("node", F.col("u").alias("c")).agg(F.min("v").alias("next"))
    previous = across.groupBy("node", F.col("v").alias("c")).agg(F.max("u").alias("prev"))
    each = kept(
        parts.groupBy("node", "c").agg(F.lit(1).alias("one")).join(by_merge(nexts), ["node", "c"], "left")
        .join(by_merge(previous), ["node", "c"], "left")
        .select(
            "node",
            "c",
            F.coalesce("next", F.max("c").over(Window.partitionBy("node")) + 1).alias("next"),
            F.coalesce("prev", F.lit(-1)).alias("prev"),
        )
    )
    # A cut after place k: the parts that lead nowhere before it, those that nothing
    # after it leads to, and the steps between the two kinds, as ranges of k.
    met = (
        across.join(by_merge(each.select("node", F.col("c").alias("u"), "next")), ["node", "u"])
        .join(by_merge(each.select("node", F.col("c").alias("v"), "prev")), ["node", "v"])
        .filter("prev < next")
        .groupBy("node", "prev", "next")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def event(at: Column, last: Column, first: Column, met: Column) -> Column:
        values = zip(("c", "last", "first", "met"), (at, last, first, met))
        return F.struct(*[v.cast("bigint").alias(n) for n, v in values])

    zero, c, n = F.lit(0), F.col("c"), F.col("n")
    own = F.array(
        event(c, F.lit(1), F.lit(-1), zero), event(F.col("next"), F.lit(-1), zero, zero), event(F.greatest("prev", zero), zero, F.lit(1), zero)
    )
    steps = F.array(event(F.col("prev"), zero, zero, n), event(F.col("next"), zero, zero, -n))
    here = Window.partitionBy("node").orderBy("c")
    swept = (
        each.select("node", F.explode(own).alias("e"))
        .unionByName(met.select("node", F.explode(steps).alias("e")))
        .groupBy("node", "e.c")
        .agg(*[F.sum(f"e.{kind}").alias(kind) for kind in ("last", "first", "met")])
        .select("node", "c", *[F.sum(kind).over(here).alias(kind) for kind in ("last", "first", "met")])
    )
    cut = F.when((F.col("first") > 0) & (F.col("last") * F.col("first") == F.col("met")), 1).otherwise(0)
    g = F.coalesce(F.sum(cut).over(here.rowsBetween(Window.unboundedPreceding, -1)), zero).cast("bigint")
    return swept.select("node", "c", g.alias("g"))


def _covered(places: DataFrame, jumps: DataFrame, skip: int) -> DataFrame:
    """``places`` (node, g) with ``over``: how many jumps pass over g, at least ``skip`` places after they begin."""
    begin = F.struct((F.col("low") + skip).alias("g"), F.lit(1).alias("d"), F.lit(0).alias("is"))
    finish = F.struct(F.col("high").alias("g"), F.lit(-1).alias("d"), F.lit(0).alias("is"))
    events = jumps.filter(F.col("low") + skip < F.col("high")).select("node", F.explode(F.array(begin, finish)).alias("e")).select("node", "e.*")
    own = places.select("node", "g", F.lit(0).alias("d"), F.lit(1).alias("is"))
    here = Window.partitionBy("node").orderBy("g")
    summed = own.unionByName(events).groupBy("node", "g").agg(F.sum("d").alias("d"), F.max("is").alias("is"))
    return summed.withColumn("over", F.sum("d").over(here)).filter("is = 1").select("node", "g", "over")


FOUND = ["node", "op", "activity", "part", "optional"]


def _found(rows: DataFrame, op: str, part: Column, optional: Column | None = None) -> DataFrame:
    optional = F.lit(False) if optional is None else optional
    return rows.select(
        "node", F.lit(op).alias("op"), F.col("x").alias("activity"), part.cast("int").alias("part"), optional.alias("optional")
    )


def exclusive_cut(facts: DataFrame) -> DataFrame:
    groups = components(points(facts), edges(facts))
    apart = groups.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("node")
    some = groups.join(by_merge(apart), "node")
    return _found(some, "xor", F.dense_rank().over(Window.partitionBy("node").orderBy("label")) - 1)


def sequence_cut(facts: DataFrame) -> DataFrame:
    """Ordered groups, each reaching only later ones.

    Groups that some case jumps over in one go are optional together, so they
    become one group; if that leaves a single group, all stay apart.
    """
    parts = ordered_parts(points(facts), edges(facts))
    outside = of_kind(facts, "start").select("node", F.lit(None).cast("string").alias("a"), "b").unionByName(
        of_kind(facts, "end").select("node", "a", F.lit(None).cast("string").alias("b"))
    )
    # Steps between parts; a start comes from nowhere and an end goes there.
    steps = kept(
        edges(facts)
        .unionByName(outside)
        .join(by_merge(_seen_from("a", parts, ["c"], "a_")), ["node", "a"], "left")
        .join(by_merge(_seen_from("b", parts, ["c"], "b_")), ["node", "b"], "left")
        .select("node", F.col("a_c").alias("u"), F.col("b_c").alias("v"))
        .distinct()
    )
    groups = kept(_sequence_groups(parts, steps.filter("u <> v")).withColumn("k", F.max("g").over(Window.partitionBy("node")) + 1).filter("k > 1"))
    if groups.isEmpty():
        return _found(parts, "sequence", F.lit(0)).limit(0)
    jumps = kept(
        steps.join(by_merge(groups.select("node", F.col("c").alias("u"), F.col("g").alias("low"))), ["node", "u"], "left")
        .join(by_merge(groups.select("node", F.col("c").alias("v"), F.col("g").alias("high"))), ["node", "v"], "left")
        .join(by_merge(groups.select("node", "k").distinct()), "node")
        .select("node", F.coalesce("low", F.lit(-1)).alias("low"), F.coalesce("high", "k").alias("high"))
        .filter("high - low > 1")
        .distinct()
    )
    by_place = Window.partitionBy("node").orderBy("g")
    places = groups.select("node", "g").distinct()
    merged = _covered(places, jumps, 2).withColumn("m", F.sum(F.when(F.col("over") > 0, 0).otherwise(1)).over(by_place) - 1)
    merged = kept(
        merged.withColumn("most", F.max("m").over(Window.partitionBy("node"))).select(
            "node", "g", F.when(F.col("most") > 0, F.col("m")).otherwise(F.col("g")).alias("m")
        )
    )
    wide = (
        jumps.join(by_merge(merged.select("node", F.col("g").alias("low"), F.col("m").alias("_low"))), ["node", "low"], "left")
        .join(by_merge(merged.select("node", F.col("g").alias("high"), F.col("m").alias("_high"))), ["node", "high"], "left")
        .join(by_merge(merged.groupBy("node").agg((F.max("m") + 1).alias("k"))), "node")
        .select("node", F.coalesce("_low", F.lit(-1)).alias("low"), F.coalesce("_high", "k").alias("high"))
    )
    optional = _covered(merged.select("node", F.col("m").alias("g")).distinct(), wide, 1)
    placed = (
        parts.join(by_merge(groups), ["node", "c"])
        .join(by_merge(merged), ["node", "g"])
        .select("node", "x", F.col("m").alias("g"))
        .join(by_merge(optional), ["node", "g"])
    )
    return _found(placed, "sequence", F.col("g"), F.col("over") > 0)


def unlinked_groups(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, x, label): components of the pairs that are not in ``linked``, which is symmetric."""
    by_name = Window.partitionBy("node").orderBy("label")
    state = kept(members.withColumn("label", F.col("x")).withColumn("r", F.dense_rank().over(by_name) - 1))
    while True:
        sizes = state.groupBy("node", "r").agg(F.count(F.lit(1)).alias("size"))
        out_of_reach = (
            linked.join(by_merge(_seen_from("b", state, ["r"])), ["node", "b"])
            .groupBy("node", F.col("a").alias("x"), "r")
            .agg(F.count(F.lit(1)).alias("links"))
            .join(by_merge(sizes), ["node", "r"])
            .filter("links = size")
        )
        # The smallest label in reach is the first that is not out of reach.
        nth = F.row_number().over(Window.partitionBy("node", "x").orderBy("r")) - 1
        first = out_of_reach.withColumn("_nth", nth).groupBy("node", "x").agg(F.sum((F.col("_nth") == F.col("r")).cast("int")).alias("to"))
        reached = state.join(by_merge(first), ["node", "x"], "left").withColumn("to", F.coalesce("to", F.lit(0)))
        hooks = reached.groupBy("node", "r").agg(F.min("to").alias("to"))
        further = hooks.select("node", F.col("r").alias("to"), F.col("to").alias("beyond"))
        moved = hooks.join(by_merge(further), ["node", "to"]).select("node", "r", F.col("beyond").alias("to"))
        after = kept(state.join(by_merge(moved), ["node", "r"]))
        if after.filter("r <> to").isEmpty():
            return after.select("node", "x", "label")
        group = Window.partitionBy("node", "to")
        state = kept(
            after.select("node", "x", F.min("label").over(group).alias("label")).withColumn("r", F.dense_rank().over(by_name) - 1)
        )


def parallel_cut(facts: DataFrame) -> DataFrame:
    """Groups that follow each other both ways, each able to start and to end.

    Groups that cannot join the one that can whose smallest activity is the largest.
    """
    forth = edges(facts).filter(F.col("a") != F.col("b"))
    back = forth.select("node", F.col("b").alias("a"), F.col("a").alias("b"))
    groups = kept(unlinked_groups(points(facts), kept(forth.join(by_merge(back), ["node", "a", "b"], "left_semi"))))
    marks = None
    for kind in ("start", "end"):
        can = of_kind(facts, kind).select("node", F.col("a").alias("x"), F.lit(kind).alias("can"))
        marks = can if marks is None else marks.unionByName(can)
    whole = (
        groups.join(by_merge(marks), ["node", "x"]).groupBy("node", "label").agg(F.countDistinct("can").alias("n")).filter("n = 2").select("node", "label")
    )
    keeper = whole.groupBy("node").agg(F.max("label").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = (
        groups.join(by_merge(keeper), "node")
        .join(by_merge(whole.withColumn("own", F.lit(True))), ["node", "label"], "left")
        .select("node", "x", F.when(F.col("own"), F.col("label")).otherwise(F.col("keeper")).alias("group"))
        .withColumn("label", F.min("x").over(Window.partitionBy("node", "group")))
    )
    return _found(joined, "parallel", F.dense_rank().over(Window.partitionBy("node").orderBy("label")) - 1)


def loop_cut(facts: DataFrame) -> DataFrame:
    """The body first, then the parts that lead from its ends back to its starts."""
    outer = of_kind(facts, "start").unionByName(of_kind(facts, "end")).groupBy("node", F.col("a").alias("x")).agg(
        F.max(F.when(F.col("kind") == "start", 1).otherwise(0)).alias("start"),
        F.max(F.when(F.col("kind") == "end", 1).otherwise(0)).alias("end"),
    )
    outer = kept(outer)
    rest = kept(points(facts).join(by_merge(outer), ["node", "x"], "left_anti"))
    if rest.isEmpty():
        return _found(rest, "loop", F.lit(0))
    name = lambda side: rest.select("node", F.col("x").alias(side))
    parts = components(rest, edges(facts).join(by_merge(name("a")), ["node", "a"]).join(by_merge(name("b")), ["node", "b"]))
    totals = outer.groupBy("node").agg(F.sum("start").alias("starts"), F.sum("end").alias("ends"))
    comes = (
        edges(facts).join(by_merge(name("b")), ["node", "b"]).join(by_merge(outer.withColumnRenamed("x", "a")), ["node", "a"])
        .groupBy("node", F.col("b").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("good"))
    )
    goes = (
        edges(facts).join(by_merge(name("a")), ["node", "a"]).join(by_merge(outer.withColumnRenamed("x", "b")), ["node", "b"])
        .groupBy("node", F.col("a").alias("x")).agg(F.count(F.lit(1)).alias("m"), F.sum("start").alias("fine"))
    )
    fits = (F.col("n").isNull() | ((F.col("n") == F.col("good")) & (F.col("n") == F.col("ends")))) & (
        F.col("m").isNull() | ((F.col("m") == F.col("fine")) & (F.col("m") == F.col("starts")))
    )
    redo = (
        parts.join(by_merge(comes), ["node", "x"], "left").join(by_merge(goes), ["node", "x"], "left").join(by_merge(totals), "node")
        .groupBy("node", "label")
        .agg(F.min(fits).alias("fits"), F.count("n").alias("entered"), F.count("m").alias("left"))
        .filter("fits and entered > 0 and left > 0")
        .select("node", "label")
        .withColumn("part", F.row_number().over(Window.partitionBy("node").orderBy("label")))
    )
    there = redo.select("node").distinct()
    placed = points(facts).join(by_merge(there), "node").join(by_merge(parts), ["node", "x"], "left").join(by_merge(redo), ["node", "label"], "left")
    return _found(placed, "loop", F.coalesce("part", F.lit(0)))


CUTS = (exclusive_cut, sequence_cut, parallel_cut, loop_cut)
# The cuts after which the facts of each part follow from those of the whole.
EXACT = CUTS[:2]


def cut_nodes(facts: DataFrame, cuts=CUTS) -> tuple[list[DataFrame], DataFrame]:
    """The first cut of each node that has one, as FOUND rows; and the facts of the other nodes."""
    found = []
    for cut in cuts:
        if facts.isEmpty():
            break
        some = kept(cut(facts))
        if not some.isEmpty():
            found.append(some)
            facts = kept(facts.join(by_merge(some.select("node").distinct()), "node", "left_anti"))
    return found, facts


def _parts(facts: DataFrame, found: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts of the parts, of more than one activity, that an exact cut leaves; and their roots."""
    child = F.concat_ws(".", "node", F.col("part").cast("string"), F.when(F.col("optional"), F.lit("1")))
    sized = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("node", "part")))
    member = kept(sized.select("node", F.col("activity").alias("x"), child.alias("child"), (F.col("_n") > 1).alias("large")))
    both = (
        edges(facts)
        .join(by_merge(_seen_from("a", member, ["child", "large"], "a_")), ["node", "a"])
        .join(by_merge(_seen_from("b", member, ["child", "large"], "b_")), ["node", "b"])
    )
    inside = F.col("a_child") == F.col("b_child")

    def fact(child: Column, kind: str, a: Column, b: Column) -> Column:
        return F.struct(child.alias("node"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    a, b = F.col("a"), F.col("b")
    own = fact(F.col("a_child"), "edge", a, b)
    entry, leaving = fact(F.col("b_child"), "start", b, b), fact(F.col("a_child"), "end", a, a)
    crossing = F.when(inside, F.when(F.col("a_large"), F.array(own)).otherwise(F.array())).otherwise(
        F.concat(F.when(F.col("b_large"), F.array(entry)).otherwise(F.array()), F.when(F.col("a_large"), F.array(leaving)).otherwise(F.array()))
    )
    own_marks = facts.filter(F.col("kind").isin("point", "start", "end")).join(by_merge(_seen_from("a", member.filter("large"), ["child"])), ["node", "a"])
    below = both.select(F.explode(crossing).alias("f")).select("f.*").unionByName(own_marks.select(F.col("child").alias("node"), "kind", "a", "b"))
    under = member.filter("large").join(by_merge(roots), "node").select(F.col("child").alias("node"), "root").distinct()
    return kept(below.distinct()), kept(under)


def _fall_through(facts: DataFrame, without_each: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What becomes of nodes without a cut, as FOUND rows with an operator of their own."""
    found = []
    several = points(facts).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")

    def beside(chosen: DataFrame, rest: DataFrame) -> DataFrame:
        """One activity beside all others."""
        apart = points(rest).join(by_merge(chosen), "node")
        return _found(apart, "parallel", F.when(F.col("x") == F.col("first"), 0).otherwise(1))

    def settle(some: DataFrame) -> None:
        nonlocal facts
        some = kept(some)
        if not some.isEmpty():
            found.append(some)
            facts = kept(facts.join(by_merge(some.select("node").distinct()), "node", "left_anti"))

    once = of_kind(facts, "once").join(by_merge(several), "node").groupBy("node").agg(F.min("a").alias("first"))
    settle(beside(once, facts))
    open_nodes = kept(points(facts).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node"))
    if not open_nodes.isEmpty():
        # What is left without an activity may have a cut; then that activity runs beside the rest.
        cut, _ = cut_nodes(kept(without_each(open_nodes)))
        for some in cut[1:]:
            cut[0] = cut[0].unionByName(some)
        if cut:
            at = F.split("node", "~", 2)
            free = cut[0].select(at[0].alias("node"), at[1].alias("first")).groupBy("node").agg(F.min("first").alias("first"))
            settle(beside(free, facts))
    if facts.isEmpty():
        return found
    starts = of_kind(facts, "start").select("node", F.col("a").alias("x"), F.lit(STARTS).alias("s"))
    ends = of_kind(facts, "end").select("node", F.col("a").alias("x"), F.lit(ENDS).alias("e"))
    known = points(facts).join(by_merge(starts), ["node", "x"], "left").join(by_merge(ends), ["node", "x"], "left").fillna(0, ["s", "e"])
    again = (
        edges(facts)
        .join(by_merge(starts.withColumnRenamed("x", "b")), ["node", "b"])
        .join(by_merge(ends.withColumnRenamed("x", "a")), ["node", "a"], "left")
        .groupBy("node")
        .agg(F.when(F.max(F.col("e").isNotNull()), F.lit("strict_tau_loop")).otherwise(F.lit("tau_loop")).alias("how"))
    )
    nth = F.row_number().over(Window.partitionBy("node").orderBy("x")) - 1
    rows = known.withColumn("nth", nth).join(by_merge(again), "node", "left").withColumn("how", F.coalesce("how", F.lit("flower")))
    part = F.when(F.col("how") == "flower", F.col("nth")).otherwise(F.col("s") + F.col("e"))
    settle(_found(rows, "", part).drop("op").join(by_merge(rows.select("node", F.col("how").alias("op")).distinct()), "node").select(*FOUND))
    return found


def split_nodes(facts: DataFrame, without_each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decide the operator of every node and the part each activity goes to.

    Exclusive and sequence parts are split on at once, since their facts are
    known; other parts wait for a round. Rows (root, node, op, activity, part,
    leaf, optional, last): ``root`` is the given node, ``node`` it or one below,
    ``leaf`` marks an activity that is all there is to its part, ``optional``
    a part that some trace passes over, ``last`` the lowest row of an activity.
    ``without_each`` gives, for some nodes, the facts of a node called
    ``node~activity`` for each activity that is taken out of every trace.
    """
    facts = kept(facts)
    repeated = kept(edges(facts).filter("a = b").select(F.col("node").alias("root"), F.col("a").alias("activity"), F.lit(True).alias("again")))
    roots = kept(facts.select("node", F.col("node").alias("root")).distinct())
    alone = (
        facts.groupBy("node")
        .agg(F.sum((F.col("kind") == "point").cast("int")).alias("n"), F.sum((F.col("kind") == "edge").cast("int")).alias("e"))
        .filter("n = 1 and e = 0")
    )
    single = kept(_found(points(facts).join(by_merge(alone), "node"), "activity", F.lit(0)))
    facts = kept(facts.join(by_merge(single.select("node")), "node", "left_anti"))
    found, rest = cut_nodes(facts)
    decided = [single, *found] + ([] if rest.isEmpty() else _fall_through(rest, without_each))
    rows = _at_level(decided, roots, 0)
    for level in itertools.count(1):
        exact = [some for some in found if some.filter(F.col("op").isin("xor", "sequence")).count()]
        if not exact:
            break
        some = functools.reduce(DataFrame.unionByName, exact)
        facts, roots = _parts(facts, some, roots)
        found, _ = cut_nodes(facts, EXACT)
        if found:
            rows = rows.unionByName(_at_level(found, roots, level))
    by_part = F.count(F.lit(1)).over(Window.partitionBy("node", "part"))
    by_node = F.count(F.lit(1)).over(Window.partitionBy("node"))
    deepest = F.max("level").over(Window.partitionBy("root", "activity"))
    # In a parallel part an activity may come back later in the same trace.
    whole = F.col("op").isin("xor", "sequence", "loop") & (by_part == 1) & F.col("again").isNull()
    return rows.join(by_merge(repeated), ["root", "activity"], "left").select(
        "root",
        "node",
        "op",
        "activity",
        "part",
        (whole | ((F.col("op") == "strict_tau_loop") & (by_node == 1))).alias("leaf"),
        "optional",
        (F.col("level") == deepest).alias("last"),
    )


def _at_level(decided: list[DataFrame], roots: DataFrame, level: int) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, decided).join(by_merge(roots), "node").withColumn("level", F.lit(level))
