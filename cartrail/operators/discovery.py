"""Alpha-miner relations, places and the Petri net they form."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.functions.lookup import settled
from cartrail.operators.traces import directly_follows, end_activities, start_activities
from cartrail.spec import EventLog

# Names of the relations of a footprint.
CAUSES, FOLLOWS, PARALLEL = "->", "<-", "||"


def footprint(log: EventLog) -> DataFrame:
    """Relation of each pair of activities that ever meet.

    (a, b, relation) with a causes b, a follows b, or both orders seen. Pairs
    that never meet are unrelated and have no row, so the table grows with the
    pairs seen and not with the square of the alphabet.
    """
    edges = directly_follows(log, collapse=False)
    forth = F.col("src") <= F.col("dst")
    pairs = edges.groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.max(forth).alias("forth"), F.max(F.col("src") >= F.col("dst")).alias("back"))

    def relation(forth: Column, back: Column) -> Column:
        return F.when(forth & back, PARALLEL).when(forth, CAUSES).otherwise(FOLLOWS)

    one = F.struct("a", "b", relation(F.col("forth"), F.col("back")).alias("relation"))
    other = F.struct(
        F.col("b").alias("a"),
        F.col("a").alias("b"),
        relation(F.col("back"), F.col("forth")).alias("relation"),
    )
    both = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))
    return pairs.select(F.explode(both).alias("pair")).select("pair.*")


def _vertices(relations: DataFrame) -> DataFrame:
    """Each activity as an input ``i..`` and as an output ``o..``: (v, related, linked).

    ``related`` are the vertices of the same side that it cannot stand beside,
    ``linked`` those of the other side that it can. Activities that follow themselves are left out.
    """
    loops = relations.filter(F.col("a") == F.col("b")).select(F.col("a").alias("x"))
    apart = relations.join(loops.withColumnRenamed("x", "a"), "a", "left_anti").join(
        loops.withColumnRenamed("x", "b"), "b", "left_anti"
    )

    def side(own: str, other: str, mine: str, theirs: str) -> DataFrame:
        forth = F.when(F.col("relation") == CAUSES, F.concat(F.lit(other), theirs))
        return apart.groupBy(F.concat(F.lit(own), mine).alias("v")).agg(
            F.collect_set(F.concat(F.lit(own), theirs)).alias("related"), F.collect_set(forth).alias("linked")
        )

    return side("i", "o", "a", "b").unionByName(side("o", "i", "b", "a"))


def _among(vertices: Column, near: Column, side: Column) -> Column:
    """Those of ``vertices`` that a vertex of the given side cannot be with; ``near`` has its lists."""
    beside = F.filter(vertices, lambda v: v.startswith(side))
    across = F.filter(vertices, lambda v: ~v.startswith(side))
    return F.concat(F.array_intersect(beside, near["related"]), F.array_except(across, near["linked"]))


def maximal_pairs(relations: DataFrame) -> DataFrame:
    """Maximal (inputs, outputs): every input causes every output, and neither
    the inputs nor the outputs have any relation among themselves.

    A search over states (taken, open, past): what is in the pair, what can still
    be added, and what could but was tried before. It starts at every causal pair
    (a, b) as the first input and output by name. A round closes each state over all that nothing
    open speaks against, drops it if something of the past fits all the rest,
    and branches on the open vertices that do not go with a chosen one. So every maximal pair
    is reached by one way, and parts of a pair are no states of their own.
    """
    vertices = settled(_vertices(relations))
    at = lambda name: vertices.select(F.col("v").alias(name), F.struct("related", "linked").alias(f"at_{name}"))
    pairs = (
        relations.filter(F.col("relation") == CAUSES)
        .select(F.concat(F.lit("i"), "a").alias("a"), F.concat(F.lit("o"), "b").alias("b"))
        .join(at("a"), "a")
        .join(at("b"), "b")
    )
    ins = F.array_except(F.col("at_b.linked"), F.array_union(F.col("at_a.related"), F.array("a")))
    outs = F.array_except(F.col("at_a.linked"), F.array_union(F.col("at_b.related"), F.array("b")))
    common = F.concat(ins, outs)
    first = lambda v: v < F.when(v.startswith("i"), F.col("a")).otherwise(F.col("b"))
    states = settled(
        pairs.select(
            F.array("a", "b").alias("taken"),
            F.filter(common, lambda v: ~first(v)).alias("open"),
            F.filter(common, first).alias("past"),
        )
    )
    found = []
    while not states.isEmpty():
        found.append(states.filter((F.size("open") == 0) & (F.size("past") == 0)).select("taken"))
        going = states.filter(F.size("open") > 0)
        tried = going.withColumn("v", F.explode(F.concat("open", "past"))).join(at("v"), "v")
        against = F.array_except(_among(F.col("open"), F.col("at_v"), F.substring("v", 1, 1)), F.array("v"))
        is_open = F.array_contains("open", F.col("v"))
        one = F.struct(F.size(against).alias("n"), F.col("v").alias("v"), against.alias("against"), is_open.alias("open"))
        closed = (
            tried.select("taken", "open", "past", one.alias("one"))
            .groupBy("taken", "open", "past")
            .agg(F.collect_list("one").alias("each"))
            # Something of the past that fits all that is open fits every pair from here.
            .filter(~F.exists("each", lambda e: (e["n"] == 0) & ~e["open"]))
            .withColumn("free", F.transform(F.filter("each", lambda e: e["n"] == 0), lambda e: e["v"]))
            .select(
                F.concat("taken", "free").alias("taken"),
                F.array_except("open", "free").alias("open"),
                F.transform(
                    F.filter("each", lambda e: ~e["open"] & ~F.arrays_overlap(e["against"], "free")), lambda e: e["v"]
                ).alias("past"),
                F.array_min(F.filter("each", lambda e: e["n"] > 0)).alias("pivot"),
            )
        )
        ways = F.array_sort(F.concat(F.col("pivot.against"), F.when(F.col("pivot.open"), F.array("pivot.v")).otherwise(F.array())))
        ends = closed.filter(F.size("open") == 0).select("taken", "open", "past")
        branches = (
            closed.filter(F.size("open") > 0)
            .withColumn("ways", ways)
            .select("*", F.posexplode("ways").alias("nth", "v"))
            .join(at("v"), "v")
        )
        earlier = F.slice("ways", F.lit(1), F.col("nth"))

        def beside(some: Column) -> Column:
            """What of ``some`` goes with the vertex that a branch takes."""
            return F.array_except(some, F.concat(_among(some, F.col("at_v"), F.substring("v", 1, 1)), F.array("v")))

        grown = branches.select(
            F.array_append("taken", F.col("v")).alias("taken"),
            beside(F.array_except("open", earlier)).alias("open"),
            beside(F.concat("past", earlier)).alias("past"),
        )
        states = settled(ends.unionByName(grown))
    names = lambda side: F.array_sort(F.transform(F.filter("taken", lambda v: v.startswith(side)), lambda v: F.substring(v, F.lit(2), F.length(v))))
    every = functools.reduce(DataFrame.unionByName, found) if found else states.select("taken")
    return every.select(names("i").alias("inputs"), names("o").alias("outputs"))


def _set_text(names: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(names, ","), F.lit("}"))


def alpha_places(log: EventLog) -> DataFrame:
    """Places of the alpha miner: (place, inputs, outputs) with comma-joined sets."""
    inner = maximal_pairs(settled(footprint(log))).select(
        F.concat(
            F.lit("("), _set_text(F.col("inputs")), F.lit(","), _set_text(F.col("outputs")), F.lit(")")
        ).alias("place"),
        F.array_join("inputs", ",").alias("inputs"),
        F.array_join("outputs", ",").alias("outputs"),
    )

    def names(df: DataFrame) -> Column:
        return F.array_join(F.array_sort(F.collect_set("activity")), ",")

    starts = start_activities(log)
    ends = end_activities(log)
    source = starts.agg(names(starts).alias("outputs")).select(
        F.lit("source").alias("place"), F.lit("").alias("inputs"), "outputs"
    )
    sink = ends.agg(names(ends).alias("inputs")).select(
        F.lit("sink").alias("place"), "inputs", F.lit("").alias("outputs")
    )
    return inner.unionByName(source).unionByName(sink)


def petri_arcs(log: EventLog) -> DataFrame:
    """The net as rows (kind, source, target): arcs and the two markings."""
    relations = settled(footprint(log))
    inner = maximal_pairs(relations).withColumn(
        "place",
        F.concat(
            F.lit("("), _set_text(F.col("inputs")), F.lit(","), _set_text(F.col("outputs")), F.lit(")")
        ),
    )
    to_place = inner.select(
        F.lit("activity_to_place").alias("kind"),
        F.explode("inputs").alias("source"),
        F.col("place").alias("target"),
    )
    from_place = inner.select(
        F.lit("place_to_activity").alias("kind"),
        F.col("place").alias("source"),
        F.explode("outputs").alias("target"),
    )
    starting = start_activities(log).select(
        F.lit("place_to_activity").alias("kind"),
        F.lit("source").alias("source"),
        F.col("activity").alias("target"),
    )
    ending = end_activities(log).select(
        F.lit("activity_to_place").alias("kind"),
        F.col("activity").alias("source"),
        F.lit("sink").alias("target"),
    )
    markings = log.df.sparkSession.createDataFrame(
        [("initial_marking", "source", "1"), ("final_marking", "sink", "1")],
        "kind string, source string, target string",
    )
    net = to_place
    for part in (from_place, starting, ending, markings):
        net = net.unionByName(part)
    return net
