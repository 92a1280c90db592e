"""The activity graph and its bottlenecks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.durable import durable
from cartrail.functions.lookup import MAX_LOOKUP_ROWS, settled
from cartrail.operators.traces import transitions
from cartrail.spec import EventLog

# Seed of the source draw, ranking size.
PIVOT_SEED = 42
TOP_BOTTLENECKS = 10


def activity_graph(log: EventLog, collapse: bool = True) -> DataFrame:
    """Edges (src, dst, weight) with the place ``first`` where each was first seen."""
    return (
        transitions(log, collapse)
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("place").alias("first"))
    )


def oriented(edges: DataFrame) -> DataFrame:
    """Keep an edge only if it outweighs the edge the other way."""
    columns = ["weight", *[c for c in edges.columns if c != "weight"]]
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst"), F.greatest("src", "dst"))
        .agg(
            F.max(F.struct(*columns)).alias("top"),
            F.min("weight").alias("low"),
            F.count(F.lit(1)).alias("ways"),
        )
        .filter((F.col("ways") == 1) | (F.col("top.weight") > F.col("low")))
        .select(*[F.col(f"top.{c}").alias(c) for c in edges.columns])
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Activities that have an edge; an activity alone in its cases has none."""
    return edges.select(F.explode(F.array("src", "dst")).alias("activity")).distinct()


def betweenness(
    edges: DataFrame, max_pivots: int | None = None, seed: int = PIVOT_SEED
) -> DataFrame:
    """Betweenness of each activity: directed, unweighted, normalised.

    Breadth-first search from every source at once, one round per distance,
    then shares passed back one distance at a time. The tables hold at most
    sources x activities rows and are written every round. Exact, unless the
    caller asks for ``max_pivots``: then a seeded choice of so many sources
    stands for all, scaled up.
    """
    links = settled(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    nodes = settled(graph_nodes(edges))
    n = nodes.count()
    # A small graph's rounds are held as literal rows, a large one's written out.
    pivots = n if max_pivots is None else min(n, max_pivots)
    keep = settled if n * pivots <= MAX_LOOKUP_ROWS else durable
    sources = nodes
    if pivots < n:
        draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "activity"))
        sources = nodes.orderBy(draw, "activity").limit(pivots)

    frontier = sources.select(
        F.col("activity").alias("source"),
        F.col("activity").alias("node"),
        F.lit(1.0).alias("paths"),
    )
    levels = [keep(frontier)]
    seen = levels[0].select("source", "node")
    while True:
        reached = (
            levels[-1]
            .join(links, F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.sum("paths").alias("paths"))
        )
        level = keep(reached.join(seen, ["source", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))

    shares = []
    deeper = None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        if deeper is None:
            here = here.withColumn("share", F.lit(0.0))
        else:
            here = here.join(deeper, ["source", "node"], "left").withColumn(
                "share", F.coalesce("share", F.lit(0.0))
            )
        here = keep(here)
        shares.append(here.select("node", "share"))
        if depth > 1:
            above = levels[depth - 1].select(
                "source", F.col("node").alias("src"), F.col("paths").alias("_paths")
            )
            deeper = (
                here.join(links, F.col("node") == F.col("dst"))
                .join(above, ["source", "src"])
                .groupBy("source", F.col("src").alias("node"))
                .agg(F.sum(F.col("_paths") / F.col("paths") * (1 + F.col("share"))).alias("share"))
            )

    scale = 1.0
    if n > 2:
        scale = 1.0 / ((n - 1) * (n - 2)) * n / pivots
    total = shares[0] if shares else levels[0].select("node", F.lit(0.0).alias("share"))
    for part in shares[1:]:
        total = total.unionByName(part)
    sums = total.groupBy(F.col("node").alias("activity")).agg((F.sum("share") * scale).alias("s"))
    return nodes.join(sums, "activity", "left").select(
        "activity", F.coalesce("s", F.lit(0.0)).alias("betweenness")
    )


def first_seen(edges: DataFrame) -> DataFrame:
    """Where each activity first takes part in an edge: place, then source before target."""
    ends = F.array(
        F.struct(F.col("src").alias("activity"), F.lit(0).alias("side")),
        F.struct(F.col("dst").alias("activity"), F.lit(1).alias("side")),
    )
    return (
        edges.select("first", F.explode(ends).alias("end"))
        .groupBy(F.col("end.activity").alias("activity"))
        .agg(F.min(F.struct("first", F.col("end.side").alias("side"))).alias("seen"))
    )


def bottlenecks(edges: DataFrame, top: int = TOP_BOTTLENECKS) -> DataFrame:
    """Activities by betweenness; ties by first appearance in the graph."""
    edges = settled(edges)
    # Float sums differ in their last digits with the order of addition; ties
    # must not depend on that.
    scored = betweenness(edges).withColumn("betweenness", F.round("betweenness", 9))
    order = [F.col("betweenness").desc(), F.col("seen")]
    best = scored.join(first_seen(edges), "activity").orderBy(*order).limit(top)
    return best.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "activity",
        "betweenness",
    )
