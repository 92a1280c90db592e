"""Traces, repeats, transitions, variants and next-step examples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.lookup import settled, small_lookup
from cartrail.functions.ordering import Ordered
from cartrail.spec import EventLog

# Fixed value: the text between two steps of a path.
ARROW = " -> "

# Steps that are joined to one stretch of text before the stretches of a path are.
TEXT_STEPS = 65_536

# A node of a path tree is named by sums of this many digests of 31 bits, which
# four billion steps cannot overflow.
NODE_SUMS = 3


def traces(log: EventLog) -> DataFrame:
    """Each case as rows (case_id, pos, activity) in time order.

    One row per step rather than one array per case, so that the size of a
    case never has to fit one row.
    """
    s = log.spec
    return log.sequences().numbered("pos").rows().select(
        F.col(s.case).alias("case_id"),
        "pos",
        F.col(s.activity).alias("activity"),
    )


def with_previous(log: EventLog) -> Ordered:
    """Every event with the activity before it in its case (null at the start)."""
    activity = log.spec.activity
    return log.sequences().over(
        1, lambda df, w: df.withColumn("prev", F.lag(activity).over(w))
    )


def collapsed(log: EventLog) -> Ordered:
    """Events whose predecessor in the case is a different activity."""
    activity = F.col(log.spec.activity)
    return with_previous(log).filter(F.col("prev").isNull() | (F.col("prev") != activity))


def collapsed_log(log: EventLog) -> DataFrame:
    s = log.spec
    return collapsed(log).numbered("pos").rows().select(
        F.col(s.case).alias("case_id"),
        "pos",
        F.col(s.activity).alias("activity"),
        F.col(s.time).alias("event_time"),
    )


def transitions(log: EventLog, collapse: bool = True) -> DataFrame:
    """Adjacent pairs of each case, with the place where they occur.

    Dropping repeats leaves exactly the adjacent pairs of unlike activities,
    so one look back serves both forms.
    """
    s = log.spec
    pairs = with_previous(log).rows().filter(F.col("prev").isNotNull())
    if collapse:
        pairs = pairs.filter(F.col("prev") != F.col(s.activity))
    return pairs.select(
        F.col("prev").alias("src"),
        F.col(s.activity).alias("dst"),
        F.struct(F.col(s.case), *[F.col(c) for c in s.order]).alias("place"),
    )


def directly_follows(log: EventLog, collapse: bool = True) -> DataFrame:
    """Directly-follows graph: (src, dst, weight)."""
    return (
        transitions(log, collapse)
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _case_ends(log: EventLog, pick) -> DataFrame:
    s = log.spec
    order = F.struct(*[F.col(c) for c in s.order])
    return (
        log.complete()
        .groupBy(s.case)
        .agg(pick(s.activity, order).alias("activity"))
        .groupBy("activity")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def start_activities(log: EventLog) -> DataFrame:
    return _case_ends(log, F.min_by)


def end_activities(log: EventLog) -> DataFrame:
    return _case_ends(log, F.max_by)


def activity_vocabulary(log: EventLog) -> DataFrame:
    """Activities in alphabetical order with 0-based ids.

    The id is the number of smaller activities. The window is over the
    distinct activities only.
    """
    names = log.df.select(F.col(log.spec.activity).alias("activity")).dropna().distinct()
    return names.withColumn(
        "id", (F.row_number().over(Window.orderBy("activity")) - 1).cast("bigint")
    )


def activity_share(log: EventLog, top: int = 10) -> DataFrame:
    """Most frequent activities with their share of all rows, nulls included in the total."""
    counts = log.df.groupBy(F.col(log.spec.activity).alias("activity")).agg(
        F.count(F.lit(1)).alias("events")
    )
    total = counts.agg(F.sum("events")).scalar()
    return (
        counts.filter(F.col("activity").isNotNull())
        .withColumn("share", F.col("events") / total)
        .orderBy(F.col("events").desc(), "activity")
        .limit(top)
    )


def _steps(seq: Ordered, log: EventLog) -> DataFrame:
    """The steps (case_id, pos, activity) of every case."""
    s = log.spec
    return (
        seq.numbered("_at")
        .rows()
        .select(F.col(s.case).alias("case_id"), F.col("_at").alias("pos"), F.col(s.activity).alias("activity"))
    )


def _sequences(log: EventLog, collapse: bool) -> Ordered:
    return collapsed(log) if collapse else log.sequences()


def case_variants(log: EventLog, collapse: bool = True) -> DataFrame:
    """The variant of each case: (case_id, variant_id, steps).

    A variant is named by its length and two XORs over 60 digest bits of each
    (position, step). These combine in any order, so a case of any length is
    reduced before the shuffle and is never held as an array or text.
    """
    digest = F.md5(F.concat_ws("|", "pos", "activity"))
    bits = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]
    return (
        _steps(_sequences(log, collapse), log)
        .select("case_id", bits[0].alias("_a"), bits[1].alias("_b"))
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("steps"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
        .select("case_id", F.concat_ws("-", "steps", F.hex("_a"), F.hex("_b")).alias("variant_id"), "steps")
    )


def variants(log: EventLog, collapse: bool = True) -> DataFrame:
    """Distinct paths (variant_id, steps, cases, first_case) with the number of cases that took them."""
    return (
        case_variants(log, collapse)
        .groupBy("variant_id", "steps")
        .agg(F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("first_case"))
    )


def _only_cases(log: EventLog, cases: DataFrame) -> EventLog:
    """The log of the given cases alone.

    Ordinary cases are looked up by the key they are then ordered by; hot ones,
    few by their size, by broadcast, so that their rows stay where they are.
    """
    case, hot = log.spec.case, log.hot(log.spec.case)
    if not hot:
        return replace(log, df=log.df.join(cases, case, "left_semi"))
    is_hot = F.col(case).isin(hot)
    cold = log.df.filter(~F.coalesce(is_hot, F.lit(False))).join(cases, case, "left_semi")
    large = log.df.filter(is_hot).join(F.broadcast(cases.filter(is_hot)), case, "left_semi")
    return replace(log, df=cold.unionByName(large))


def variant_steps(log: EventLog, found: DataFrame, collapse: bool = True) -> DataFrame:
    """The steps (variant_id, pos, activity) of the given variants of a log.

    They are read off the first case of each, and only those cases are ordered.
    """
    case = log.spec.case
    shown = found.select("variant_id", F.col("first_case").alias("_shown"))
    some = _only_cases(log, shown.select(F.col("_shown").alias(case)))

    def of(seq: Ordered, some: DataFrame) -> DataFrame:
        steps = _steps(seq, log)
        return steps.join(some, steps["case_id"] == some["_shown"]).select("variant_id", "pos", "activity")

    seq = _sequences(some, collapse)
    cold = of(replace(seq, hot=None), shown)
    if seq.hot is None:
        return cold
    hot_cases = seq.hot.select(F.col(case).alias("_shown")).distinct()
    some = F.broadcast(shown.join(F.broadcast(hot_cases), "_shown").select("variant_id", "_shown"))
    return cold.unionByName(of(replace(seq, cold=seq.cold.limit(0)), some))


def with_paths(log: EventLog, found: DataFrame, collapse: bool = True, text_steps: int = TEXT_STEPS) -> DataFrame:
    """The given variants with their steps as one text, ``path``.

    Stretches of ``text_steps`` steps are joined first, each in a task of its own,
    and then the stretches of a path, so that a long path is never held as an array of its steps.
    """
    stretch = F.floor((F.col("pos") - 1) / text_steps)
    joined = lambda rows: F.array_join(F.array_sort(rows)["text"], ARROW)
    texts = (
        variant_steps(log, found, collapse)
        .groupBy("variant_id", stretch.alias("at"))
        .agg(joined(F.collect_list(F.struct("pos", F.col("activity").alias("text")))).alias("text"))
        .groupBy("variant_id")
        .agg(joined(F.collect_list(F.struct("at", "text"))).alias("path"))
    )
    return found.join(texts, "variant_id", "left")


def path_tree(log: EventLog, collapse: bool = True) -> DataFrame:
    """All paths as one tree: (node, parent, pos, activity, cases, first_case).

    Each event of a case stands for the path up to it. Paths are named by their
    length and the sums, along the case, of digests of each (position, step);
    the parent's name is that less the last digest. So one running sum a case, in
    blocks where a case is large, names all nodes at once, whatever their depth,
    and equal paths meet in one group that combines before the shuffle. ``cases`` counts the
    cases that begin with the path; a root has no parent.
    """
    s = log.spec
    seq = _sequences(log, collapse).numbered("_at")
    digest = F.md5(F.concat_ws("|", "_at", s.activity))
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").bitwiseAND(0x7FFFFFFF) for k in range(NODE_SUMS)]
    for k, part in enumerate(parts):
        seq = seq.running_sum(part, f"_s{k}")

    def name(at: Column, sums: list[Column]) -> Column:
        return F.concat_ws("-", at, *[F.hex(x) for x in sums])

    here = [F.col(f"_s{k}") for k in range(NODE_SUMS)]
    above = [x - part for x, part in zip(here, parts)]
    return (
        seq.rows()
        .select(
            name(F.col("_at"), here).alias("node"),
            F.when(F.col("_at") > 1, name(F.col("_at") - 1, above)).alias("parent"),
            F.col("_at").alias("pos"),
            F.col(s.activity).alias("activity"),
            F.col(s.case).alias("_case"),
        )
        .groupBy("node", "parent", "pos", "activity")
        .agg(F.count(F.lit(1)).alias("cases"), F.min("_case").alias("first_case"))
    )


def top_paths(log: EventLog, top: int = 5) -> DataFrame:
    """Most frequent collapsed paths; ties by the smallest case id."""
    best = settled(variants(log).orderBy(F.col("cases").desc(), "first_case").limit(top))
    by_rank = Window.orderBy(F.col("cases").desc(), "first_case")
    return with_paths(log, best).select(
        F.row_number().over(by_rank).cast("bigint").alias("rank"), "path", "cases", "first_case"
    )


def next_activity_pairs(log: EventLog, max_len: int = 20, pad: bool = True) -> DataFrame:
    """Training pairs: the last ``max_len`` activities and the one that follows.

    ``x`` holds ids (1-based, 0 pads on the left), ``y`` the following id. The
    look-back is bounded, so a long case costs no more per row than a short one.
    """
    s = log.spec
    ids = small_lookup(activity_vocabulary(log)).select(
        F.col("activity").alias(s.activity), (F.col("id") + 1).alias("_id")
    )
    events = log.complete().select(*s.sequence_columns).join(ids, s.activity)
    seq = Ordered.of(events, s.case, s.order, hot=log.hot(s.case), block_rows=log.hot_rows)
    pairs = (
        seq.over(
            max_len,
            lambda df, w: df.withColumn("_x", F.collect_list("_id").over(w.rowsBetween(-max_len, -1))),
        )
        .rows()
        .filter(F.size("_x") > 0)
    )
    x = F.col("_x")
    if pad:
        x = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(max_len) - F.size("_x")), x)
    return pairs.select(
        F.col(s.case).alias("case_id"),
        x.alias("x"),
        F.col("_id").alias("y"),
    )
