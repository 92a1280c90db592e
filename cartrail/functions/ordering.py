"""Ordered computation per key that survives very large keys.

A window partitioned by a key sorts all rows of that key in one task. That is
the right plan for ordinary sessions and the wrong one for a session or user
that holds a large part of the log. ``Ordered`` keeps the two apart:

* ordinary keys use one window over the key (one shuffle);
* hot keys are range-sorted over all tasks on (key, order), get their position
  within the key, and are then windowed in blocks of positions. A block carries
  the few rows before it that a frame reaches back to, so results are exact.

Which keys count as hot only selects the route; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cartrail.functions.durable import durable

POS = "_pos"
BLOCK = "_block"
PART = "_part"

# Sampled rows that a key at the threshold is expected to show.
SAMPLE_ROWS_AT_THRESHOLD = 1000
# Copies of one row that a single task may write out again.
COPIES_PER_TASK = 10_000


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> list:
    """Keys with about ``hot_rows`` rows or more, largest first.

    A planning statistic: row counts per key are estimated from a sample, as a
    range partitioner does for its bounds. There are at most as many such keys
    as ``hot_rows`` goes into the rows of the table.
    """
    fraction = min(1.0, SAMPLE_ROWS_AT_THRESHOLD / hot_rows)
    keys = df.select(key).dropna()
    sample = keys if fraction == 1.0 else keys.sample(fraction, seed=7)
    counts = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = (
        counts.filter(F.col("n") >= F.lit(hot_rows * fraction))
        .orderBy(F.col("n").desc(), key)
    )
    return [row[0] for row in top.collect()]


def with_copy_numbers(df: DataFrame) -> DataFrame:
    """Number equal rows from 1 in ``_copy``.

    Equal rows share one sort key and could not be split over tasks otherwise.
    They are counted (which combines before the shuffle) and written out again;
    a row with very many copies is first cut into runs that spread over tasks.
    The numbers depend only on the data, so a repeated task gives the same rows.
    """
    columns = df.columns
    counted = durable(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    last = F.least(F.lit(COPIES_PER_TASK), F.col("_n") - F.col("_run") * COPIES_PER_TASK)

    def written_out(runs: DataFrame) -> DataFrame:
        number = F.explode(F.sequence(F.lit(1).cast("bigint"), last))
        return runs.select(*columns, "_run", number.alias("_i")).select(
            *columns, (F.col("_run") * COPIES_PER_TASK + F.col("_i")).alias("_copy")
        )

    few = counted.filter(F.col("_n") <= COPIES_PER_TASK).withColumn("_run", F.lit(0).cast("bigint"))
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK))
    many = (
        counted.filter(F.col("_n") > COPIES_PER_TASK)
        .withColumn("_run", F.explode(runs))
        .repartition(*columns, "_run")
    )
    return written_out(few).unionByName(written_out(many))


def range_positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add the 1-based position of each row within its key by a range sort.

    The sort splits on the full tuple of key, order and all else, so one key may
    spread over every task. Positions come from the row's place in its sorted
    partition plus the key's rows in earlier partitions. The sorted rows are
    written once, because range bounds may differ between evaluations.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    sort = [key, *order, *rest, "_copy"]
    ordered = durable(
        with_copy_numbers(df)
        .orderBy(*sort)
        .withColumn("_mid", F.monotonically_increasing_id())
        .drop("_copy")
    )
    partition = F.shiftright("_mid", 33)
    # A sorted partition holds each key once, so this has no more rows than
    # keys plus partitions: safe to broadcast.
    runs = (
        ordered.groupBy(F.col(key), partition.alias("_pid"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
        .withColumn(
            "_carried",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(key)
                    .orderBy("_pid")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    return (
        ordered.withColumn("_pid", partition)
        .join(F.broadcast(runs), [key, "_pid"])
        .withColumn(POS, F.col("_carried") + F.col("_mid") - F.col("_first") + 1)
        .drop("_mid", "_pid", "_first", "_carried")
    )


@dataclass(frozen=True)
class Ordered:
    """Rows ordered within a key; ``hot`` holds the keys too large for one task."""

    key: str
    order: tuple[str, ...]
    block_rows: int
    cold: DataFrame
    hot: DataFrame | None = None
    gaps: bool = False

    @classmethod
    def of(
        cls, df: DataFrame, key: str, order: list[str], hot: list, block_rows: int
    ) -> "Ordered":
        if not hot:
            return cls(key, tuple(order), block_rows, df)
        is_hot = F.col(key).isin(hot)
        return cls(
            key,
            tuple(order),
            block_rows,
            df.filter(~F.coalesce(is_hot, F.lit(False))),
            range_positions(df.filter(is_hot), key, order),
        )

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(*self.order)

    def over(self, back: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> "Ordered":
        """Apply ``add``, which may look at the current and ``back`` earlier rows."""
        if self.gaps and self.hot is not None:
            return self._renumbered().over(back, add)
        cold = add(self.cold, self.window())
        if self.hot is None:
            return replace(self, cold=cold)
        rows = max(self.block_rows, back, 1)
        block = F.floor((F.col(POS) - 1) / rows)
        reaches_next = (F.col(POS) - 1) % rows >= rows - back
        lent = (
            self.hot.withColumn(BLOCK, block)
            .withColumn(
                PART,
                F.explode(
                    F.when(reaches_next, F.array(BLOCK, F.col(BLOCK) + 1)).otherwise(
                        F.array(BLOCK)
                    )
                ),
            )
        )
        hot = (
            add(lent, Window.partitionBy(self.key, PART).orderBy(POS))
            .filter(F.col(PART) == F.col(BLOCK))
            .drop(PART, BLOCK)
        )
        return replace(self, cold=cold, hot=hot)

    def filter(self, condition: Column) -> "Ordered":
        hot = None if self.hot is None else self.hot.filter(condition)
        return replace(self, cold=self.cold.filter(condition), hot=hot, gaps=True)

    def _renumbered(self) -> "Ordered":
        """Close the gaps that a filter left in the positions of hot keys."""
        hot = self.running_sum(F.lit(1).cast("bigint"), "_dense").hot
        return replace(self, hot=hot.drop(POS).withColumnRenamed("_dense", POS), gaps=False)

    def running_sum(self, value: Column, name: str) -> "Ordered":
        """Sum of ``value`` over the key's rows up to and including this one."""
        to_here = (Window.unboundedPreceding, Window.currentRow)
        cold = self.cold.withColumn(name, F.sum(value).over(self.window().rowsBetween(*to_here)))
        if self.hot is None:
            return replace(self, cold=cold)
        rows = self.hot.withColumn(BLOCK, F.floor((F.col(POS) - 1) / max(self.block_rows, 1)))
        before = (
            rows.groupBy(self.key, BLOCK)
            .agg(F.sum(value).alias("_total"))
            .select(
                self.key,
                BLOCK,
                F.coalesce(
                    F.sum("_total").over(
                        Window.partitionBy(self.key)
                        .orderBy(BLOCK)
                        .rowsBetween(Window.unboundedPreceding, -1)
                    ),
                    F.lit(0),
                ).alias("_carried"),
            )
        )
        within = Window.partitionBy(self.key, BLOCK).orderBy(POS).rowsBetween(*to_here)
        hot = (
            rows.withColumn(name, F.sum(value).over(within))
            .join(before, [self.key, BLOCK])
            .withColumn(name, F.col(name) + F.col("_carried"))
            .drop(BLOCK, "_carried")
        )
        return replace(self, cold=cold, hot=hot)

    def numbered(self, name: str) -> "Ordered":
        """1-based position among the key's remaining rows."""
        return self.running_sum(F.lit(1).cast("bigint"), name)

    def rows(self) -> DataFrame:
        if self.hot is None:
            return self.cold
        return self.cold.unionByName(self.hot.drop(POS))
