"""Tables that are usually tiny, held on the driver only after a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartrail.functions.durable import durable

MAX_LOOKUP_ROWS = 10_000


def _literal(df: DataFrame, max_rows: int) -> DataFrame | None:
    """The rows of ``df`` as a local table, or None if there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def settled(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """``df`` computed once: held as literal rows if few, else written out."""
    literal = _literal(df, max_rows)
    return durable(df) if literal is None else literal


def kept(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """As ``settled``, but literal rows come as one partition.

    Joins by merge, sums and windows over such tables need no exchange, so a
    plan of many steps over small tables runs as a single task.
    """
    literal = _literal(df, max_rows)
    return durable(df) if literal is None else literal.coalesce(1)


def small_lookup(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows.

    Such a table (an alphabet, a list of hours) is fetched once and then costs
    no shuffle. A larger one is returned as it is, to be joined by shuffle with
    skew handling left to adaptive execution.
    """
    literal = _literal(df, max_rows)
    return df if literal is None else F.broadcast(literal)
