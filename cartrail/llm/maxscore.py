"""Exact top-k inner products by MaxScore.

Dimensions are the terms. A shard keeps a posting list per term: the rows whose
component is not zero, with the component. For a query every term has a bound,
the most it can add to any score of the shard. Once ``k`` rows are scored, the
terms with the smallest bounds that cannot reach the k-th score together are
non-essential: a row in none of the other lists cannot enter. The essential
lists are traversed; the non-essential terms are probed in falling order of
their bounds for the rows that can still reach the k-th score.

Rows are dealt into shards of about ``SHARD_ROWS`` and queries into blocks of
about ``QUERY_ROWS``; each (shard, block) is one task-sized group and gives ``k``
rows a query, of which the best are kept at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 1024
SCALE = 256
# Products of 2^52 leave room for sums over a thousand dimensions.
LARGEST = 1 << 18
# Rows per leading term that are scored first, for a first k-th score.
HEAD_ROWS = 8
HEAD_TERMS = 6

FOUND = pa.schema(
    [("_query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


class Postings:
    """Term-major postings of one shard, rows in order of their id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.rows = vectors[order]
        self.terms = np.ascontiguousarray(self.rows.T)
        self.lists = [np.flatnonzero(column) for column in self.terms]
        self.values = [column[at] for column, at in zip(self.terms, self.lists)]
        full = len(ids)
        self.top = np.array([v.max() if len(v) else 0 for v in self.values], dtype=np.int64)
        self.low = np.array([v.min() if len(v) else 0 for v in self.values], dtype=np.int64)
        absent = np.array([len(v) < full for v in self.values], dtype=bool)
        self.top[absent] = np.maximum(self.top[absent], 0)
        self.low[absent] = np.minimum(self.low[absent], 0)
        head = min(HEAD_ROWS, full)
        self.highest = [np.argpartition(-c, head - 1)[:head] for c in self.terms]
        self.lowest = [np.argpartition(c, head - 1)[:head] for c in self.terms]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows whose id is not ``own``."""
        bounds = np.maximum(query * self.top, query * self.low)
        order = np.argsort(-bounds, kind="stable")
        heads = [self.highest[t] if query[t] > 0 else self.lowest[t] for t in order[:HEAD_TERMS]]
        first = np.unique(np.concatenate(heads)) if heads else np.arange(0)
        first = first[self.ids[first] != own]
        threshold = None
        if len(first) >= k:
            threshold = np.partition(self.rows[first] @ query, len(first) - k)[len(first) - k]
        # left[i]: the most that terms order[i:] can add together.
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        essential = len(order)
        if threshold is not None:
            while essential > 0 and left[essential - 1] < threshold:
                essential -= 1
        scores = np.zeros(len(self.ids), dtype=np.int64)
        met = np.zeros(len(self.ids), dtype=bool)
        for term in order[:essential]:
            at, factor = self.lists[term], query[term]
            if len(at) == len(scores):
                scores += factor * self.terms[term]
                met[:] = True
            else:
                scores[at] += factor * self.values[term]
                met[at] = True
        if threshold is None or left[essential] >= threshold:
            # Rows in none of the lists can enter too, with a score of zero.
            met[:] = True
        alive = np.flatnonzero(met & (self.ids != own))
        if threshold is not None:
            alive = alive[scores[alive] + left[essential] >= threshold]
        held = scores[alive]
        for step in range(essential, len(order)):
            term = order[step]
            held = held + query[term] * self.terms[term][alive]
            if threshold is not None:
                stays = held + left[step + 1] >= threshold
                if not stays.all():
                    alive, held = alive[stays], held[stays]
        best = np.lexsort((self.ids[alive], -held))[:k]
        return self.ids[alive[best]], held[best]


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def scaled(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector``, the components times SCALE rounded down.

    Rows without an id, without a vector, or with a null, NaN or infinite
    component are left out. A component beyond LARGEST in size is an error, as
    inner products of such vectors do not fit 64 bits.
    """
    unfit = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return embeddings.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(unfit, F.lit(False))
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(
            "embedding",
            lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x.cast("double") * SCALE).cast("bigint")).otherwise(
                F.raise_error(F.lit(f"a vector component is larger than {LARGEST}")).cast("bigint")
            ),
        ).alias("vector"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` (``vec_id``, ``vector``).

    A row with the query's id is its own and takes no part. Ties go to the
    smaller id. Rows may repeat and then count each; shorter vectors count as
    zero in the dimensions they lack. Empty tables give no rows.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumn(
        "shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    ).withColumn("block", each(blocks))
    asked = (
        queries.withColumn("_query", F.monotonically_increasing_id())
        .withColumn("block", F.pmod("_query", F.lit(blocks)).cast("int"))
        .withColumn("shard", each(shards))
    )

    def search(data: pa.Table, questions: pa.Table) -> pa.Table:
        if not data.num_rows or not questions.num_rows:
            return FOUND.empty_table()
        width = max(
            int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max())
            for t in (data, questions)
        )
        postings = Postings(data.column("vec_id").to_numpy(), _matrix(data, width))
        asked_for = _matrix(questions, width)
        out: list[list[np.ndarray]] = [[], [], [], []]
        numbers = questions.column("_query").to_numpy()
        for n, own, query in zip(numbers, questions.column("vec_id").to_numpy(), asked_for):
            ids, scores = postings.search(query, own, k)
            for column, values in zip(out, (np.full(len(ids), n), np.full(len(ids), own), ids, scores)):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], schema=FOUND)

    found = (
        rows.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(search, "_query long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("_query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
