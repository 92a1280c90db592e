"""Quality by a regularised quadratic discriminant over document statistics.

Statistics of the whole text (shares of byte classes, repetition, lengths),
transformed to be roughly bell shaped, are modelled by one Gaussian a class.
Each class covariance is shrunk towards the pooled one and towards a multiple
of the identity, so it stays regular with few rows. The score is the logistic
of the difference of log densities, from Mahalanobis distances by Cholesky
factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartrail.llm.common import in_groups, small_batches

TO_POOLED = 0.2
TO_IDENTITY = 0.05
THRESHOLD = 0.3
STRETCH = 1 << 20
HELD_OUT = (5, 0)

# A text counts as if it had this many bytes of usual prose besides its own, so
# that a few words do not look extreme.
PRIOR_BYTES = 60
PRIOR = (0.14, 0.003, 0.80, 0.02, 0.001, 0.02, 0.0, 0.0, 0.001, 0.001, 0.01, 0.0)

# Byte classes: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 sentence mark and
# comma, 6 bar, 7 exclamation mark, 8 quote and bracket, 9 other mark, 10 beyond ASCII, 11 control.
CLASSES = 12
NAMES = (
    "log_bytes", "space", "lines", "upper", "digit", "stops", "bar", "exclaim", "quote", "marks",
    "beyond", "control", "doubled", "word_bytes", "distinct_words", "same_again", "distinct_lines",
)


def _class_table() -> np.ndarray:
    table = np.full(256, 9, dtype=np.uint8)
    table[:32] = table[127] = 11
    table[128:] = 10
    for members, code in ((b" \t", 0), (b"\n\r", 1), (b".,;:?", 5), (b"|", 6), (b"!", 7), (b"\"'()[]{}", 8)):
        table[list(members)] = code
    table[97:123], table[65:91], table[48:58] = 2, 3, 4
    return table


def byte_counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each class and marks that follow themselves, as in "!!", of each text.

    Bytes are looked at in stretches of at most STRETCH, whole texts together
    where they fit, so that the arrays stay small.
    """
    table = _class_table()
    counts = np.zeros((len(raw), CLASSES), dtype=np.int64)
    doubled = np.zeros(len(raw), dtype=np.int64)

    def add(rows: np.ndarray, data: np.ndarray, first: int) -> None:
        """Count ``data``; its first ``first`` bytes have been counted before."""
        code = table[data]
        twice = (data[1:] == data[:-1]) & (code[1:] >= 5) & (code[1:] < 10) & (rows[1:] == rows[:-1])
        low, span = rows[0], rows[-1] - rows[0] + 1
        place = (rows[first:] - low) * CLASSES + code[first:]
        counts[low : low + span] += np.bincount(place, minlength=span * CLASSES).reshape(span, CLASSES)
        doubled[low : low + span] += np.bincount(rows[1:][twice] - low, minlength=span)

    at = 0
    for group in in_groups(raw, STRETCH):
        if len(group) == 1 and len(group[0]) > STRETCH:
            for start in range(0, len(group[0]), STRETCH):
                before = min(start, 1)
                data = np.frombuffer(group[0][start - before : start + STRETCH], dtype=np.uint8)
                add(np.full(len(data), at), data, before)
        elif any(group):
            rows = np.repeat(np.arange(at, at + len(group)), [len(r) for r in group])
            add(rows, np.frombuffer(b"".join(group), dtype=np.uint8), 0)
        at += len(group)
    return counts, doubled


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES per text; a null text counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    counts, doubled = byte_counts(raw)
    words = np.zeros((len(raw), 5))
    for k, text in enumerate(raw):
        tokens, lines = text.split(), text.split(b"\n")
        words[k] = len(tokens), len(set(tokens)), len(lines), len(set(lines)), sum(map(eq, tokens, tokens[1:]))
    total = size + PRIOR_BYTES
    share = (counts + PRIOR_BYTES * np.array(PRIOR)) / total[:, None]
    root = np.sqrt(share)
    n_words = np.maximum(words[:, 0], 1)
    columns = [
        np.log1p(size), root[:, 0], root[:, 1], root[:, 3], root[:, 4], root[:, 5], root[:, 6],
        root[:, 7], root[:, 8], root[:, 9], root[:, 10], root[:, 11],
        np.sqrt(doubled / total),
        np.log((size - counts[:, 0] - counts[:, 1] + PRIOR_BYTES) / (words[:, 0] + PRIOR_BYTES / 6)),
        # Longer texts repeat words; what is left is repetition beyond that.
        np.log(words[:, 1] + 10) - 0.8 * np.log(n_words + 10),
        np.sqrt(words[:, 4] / (words[:, 0] + 10)),
        np.log(words[:, 3] / np.maximum(words[:, 2], 1)),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: per class mean, inverse Cholesky factor and log weight."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = []
        for mean, whiten, weight in zip(self.means, self.whiten, self.weights):
            y = (z - mean) @ whiten.T
            logs.append(weight - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
    """A model from counts, sums and sums of products of the classes 0 and 1; None if one is empty."""
    if (counts < 1).any():
        return None
    total, p = counts.sum(), sums.shape[1]
    centre = sums.sum(axis=0) / total
    spread = np.diag(products.sum(axis=0)) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means = (sums / counts[:, None] - centre) / scale
    covariances = np.array(
        [
            (s / n - np.outer(m, m)) / np.outer(scale, scale)
            for s, n, m in zip(products, counts, sums / counts[:, None])
        ]
    )
    pooled = (covariances * counts[:, None, None]).sum(axis=0) / total
    whiten, weights = [], []
    for n, covariance in zip(counts, covariances):
        shrunk = (1 - TO_POOLED) * covariance + TO_POOLED * pooled
        shrunk = (1 - TO_IDENTITY) * shrunk + TO_IDENTITY * max(np.trace(shrunk) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        weights.append(np.log(n / total) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.array(whiten), np.array(weights))


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and ``x``, the statistics of ``text``."""
    kept = docs.select(*columns, "text")
    schema = kept.drop("text").schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = statistics(batch.column("text").to_pylist())
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(x))], names=[*columns, "x"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: tuple[int, int] = HELD_OUT) -> Column:
    """Whether a document belongs to the part that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts[0] == parts[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on all labelled documents that are not held out.

    Texts stay where they are: their statistics are joined with the labels, and
    the sums a class needs are added up by Spark. Labels other than 0 and 1,
    null ids and held-out rows are left out; repeated labels count each.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = with_statistics(docs.filter(~held_out(F.col("doc_id"))), ["doc_id"])
    x = F.concat(F.array(F.lit(1.0)), F.col("x"))
    pair = F.posexplode(
        F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    ).alias("k", "v")
    sums = (
        rows.join(known.select("doc_id", "quality"), "doc_id")
        .select("quality", pair)
        .groupBy("quality", "k")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    p = len(NAMES) + 1
    table = np.zeros((2, p * p))
    for quality, k, v in sums:
        table[quality, k] = v
    table = table.reshape(2, p, p)
    return fit(table[:, 0, 0], table[:, 0, 1:], table[:, 1:, 1:])


def scores(model: Discriminant | None, texts: list[str | None]) -> np.ndarray:
    """The score of each text; without a model all score one half."""
    return np.full(len(texts), 0.5) if model is None else model.score(statistics(texts))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every document.

    Null and empty texts have the statistics of no bytes and are scored so.
    Repeated rows are scored each; an empty table gives no rows.
    """
    model = train(docs, labels)
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = pa.array(scores(model, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those the model rejects.

    Null and empty texts have statistics too and are scored by them; equal rows
    stay or go together, and other columns pass as they are. Without labels of both kinds every
    score is 0.5, so all rows stay. An empty table stays empty.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = scores(model, batch.column("text").to_pylist())
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
