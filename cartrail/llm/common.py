"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartrail.functions.durable import durable

# A key that holds more than this share of all rows is heavy; at most
# HEAVY_KEYS such keys can exist, which bounds a broadcast of them.
HEAVY_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A 64-bit digest of a text; null and empty differ."""
    return F.xxhash64(text.isNull(), text)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``_doc`` and ``_th``, which name a document by id and text.

    Rows equal in both are one document to every operator that removes something.
    """
    return docs.withColumn("_doc", F.col("doc_id")).withColumn("_th", text_key(F.col("text")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns named by number, and those of doc_id and text.

    Whatever the columns were called, they clash with no working column.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def lookup_by_key(rows: DataFrame, found: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``found``, unique by ``key``, safe for heavy keys.

    ``count`` in ``found`` says how many rows have the key. Keys above a
    thousandth of ``total`` rows, at most HEAVY_KEYS of them, are broadcast, so
    their rows stay where they are; all other rows are joined by shuffle. Both
    frames are read twice and should be stored.
    """
    limit = max(1, total // HEAVY_KEYS)
    heavy = found.filter(F.col(count) > limit).drop(count)
    light = found.filter(F.col(count) <= limit).drop(count)
    by_broadcast = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti")
    return by_broadcast.unionByName(rest.join(light, key))


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back from there."""
    return durable(df)


def stored_partitions(df: DataFrame, rows_per_cell: int) -> DataFrame:
    """``df`` stored, with a fixed ``_mid`` per row and ``_cell`` of at most ``rows_per_cell`` rows.

    Cells follow the stored partitions, so no key, however frequent, can make
    one large.
    """
    marked = stored(df.withColumn("_mid", F.monotonically_increasing_id()))
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("_mid", 33)
    return marked.withColumn(
        "_cell", F.concat_ws("-", part, F.floor(within / rows_per_cell).cast("string"))
    )


def in_groups(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Texts in groups of at most ``size`` bytes; a longer text is a group of its own."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
