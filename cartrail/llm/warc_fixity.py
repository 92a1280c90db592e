"""Merkle fixity audit of archive replicas.

Records are hashed where they lie. Ordered offset ranges of each file form the
leaves of a tree of fixed fan-out; roots are compared first and only the
children of differing nodes are looked at below, down to the ranges and then
the records that differ. No node gathers more than one range of records or
``FANOUT`` children, so a file of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.llm.common import stored

RANGE_BYTES = 1 << 16
FANOUT = 16
RECORDS_PER_FILE = 1024


def record_digest(uri: Column, payload: Column) -> Column:
    """SHA-256 over a record's address, length and payload; null counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat_ws("\n", F.coalesce(uri, F.lit("")), F.octet_length(body).cast("string"), F.lit(""))
    return F.sha2(F.concat(head, body), 256)


def number_of(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def lay_out(records: DataFrame, order: list[str], records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Place records into files: adds ``file``, ``offset`` and ``copies``.

    ``records`` has ``length`` and columns that ``order`` names and that tell
    records apart. A record's file follows from a hash of them, so files are
    even whatever ids occur; equal records are stored as one with ``copies``.
    """
    rows = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("copies"))
    files = max(1, -(-records.count() // records_per_file))
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in order]))
    bucket = number_of(name) % files
    upto = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("file", bucket).withColumn(
        "offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(upto), F.lit(0).cast("bigint"))
    )


def leaves(records: DataFrame) -> DataFrame:
    """One node per offset range: ``file``, ``node``, ``hash``."""
    entry = F.struct("offset", F.concat_ws(":", "offset", "length", "copies", "digest").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    return (
        records.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("node"))
        .agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: up to FANOUT children in order make one node."""
    children = F.transform(
        F.array_sort(F.collect_list(F.struct("node", "hash"))),
        lambda c: F.concat_ws(":", c["node"], c["hash"]),
    )
    return (
        nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up"))
        .agg(F.sha2(F.array_join(children, "\n"), 256).alias("hash"))
        .withColumnRenamed("up", "node")
    )


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or that one replica lacks."""
    joined = a.withColumnRenamed("hash", "hash_a").join(
        b.withColumnRenamed("hash", "hash_b"), ["file", "node"], "full_outer"
    )
    return joined.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node")


def _below(nodes: DataFrame, frontier: DataFrame) -> DataFrame:
    up = frontier.withColumnRenamed("node", "up")
    return (
        nodes.withColumn("up", F.floor(F.col("node") / FANOUT))
        .join(up, ["file", "up"], "left_semi")
        .drop("up")
    )


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two replicas and return one row per record that differs.

    Both have ``file``, ``offset``, ``length``, ``copies``, ``digest`` and equal
    further columns that describe the record; they should be stored. ``state``
    is ``changed``, ``missing`` (not in ``b``) or ``extra`` (not in ``a``).
    Empty replicas are equal; an empty one against a full one lacks all of it.
    Records at one offset, as those of no length, are told apart by the columns
    that describe them.
    """
    levels = [(stored(leaves(a)), stored(leaves(b)))]
    last = F.max("node").alias("n")
    top = max(level.agg(last).first()["n"] or 0 for level in levels[0])
    while top > 0:
        levels.append(tuple(stored(parents(nodes)) for nodes in levels[-1]))
        top //= FANOUT
    frontier = differing(*levels[-1])
    for left, right in reversed(levels[:-1]):
        frontier = differing(_below(left, frontier), _below(right, frontier))
    suspect = frontier.withColumnRenamed("node", "range")

    def within(records: DataFrame) -> DataFrame:
        ranged = records.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES))
        return ranged.join(suspect, ["file", "range"], "left_semi")

    names = [c for c in a.columns if c != "digest"]
    left = within(a).alias("a")
    right = within(b).select(*[F.col(c).alias(f"b_{c}") for c in [*names, "range", "digest"]])
    match = F.lit(True)
    for c in names:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b_{c}"))
    joined = left.join(right, match, "full_outer")
    here, there = F.col("a.file").isNotNull(), F.col("b_file").isNotNull()
    state = F.when(~there, "missing").when(~here, "extra").otherwise("changed")
    return joined.filter(~F.col("a.digest").eqNullSafe(F.col("b_digest"))).select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b_{c}")).alias(c) for c in [*names, "range"]],
        F.col("a.digest").alias("digest_a"),
        F.col("b_digest").alias("digest_b"),
        state.alias("state"),
    )


def damaged(html: Column, page_id: Column) -> Column:
    """A second copy of a payload with known damage, for an audit to find.

    By a hash of the id a few copies lose their last character and a few get
    one more in front.
    """
    h = number_of(F.md5(page_id.cast("string"))) % 97
    body = F.coalesce(html, F.lit(""))
    cut = F.expr("substring(html, 1, greatest(char_length(html) - 1, 0))")
    return (
        F.when(h == 1, F.coalesce(cut, F.lit("")))
        .when(h == 2, F.concat(F.lit("#"), body))
        .otherwise(body)
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    """The pages as an archive against a replica of it with known damage.

    Null urls and texts are empty in a record, a null id is a name like others;
    equal rows are one record with a number of copies. An empty table gives no rows, and other columns are not read.
    """
    lost = number_of(F.md5(F.col("page_id").cast("string"))) % 101 == 3
    url, html = F.col("url"), F.col("html")
    rows = pages.select(
        "page_id",
        "url",
        F.octet_length(F.coalesce(html, F.lit(""))).cast("bigint").alias("length"),
        record_digest(url, html).alias("digest"),
        record_digest(url, damaged(html, F.col("page_id"))).alias("_other"),
        F.coalesce(lost, F.lit(False)).alias("_lost"),
    )
    placed = stored(lay_out(rows, ["page_id", "url", "digest"]))
    a = placed.drop("_other", "_lost")
    b = placed.filter(~F.col("_lost")).withColumn("digest", F.col("_other")).drop("_other", "_lost")
    return audit(a, b)
