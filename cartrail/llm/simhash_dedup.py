"""Near copies by SimHash, compared bit plane by bit plane.

Equal fingerprints are one class from the start. Two classes within ``RADIUS``
bits agree on all but RADIUS of any division of the 64 bits into blocks, so a
table for each choice of the agreeing blocks brings them into one bucket. In a
bucket fingerprints are stored as bit planes, 64 fingerprints to a word; the
distances of one fingerprint to 64 others are counted at once with carry-save
counters, and words in which all have passed the radius are dropped early.

A large bucket is dealt into cells of pairs of parts, so that each pair of its
fingerprints still meets in one cell. Cells give one link a fingerprint, not
all pairs, and the links are joined to components over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.llm.common import keyed, lookup_by_key, numbered, small_batches, stored, text_key

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
PART_ROWS = 1024
BUCKET_ROWS = 8
TASK_WORDS = 1 << 16
_STEP = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a text; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    count = len(words) - SHINGLE_WORDS + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, _STEP):
        some = words[at : at + _STEP + SHINGLE_WORDS - 1]
        hashes = np.fromiter(
            (digest(join(s), SEED) for s in zip(some, some[1:], some[2:])), dtype=np.uint64
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of every document with its fingerprint ``fp`` as a signed long."""
    kept = docs.select(*columns, "text")
    schema = kept.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(values.view(np.int64))], names=[*columns, "fp"]
            )

    return kept.mapInArrow(run, schema)


def planes_of(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of grouped fingerprints; each group starts a new word.

    Returns the planes, one row per bit, and the first word of each group.
    """
    words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    slot = first[group] * 64 + np.arange(len(values)) - starts[group]
    spread = np.zeros((int(first[-1]) * 64, 64), dtype=np.uint8)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    spread[slot] = bits
    packed = np.packbits(spread.reshape(-1, 64, 64), axis=1, bitorder="little")
    planes = np.ascontiguousarray(packed.transpose(2, 0, 1)).view("<u8")[:, :, 0]
    return planes, first[:-1]


def close_pairs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (later, earlier) of all pairs within ``radius`` of each other in their group."""
    assert radius == 3, "two counter planes hold distances up to three"
    planes, first = planes_of(values, starts, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - starts[group]
    # A fingerprint is compared with the words up to its own.
    reach = place // 64 + 1
    task_value = np.repeat(np.arange(len(values)), reach)
    nth = np.arange(len(task_value)) - np.repeat(np.cumsum(reach) - reach, reach)
    later, earlier = [], []
    for at in range(0, len(task_value), TASK_WORDS):
        who, word = task_value[at : at + TASK_WORDS], nth[at : at + TASK_WORDS]
        column = first[group[who]] + word
        own = values[who]
        # Only earlier members of the group count.
        before = np.minimum(place[who] - word * 64, 64)
        valid = np.where(before >= 64, _ALL, (np.uint64(1) << np.minimum(before, 63).astype(np.uint64)) - np.uint64(1))
        ones = np.zeros(len(who), dtype=np.uint64)
        twos = np.zeros(len(who), dtype=np.uint64)
        over = ~valid
        for bit in range(64):
            flip = np.uint64(0) - ((own >> np.uint64(bit)) & np.uint64(1))
            differs = planes[bit][column] ^ flip
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
            if bit % 8 == 7:
                open_words = over != _ALL
                if not open_words.all():
                    who, column, word, own = who[open_words], column[open_words], word[open_words], own[open_words]
                    ones, twos, over = ones[open_words], twos[open_words], over[open_words]
                if not len(who):
                    break
        if len(who):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            row, bit_at = np.nonzero(hit)
            later.append(who[row])
            earlier.append(starts[group[who[row]]] + word[row] * 64 + bit_at)
    if not later:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(later), np.concatenate(earlier)


def group_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions is linked to, directly or not."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _masks(blocks: int) -> list[int]:
    """Bit masks of every choice of blocks that must agree."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - RADIUS)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def links(classes: DataFrame) -> DataFrame:
    """(``a``, ``b``): for each fingerprint near an earlier one of a cell, one it is connected to."""
    count = classes.count()
    # More blocks give longer keys and more tables; all choices find every pair.
    blocks = next((b for b in (4, 5) if count / 2 ** (64 * (b - RADIUS) / b) <= BUCKET_ROWS), 6)
    tables = [F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for n, m in enumerate(_masks(blocks))]
    placed = classes.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.t", "b.key")
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = (
        placed.join(sizes, ["t", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("t", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    cell = ["t", "key", "lo", "hi"]
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(keys: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch:
            new = np.zeros(len(fps), dtype=bool)
            new[:1] = True
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fps)))
            unsigned = fps.view(np.uint64)
            label = group_labels(len(fps), *close_pairs(unsigned, starts, sizes))
            moved = label != np.arange(len(fps))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], schema=out)

        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*cell, "fp"]]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            # The last cell may go on in the next batch.
            same_as_last = np.ones(len(rows[-1]), dtype=bool)
            for key in rows[:-1]:
                same_as_last &= key == key[-1]
            done = int(np.argmax(same_as_last)) if len(same_as_last) else 0
            if done:
                yield solved([k[:done] for k in rows[:-1]], rows[-1][:done])
            held = [r[done:] for r in rows]
        if held is not None and len(held[-1]):
            yield solved(held[:-1], held[-1])

    return cells.repartition(*cell).sortWithinPartitions(*cell, "fp").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``): the smallest node that each node of an edge is connected to.

    Labels spread to neighbours and are then looked up once more, until none changes.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        further = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        after = stored(
            spread.join(further, "via").select("node", "was", F.least("via", "beyond").alias("label"))
        )
        changed = after.filter(F.col("was") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """Every document with ``doc_id``, ``_th``, ``fp``, ``label`` and ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    RADIUS bits, null if all those ids are null; ``label`` is one fingerprint
    that names the component. Texts without words have
    fingerprint zero and are linked like others. Repeated rows stay.
    """
    found = stored(fingerprints(keyed(docs), ["doc_id", "_th"]))
    classes = stored(
        found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    )
    labels = components(links(classes)).withColumnRenamed("node", "fp")
    grouped = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    answer = stored(grouped.join(smallest, "label").select("fp", "n", "label", "component_id"))
    return lookup_by_key(found, answer, ["fp"], "n", found.count())


def near_copy_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint in hexadecimal, component_id."""
    return near_copies(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` reduced to one document of each component, that with the smallest id.

    Where ids repeat, the smaller text digest decides; equal rows leave one. A
    null id gives way to any other.
    """
    decided = near_copies(docs).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "label")
    rank = F.struct(F.col("_d").isNull().alias("none"), F.col("_d").alias("d"), F.col("_t").alias("t"))
    keep = (
        decided.groupBy("label")
        .agg(F.min(rank).alias("k"))
        .select(F.col("k.d").alias("_d"), F.col("k.t").alias("_t"))
    )
    return only(docs, keep)


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text digest are in ``keep`` as ``_d`` and ``_t``; equal rows leave one."""
    # Joined and deduplicated by the same columns, so texts are shuffled once.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~")).alias("_name")
    keep = keep.select(name("_d"), "_t")
    rows, doc, text = numbered(docs)
    rows = rows.select("*", name(doc), text_key(F.col(text)).alias("_t"))
    kept = rows.join(keep, ["_name", "_t"], "left_semi").dropDuplicates(["_name", "_t"])
    return kept.drop("_name", "_t").toDF(*docs.columns)
