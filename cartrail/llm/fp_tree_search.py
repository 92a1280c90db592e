"""Ranked lexical search over tries of restricted document vectors.

A document is reduced to the terms that the items ask for, most frequent term
first. Documents sorted by these vectors form a trie: a node is a range of them
that agree up to some depth. Every node knows, over all documents below it, the
largest tf of each term and the smallest m, which bound the score any of them
can reach for an item. The search goes depth first, the most promising child
first, and an item leaves the way down where the bound is below its present
last place. All items go down together, each pruned on its own.

A task makes tries of a fixed number of documents at a time and carries the
places over from one to the next. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from cartrail.llm.common import small_batches, stored

TOP = 10
# Items of a block have at most this many bytes of terms, unless it is one item.
BLOCK_BYTES = 8 << 20
TRIE_DOCS = 8192
TRIE_ENTRIES = 2 << 20
LEAF_DOCS = 32
STRETCH = 1 << 20

# Every byte that is no digit, no letter and below 0x80 ends a term.
_TABLE = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
).lower()


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists, a stretch of about STRETCH bytes at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + STRETCH)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def item_terms(items: DataFrame) -> DataFrame:
    """(``item_id``, ``term``): the different terms of each item, as bytes.

    Rows with one item_id are one item; a null id is an id like others.
    """
    schema = StructType([items.schema["item_id"]]).add("term", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, terms = [], []
            for k, text in enumerate(batch.column("text")):
                found = {w for words in words_of(text.as_py()) for w in words}
                rows += [k] * len(found)
                terms += found
            ids = batch.column("item_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, schema).distinct()


def _blocks(terms: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks whose terms have at most ``block_bytes`` bytes, or one item."""
    sizes = stored(
        terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("size")).withColumn("h", F.xxhash64("item_id"))
    )
    total, count = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    blocks = max(1, -(-(total or 0) // block_bytes))
    while blocks > 1:
        largest = sizes.groupBy(F.pmod("h", F.lit(blocks)).alias("b")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("items")
        )
        if largest.filter((F.col("size") > block_bytes) & (F.col("items") > 1)).isEmpty():
            break
        blocks *= 2
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [terms.filter(block == b) for b in range(blocks)] if count else []


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and those of the vocabulary."""
    numbers = ArrayType(IntegerType())
    schema = StructType([docs.schema["doc_id"]]).add("n", "long").add("terms", numbers).add("tfs", numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                counts: Counter[bytes] = Counter()
                for words in words_of(text.as_py()):
                    counts.update(words)
                sizes.append(counts.total())
                for word in counts.keys() & vocabulary.keys():
                    terms.append(vocabulary[word])
                    tfs.append(counts[word])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Items:
    """The items of a block: their terms by rank of frequency, and the weights."""

    def __init__(self, item: np.ndarray, rank: np.ndarray, weight: np.ndarray, count: int, ranks: int):
        order = np.argsort(item, kind="stable")
        self.rank, self.weight = rank[order], weight[order]
        self.length = np.bincount(item, minlength=count)
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.count, self.ranks = count, ranks

    def entries(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms of some items, and where each item's begin among them."""
        length = self.length[some]
        starts = np.cumsum(length) - length
        return np.arange(int(length.sum())) + np.repeat(self.first[some] - starts, length), starts


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Places:
    """The best documents of each item so far: by score, then by id, rows without an id last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)
        ]
        # What a document must reach to take a place.
        self.least = np.ones(items, np.int64)

    def offer(self, item: int, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        s, u, d = (np.concatenate(p) for p in zip(self.held[item], (score, unnamed, doc)))
        best = np.lexsort((d, u, -s))[: self.top]
        self.held[item] = (s[best], u[best], d[best])
        if len(best) == self.top:
            self.least[item] = s[best[-1]]


class Trie:
    """Documents of one trie, sorted by their vectors."""

    def __init__(self, m: np.ndarray, ends: np.ndarray, rank: np.ndarray, tf: np.ndarray, doc: np.ndarray, unnamed: np.ndarray):
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank, owner))
        rank, tf = rank[order], tf[order]
        raw = rank.astype(">u4").tobytes()
        # Equal vectors stand by m, so that their parts differ in their bounds.
        names = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        by_vector = sorted(range(len(names)), key=lambda k: (names[k], m[k]))
        at = np.array(by_vector, dtype=np.int64)
        self.size = sizes[at]
        self.end = np.concatenate(([0], np.cumsum(self.size)))
        moved = np.arange(int(self.end[-1])) + np.repeat(ends[:-1][at] - self.end[:-1], self.size)
        self.rank, self.tf = rank[moved], tf[moved]
        self.m, self.doc, self.unnamed = m[at], doc[at], unnamed[at]

    def children(self, a: int, b: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """The parts of a node, and the depth to which each agrees."""
        while True:
            # A document that ends here sorts before those that go on.
            over = int(np.searchsorted(self.size[a:b] > depth, True)) + a if self.size[a] <= depth else a
            if over >= b:
                break
            terms = self.rank[self.end[over:b] + depth]
            cuts = (np.flatnonzero(terms[1:] != terms[:-1]) + over + 1).tolist()
            depth += 1
            if cuts or over > a:
                edges = ([a] if over > a else []) + [over, *cuts, b]
                return list(zip(edges, edges[1:])), depth
        # Equal vectors: parts of fixed size.
        return [(k, min(k + LEAF_DOCS, b)) for k in range(a, b, LEAF_DOCS)], depth

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms below a node with the impact that none of its documents exceeds."""
        rank, tf = self.rank[self.end[a] : self.end[b]], self.tf[self.end[a] : self.end[b]]
        order = np.argsort(rank, kind="stable")
        rank, tf = rank[order], tf[order]
        new = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(tf, new) if len(new) else tf
        return rank[new], impact(most, int(self.m[a:b].min()))


def search(trie: Trie, items: Items, places: Places) -> None:
    """Offer every document of a trie that can still take a place."""
    dense = np.zeros(items.ranks, np.int64)
    rows = np.zeros((LEAF_DOCS, items.ranks), np.int64)

    def reach(a: int, b: int, some: np.ndarray) -> np.ndarray:
        terms, most = trie.bounds(a, b)
        dense[terms] = most
        at, starts = items.entries(some)
        bound = np.add.reduceat(items.weight[at] * dense[items.rank[at]], starts)
        dense[terms] = 0
        return bound

    def leaf(a: int, b: int, some: np.ndarray) -> None:
        lo, hi = trie.end[a], trie.end[b]
        row = np.repeat(np.arange(b - a), trie.size[a:b])
        rank = trie.rank[lo:hi]
        rows[row, rank] = impact(trie.tf[lo:hi], trie.m[a:b][row])
        at, starts = items.entries(some)
        scores = np.add.reduceat(rows[: b - a, items.rank[at]] * items.weight[at], starts, axis=1)
        rows[row, rank] = 0
        hits = scores >= places.least[some]
        for k in np.flatnonzero(hits.any(axis=0)).tolist():
            hit = np.flatnonzero(hits[:, k])
            places.offer(int(some[k]), scores[hit, k], trie.unnamed[a:b][hit], trie.doc[a:b][hit])

    everyone = np.flatnonzero(items.length)
    if not len(everyone) or not len(trie.m):
        return
    stack = [(0, len(trie.m), 0, everyone, reach(0, len(trie.m), everyone))]
    while stack:
        a, b, depth, some, bound = stack.pop()
        # Places may have risen since this node was put aside.
        still = bound >= places.least[some]
        if not still.any():
            continue
        some = some[still]
        if b - a <= LEAF_DOCS:
            leaf(a, b, some)
            continue
        parts, depth = trie.children(a, b, depth)
        below = []
        for lo, hi in parts:
            bound = reach(lo, hi, some)
            keep = bound >= places.least[some]
            if keep.any():
                below.append((int(bound[keep].max()), lo, hi, some[keep], bound[keep]))
        # The most promising part lies on top.
        below.sort(key=lambda part: part[0])
        stack += [(lo, hi, depth, kept, bound) for _, lo, hi, kept, bound in below]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables for one trie each."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in small_batches(batches):
        held.append(batch)
        rows += batch.num_rows
        entries += len(batch.column("terms").flatten())
        if rows >= TRIE_DOCS or entries >= TRIE_ENTRIES:
            yield pa.Table.from_batches(held)
            held, rows, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _block_ranking(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task for the items of one block."""
    asked = terms.toArrow()
    ids = asked.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    item_of = ids.indices.to_numpy().astype(np.int64)
    words = asked.column("term").combine_chunks().dictionary_encode()
    vocabulary = {w: k for k, w in enumerate(words.dictionary.to_pylist())}

    found = stored(restricted(docs, vocabulary))
    total = found.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    number, length = int(total[0]), int(total[1] or 0)
    df = np.zeros(len(vocabulary), np.int64)
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[counts.column("term").to_numpy()] = counts.column("count").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rank_of = np.empty(len(df), np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    term_at = words.indices.to_numpy()
    items = Items(item_of, rank_of[term_at], weight[term_at], len(ids.dictionary), len(df))
    names = ids.dictionary

    schema = StructType([terms.schema["item_id"], found.schema["doc_id"]]).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(items.count, top)
        doc_type = pa.int64()
        for table in _tries(batches):
            table = table.combine_chunks()
            has = pc.greater(pc.list_value_length(table.column("terms")), 0)
            table = table.filter(has).combine_chunks()
            if not table.num_rows:
                continue
            n = table.column("n").to_numpy()
            doc_type = table.schema.field("doc_id").type
            doc = table.column("doc_id")
            lists = table.column("terms").chunk(0)
            sizes = pc.list_value_length(lists).to_numpy()
            trie = Trie(
                10 + (90 * n * number) // length,
                np.concatenate(([0], np.cumsum(sizes))),
                rank_of[lists.flatten().to_numpy()],
                table.column("tfs").chunk(0).flatten().to_numpy().astype(np.int64),
                pc.fill_null(doc, 0).to_numpy().astype(np.int64),
                pc.is_null(doc).to_numpy(),
            )
            search(trie, items, places)
        for k, (score, unnamed, doc) in enumerate(places.held):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array([k] * len(score))),
                        pa.array(doc, pa.int64(), mask=unnamed).cast(doc_type),
                        pa.array(score, pa.int64()),
                    ],
                    names=["item_id", "doc_id", "score"],
                )

    return found.mapInArrow(run, schema)


def ranking(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0.

    Equal scores go by doc_id, a null id last; repeated rows are documents of
    their own. Null and empty texts have no terms. Rows with one item_id are one
    item, a null id too. An empty table gives no rows. doc_id has to be an integer; other columns are not read.
    """
    best: DataFrame | None = None
    for block in _blocks(stored(item_terms(items)), block_bytes):
        some = _block_ranking(docs, block, top)
        best = some if best is None else best.unionByName(some)
    if best is None:
        best = docs.sparkSession.createDataFrame(
            [], StructType([items.schema["item_id"], docs.schema["doc_id"]]).add("score", "long")
        )
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )
