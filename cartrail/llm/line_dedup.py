"""Repeated passages, found by hashing sentences and runs of short ones.

Lines are cut into sentences, because a passage that was pasted into the middle
of a line leaves no whole line in common, and sentences of ``LONG_WORDS`` words
or more, which may hold a passage without end marks, into pieces: a cut comes
after each word whose digest says so, so equal passages are cut equally
wherever they stand. What has ``MIN_WORDS`` words is a unit. A shorter sentence or
piece is none, as it may coincide by chance, but the runs are that it begins and ends:
as few neighbours as have ``MIN_WORDS`` words together, over line ends too. A
repeated passage of short lines is covered by its repeated runs.

Units are normalised (lower case, single spaces), hashed to 128 bits and grouped
over the whole corpus. The occurrence with the smallest (doc_id, text digest,
offset) stays, all others are removed; offsets are code points of the original
text. Where an occurrence overlaps the one that stays, what lies behind that goes.
Words are what stands between white space; a text without any has no unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartrail.llm.common import HEAVY_KEYS, keyed, numbered, small_batches, stored, text_key

MIN_WORDS = 8
LONG_WORDS = 32
# A sentence with its end marks; the sentences of a line cover all of it.
SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
# A word with the space before it, the last one also with that behind it.
WORD = re.compile(r"\s*\S+(?:\s+\Z)?")

UNIT_SCHEMA = "_doc long, _th long, start int, n_chars int, d1 long, d2 long"
_ARROW = pa.schema(
    [("_doc", pa.int64()), ("_th", pa.int64()), ("start", pa.int32()), ("n_chars", pa.int32()),
     ("d1", pa.int64()), ("d2", pa.int64())]
)


@lru_cache(100_000)
def ends_piece(word: str) -> bool:
    """Whether a cut comes after ``word``: for one in eight."""
    return hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[0] < 32


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of sentences and of the pieces of long ones, if they hold a word."""
    at = 0
    for line in text.split("\n"):
        for sentence in SENTENCE.finditer(line):
            words = sentence.group().lower().split()
            start = at + sentence.start()
            if len(words) < LONG_WORDS:
                if words:
                    yield start, at + sentence.end(), words
                continue
            held: list[str] = []
            begun = start
            for token, word in zip(WORD.finditer(sentence.group()), words):
                held.append(word)
                if ends_piece(word):
                    yield begun, start + token.end(), held
                    held, begun = [], start + token.end()
            if held:
                yield begun, at + sentence.end(), held
        at += len(line) + 1


def text_units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, length, normalised text) of each unit; runs of short pieces are read off a sliding stretch."""
    run: list[tuple[int, int, list[str]]] = []  # the last pieces, no more than reach ``min_words``
    held = 0
    begins: list[tuple[int, int, list[str]]] = []  # the same for the earliest short piece that still waits
    waiting = 0
    for piece in pieces(text):
        size = len(piece[2])
        run.append(piece)
        held += size
        while held - len(run[0][2]) >= min_words:
            held -= len(run.pop(0)[2])
        if size >= min_words:
            yield piece[0], piece[1] - piece[0], " ".join(piece[2])
        if begins or size < min_words:
            begins.append(piece)
            waiting += size
        last = None
        while begins and waiting >= min_words:
            if len(begins[0][2]) < min_words:
                last = begins[0][0]
                yield _unit(begins)
            waiting -= len(begins.pop(0)[2])
        # The run that ends here, unless it has just been given as one that begins.
        if size < min_words and held >= min_words and run[0][0] != last:
            yield _unit(run)


def _unit(run: list[tuple[int, int, list[str]]]) -> tuple[int, int, str]:
    return run[0][0], run[-1][1] - run[0][0], " ".join(" ".join(words) for _, _, words in run)


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All units of all documents, with two 64-bit halves of their digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in small_batches(batches):
            ids, keys = batch.column("_doc").to_pylist(), batch.column("_th").to_pylist()
            rows: list[tuple] = []
            for doc, key, text in zip(ids, keys, batch.column("text")):
                for start, size, unit in text_units(text.as_py() or "", min_words):
                    d = digest(unit.encode("utf-8", "surrogatepass"))
                    rows.append((doc, key, start, size, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW
                    )
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW
                )

    return keyed(docs).select("_doc", "_th", "text").mapInArrow(cut, UNIT_SCHEMA)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per occurrence that goes, with the occurrence that stays.

    Columns: doc_id, ``_th``, start, n_chars, kept_doc_id, kept_start. Documents
    equal in id and text count once. Null and empty texts have no units. A null
    doc_id ranks after all others.
    """
    rank = F.struct(
        F.col("_doc").isNull().alias("none"),
        F.col("_doc").alias("doc"),
        F.col("_th").alias("th"),
        F.col("start").alias("at"),
        F.col("n_chars").alias("size"),
    )
    groups = stored(
        units(docs, min_words)
        .groupBy("d1", "d2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("kept"))
        .filter(F.col("n") > 1)
    )
    limit = max(1, (groups.agg(F.sum("n")).first()[0] or 0) // HEAVY_KEYS)
    # Units of heavy groups, at most HEAVY_KEYS of them, are looked up where
    # they are; in the join by shuffle their rows go by a key of their own.
    heavy = groups.filter(F.col("n") > limit).select("d1", "d2", F.col("kept").alias("often"))
    light = groups.filter(F.col("n") <= limit).select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "kept")
    hits = (
        units(docs, min_words)
        .join(F.broadcast(heavy), ["d1", "d2"], "left")
        .withColumn("k1", F.when(F.col("often").isNull(), F.col("d1")).otherwise(F.xxhash64("_th", "start")))
        .withColumn("k2", F.when(F.col("often").isNull(), F.col("d2")).otherwise(F.col("_th")))
        .join(light, ["k1", "k2"], "left")
        .withColumn("kept", F.coalesce("often", "kept"))
        .filter(F.col("kept").isNotNull())
    )
    own = F.col("_doc").eqNullSafe(F.col("kept.doc")) & (F.col("_th") == F.col("kept.th"))
    end, kept_end = F.col("start") + F.col("n_chars"), F.col("kept.at") + F.col("kept.size")
    first = F.when(own, F.greatest("start", kept_end)).otherwise(F.col("start"))
    return (
        hits.filter(~own | (F.col("start") != F.col("kept.at")))
        .select(
            F.col("_doc").alias("doc_id"),
            "_th",
            first.alias("start"),
            (end - first).alias("n_chars"),
            F.col("kept.doc").alias("kept_doc_id"),
            F.col("kept.at").alias("kept_start"),
        )
        .filter("n_chars > 0")
        .distinct()
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``; all rows and columns stay.

    A line that is cut whole takes its line end along.
    """
    spans = (
        repeated_units(docs, min_words)
        .groupBy(F.col("doc_id").alias("_sdoc"), F.col("_th").alias("_sth"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "n_chars"))).alias("_spans"))
    )
    rows, doc, text = numbered(docs)
    joined = rows.join(
        spans, rows[doc].eqNullSafe(spans["_sdoc"]) & (text_key(rows[text]) == spans["_sth"]), "left"
    ).select(*rows.columns, "_spans")
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(text).to_pylist()
            for k, found in enumerate(batch.column("_spans").to_pylist()):
                if found:
                    texts[k] = without_spans(texts[k], [(s["start"], s["n_chars"]) for s in found])
            columns = [
                pa.array(texts, batch.schema.field(text).type) if n == text else batch.column(n) for n in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, rows.schema).toDF(*docs.columns)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given (start, length) spans, which may overlap."""
    kept, at = [], 0
    for start, size in sorted(spans):
        end = start + size
        if start > at:
            kept.append(text[at:start])
        if (start == 0 or text[start - 1] == "\n") and text[end : end + 1] == "\n":
            end += 1
        at = max(at, end)
    kept.append(text[at:])
    return "".join(kept)
