"""Spelling variants: words one edit apart, and the frequent form each goes to.

Two words one edit apart agree before the edit and after it. So the positions
0..l-1 of a word are divided into segments, and words that agree in all
positions outside a segment form a group: a pair whose edit lies in the segment
meets there and nowhere else. A group above ``GROUP_WORDS`` is divided by halving
its segment, down to a single position, where at most one word a letter is left
besides the shortened one. No group is capped, and none grows with the corpus.

A group is sorted and scanned once a word. The rows of the edit matrix, three
cells wide, are kept for the prefix that the next word of the list shares with
the one before, and words whose shared prefix is already two edits away are
skipped without being read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.llm.common import lookup_by_key, stored

# The letters of a run, and those whose case is folded.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LETTERS, MIN_COUNT = 5, 3
DROP_ONE_IN = 97
STRONGER = 2
GROUP_WORDS = 96
FAR = 2


def vocabulary(docs: DataFrame) -> DataFrame:
    """(``word``, ``n``): the words of at least MIN_LETTERS letters that occur MIN_COUNT times.

    Of one (document, run) in DROP_ONE_IN, by its checksum, a letter is left
    out. A null text has no run; a null id is written as nothing in the checksum.
    Repeated rows count each.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    # Shorter runs can only lose letters.
    runs = runs.filter(F.length("run") >= MIN_LETTERS)
    h = F.crc32(F.concat_ws(":", "d", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % DROP_ONE_IN == 0, without).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS))
    )


def _key() -> Column:
    """What a word shows outside the segment [lo, hi) of the longer word's ``l`` positions."""
    after = F.col("l") - F.col("hi")
    tail = F.substring(F.col("word"), F.length("word") - after + 1, after)
    return F.xxhash64("l", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), tail)


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))
    )
    return (
        rows.withColumn("half", F.explode(halves))
        .select("word", "n", "l", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))
        .withColumn("key", _key())
    )


def grouped_words(words: DataFrame, group_words: int = GROUP_WORDS) -> list[DataFrame]:
    """Rows (word, n, l, lo, hi, key) of groups of 2 to ``group_words`` words, as frames to be united.

    Groups of single positions may be larger, by at most a word for each letter.
    """
    length = F.length("word")
    rows = words.select(
        "word", "n", F.explode(F.array(length, length + 1)).alias("l"), F.lit(0).alias("lo")
    ).select("word", "n", "l", "lo", F.col("l").alias("hi"))
    rows, done = _halved(rows), []
    while True:
        rows = stored(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("g"))
        found = stored(sizes.filter("g > 1").withColumn("size", F.col("g")))
        total = rows.count()
        sized = lookup_by_key(rows, found, ["key"], "g", total)
        fits = (F.col("size") <= group_words) | (F.col("hi") - F.col("lo") == 1)
        done.append(sized.filter(fits).drop("size"))
        if found.filter(F.col("size") > group_words).isEmpty():
            return done
        rows = _halved(sized.filter(~fits).drop("size", "key"))
        if rows.isEmpty():
            return done


def _shared(a: str, b: str) -> int:
    """Length of the prefix that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def near_in_list(words: list[str]) -> Iterator[tuple[int, int]]:
    """Positions (i, j), i < j, of the words of a list that are exactly one edit apart.

    ``words`` should be sorted: the more neighbours share, the less is computed.
    A row for prefix length d holds the distances to the prefixes of length d-1,
    d and d+1 of the word that is looked up.
    """
    shared = [0] + [_shared(a, b) for a, b in zip(words, words[1:])]
    count = len(words)
    for i in range(count - 1):
        own = words[i]
        size = len(own)
        # Rows along the word itself; the list goes on from there.
        rows = [(FAR, 0, 1 if size else FAR)]
        for d in range(1, size + 1):
            rows.append((1, 0, 1 if d < size else FAR))
        known = size
        dead = count and size + 2
        for j in range(i + 1, count):
            common = shared[j]
            if common >= dead:
                continue
            dead = size + 3
            if common < known:
                known = common
                del rows[known + 1 :]
            other = words[j]
            length = len(other)
            while known < length:
                low, same, high = rows[known]
                letter = other[known]
                known += 1
                # Cells for the looked-up prefixes of length known-1, known, known+1.
                if known - 1 <= size:
                    first = same + 1
                    if known >= 2 and low + (own[known - 2] != letter) < first:
                        first = low + (own[known - 2] != letter)
                else:
                    first = FAR
                if known <= size:
                    second = same + (own[known - 1] != letter)
                    if high + 1 < second:
                        second = high + 1
                    if first + 1 < second:
                        second = first + 1
                else:
                    second = FAR
                if known + 1 <= size:
                    third = high + (own[known] != letter)
                    if second + 1 < third:
                        third = second + 1
                else:
                    third = FAR
                rows.append((first, second, third))
                if first > 1 and second > 1 and third > 1:
                    dead = known
                    break
            else:
                step = size - length
                if -1 <= step <= 1 and rows[length][step + 1] == 1:
                    yield i, j


def _pairs(words: list[str], l: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of a group whose edit is the first difference and lies in the segment."""
    after = l - hi
    middles = [w[lo : len(w) - after] for w in words]
    for i, j in near_in_list(middles):
        a, b = words[i], words[j]
        if max(len(a), len(b)) != l or _shared(a, b) >= hi:
            continue
        # Keys are digests; what they stand for is compared as well.
        if a[:lo] == b[:lo] and a[len(a) - after :] == b[len(b) - after :]:
            yield i, j


_PAIRS = "a string, a_n long, b string, b_n long"


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(``a``, ``a_n``, ``b``, ``b_n``): every two words one edit apart, once."""
    groups: DataFrame | None = None
    for some in grouped_words(words, group_words):
        groups = some if groups is None else groups.unionByName(some)
    assert groups is not None
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            names = table.column("word").to_pylist()
            numbers = table.column("n").to_numpy()
            keys = [table.column(c).to_numpy() for c in ("key", "l", "lo", "hi")]
            new = np.ones(len(names), dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new).tolist()
            left, right = [], []
            for at, to in zip(starts, [*starts[1:], len(names)]):
                if to - at > 1:
                    l, lo, hi = (int(k[at]) for k in keys[1:])
                    for i, j in _pairs(names[at:to], l, lo, hi):
                        left.append(at + i)
                        right.append(at + j)
            columns = []
            for side in (left, right):
                columns.append(pa.array([names[k] for k in side], pa.string()))
                columns.append(pa.array(numbers[np.array(side, dtype=np.int64)], pa.int64()))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            # The last group may go on in the next batch.
            key = rows.column("key").to_numpy()
            done = int(np.argmax(key == key[-1])) if len(key) else 0
            if done:
                yield solved(rows.slice(0, done))
            held = rows.slice(done)
        if held is not None and held.num_rows:
            yield solved(held)

    # Words sort by code point, as the list needs them.
    ordered = groups.repartition("key").sortWithinPartitions("key", "l", "lo", "hi", "word")
    return ordered.mapInArrow(run, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): the end of the chain of forms of each word that has one.

    Chains climb to ever more frequent words; each round doubles the step.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(steps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"))
        moved = not after.filter("beyond is not null").isEmpty()
        steps = after.select("word", "root")
        if not moved:
            return steps


def variant_groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words with their counts.

    ``form`` is the most frequent word one edit away, the smaller of equal ones, if it is at
    least twice as frequent; ``root`` ends the chain of forms.
    """
    words = stored(words)
    pairs = near_pairs(words, group_words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("other")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("other")).alias("best")),
    )
    near = (
        pairs.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.word").alias("word"))
        .agg(F.count(F.lit(1)).alias("n_near"), F.min("s.best").alias("best"))
    )
    strong = -F.col("best.m") >= STRONGER * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"),
            F.when(strong, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variant_report(docs: DataFrame) -> DataFrame:
    """One row per word of the documents: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; an empty table gives no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """
    return variant_groups(vocabulary(docs))
