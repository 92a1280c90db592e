"""Benchmark passages in documents, found with DataFrame functions alone.

1. Words of five in a row (shingles) of a document that are among the rarest
   shingles of a benchmark item mark the stretches in which a window of the
   item's size can hold them. An item indexes just enough of them that a copy
   at the threshold must hold one, wherever in the window it stands.
2. Every start in a stretch is a window, unless it holds fewer shingles of the
   item than the threshold asks for.
3. Each window gets a SimHash of its shingles. Windows and items that agree in
   one of RADIUS + 1 blocks of the fingerprint are candidates, which by the
   pigeonhole principle loses no pair within RADIUS bits. At a similarity of
   0.8 fingerprints differ in about 10 bits, so the radius is wide, the blocks
   are short, and the index is keyed by the item as well. Windows beyond the
   radius are candidates if they have all bits that every copy at the threshold
   has, and none that no copy has.
4. The weighted (counted) Jaccard similarity of the shingles themselves decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.llm.common import keyed, stored, text_key

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
# Above so many indexed rows the benchmark is joined by shuffle, not broadcast.
BROADCAST_ROWS = 500_000
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: str) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), NO_WORD), "")


def shingles_of(words: str) -> Column:
    """Every five words in a row as text, repeats included; for five words and more."""
    last = F.size(words) - SHINGLE + 1
    return F.transform(
        F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(F.col(words), k, SHINGLE), " ")
    )


def simhash_of(shingles: str, margin: Column) -> tuple[Column, Column]:
    """64-bit SimHash of an array of texts: a bit is set if set in over half the hashes.

    With a ``margin``, if the hashes that set it outnumber the others by more than that.
    """
    hashes = F.transform(F.col(shingles), lambda s: F.xxhash64(s))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.struct(
            b.alias("b"),
            F.size(F.filter(F.col("_hashes"), lambda h: F.getbit(h, b) == 1)).alias("n"),
        ),
    )
    over = F.size("_hashes") + margin
    return hashes, F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda acc, x: acc.bitwiseOR(
            F.when(x["n"] * 2 > over, F.call_function("shiftleft", F.lit(1).cast("bigint"), x["b"])).otherwise(
                F.lit(0).cast("bigint")
            )
        ),
    )


def with_simhash(df: DataFrame, shingles: str, name: str, margin: Column | None = None) -> DataFrame:
    hashes, mark = simhash_of(shingles, F.lit(0) if margin is None else margin)
    return df.withColumn("_hashes", hashes).withColumn(name, mark).drop("_hashes")


def blocks_of(mark: str) -> Column:
    """The RADIUS + 1 blocks of a fingerprint as (number, value)."""
    edges = [round(k * BITS / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.shiftright(mark, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v"),
            )
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def weighted_similarity(left: str, right: str) -> Column:
    """Jaccard similarity of two arrays with repeats: shared over joint weight."""
    counted = F.aggregate(
        F.array_distinct(left),
        F.lit(0),
        lambda acc, s: acc
        + F.least(
            F.size(F.filter(F.col(left), lambda x: x == s)), F.size(F.filter(F.col(right), lambda x: x == s))
        ),
    )
    # Where one side repeats nothing, each shared text counts once.
    once = (F.size(F.array_distinct(left)) == F.size(left)) | (F.size(F.array_distinct(right)) == F.size(right))
    shared = F.when(once, F.size(F.array_intersect(left, right))).otherwise(counted)
    return shared / (F.size(left) + F.size(right) - shared)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items of at least SHINGLE words with their shingles and fingerprint.

    ``item_least`` has the bits that every text at the threshold sets, and
    ``item_most`` all that one may set: the shingles not shared turn no larger
    majority. Items equal in id and text are one. An item with fewer words has
    no shingle and is never found.
    """
    items = (
        benchmark.select("item_id", words_of("text").alias("_words"))
        .filter(F.size("_words") >= SHINGLE)
        .distinct()
        .withColumn("n_words", F.size("_words"))
        .withColumn("item_shingles", shingles_of("_words"))
        .withColumn("_item", F.xxhash64("item_id", "_words"))
    )
    unshared = F.floor(F.size("item_shingles") * 2 * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)
    marked = with_simhash(items, "item_shingles", "item_mark")
    marked = with_simhash(marked, "item_shingles", "item_least", unshared)
    return with_simhash(marked, "item_shingles", "item_most", -unshared).drop("_words")


def rare_shingles(items: DataFrame) -> DataFrame:
    """(``h``, ``_item``, ``j``): the shingles each item is indexed by, and their first place.

    Rarest over the benchmark first, then earliest, until those left out weigh
    less than a copy at the threshold must share.
    """
    each = items.select("_item", F.size("item_shingles").alias("size"), F.posexplode("item_shingles").alias("j", "s"))
    placed = each.groupBy("_item", "size", "s").agg(F.min("j").alias("j"), F.count(F.lit(1)).alias("w"))
    spread = placed.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("_item").orderBy("df", "j").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(order), F.lit(0))
    return (
        placed.join(spread, "s")
        .withColumn("before", before)
        .filter(F.col("before") <= F.floor(F.col("size") * (1 - SIMILARITY) + 1e-9))
        .select(F.xxhash64("s").alias("h"), "s", "_item", "j")
    )


def hashes_of(shingles: str) -> Column:
    return F.transform(F.col(shingles), lambda s: F.xxhash64(s))


def window_starts(held: str, size: Column, item_size: Column, last: Column) -> Column:
    """Starts from 0 to ``last`` of the windows that hold enough places for the threshold.

    ``held`` are the places, ascending, of shingles that the item has too,
    ``size`` is that of a window in shingles. The i-th place is the first one
    for the starts behind the place before, and so many places on must still lie
    in the window.
    """
    need = F.ceil((size + item_size) * SIMILARITY / (1 + SIMILARITY) - 1e-9).cast("int")
    place = lambda i: F.get(F.col(held), i)
    begin = lambda i: F.greatest(
        F.lit(0), F.coalesce(place(i - 1) + 1, F.lit(0)), place(i + need - 1) - size + 1
    )
    end = lambda i: F.least(place(i), last)
    firsts = F.when(F.size(held) >= need, F.sequence(F.lit(0), F.size(held) - need)).otherwise(F.array().cast("array<int>"))
    return F.flatten(
        F.transform(F.filter(firsts, lambda i: begin(i) <= end(i)), lambda i: F.sequence(begin(i), end(i)))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) at SIMILARITY or more, with its best window.

    Columns: doc_id, ``_th``, item_id, start_word (from 0), n_words, similarity,
    distance (of the fingerprints). Equal rows of documents give one. A document
    shorter than the item is one window. Null or short texts give no rows.
    """
    items = stored(benchmark_items(benchmark))
    index = stored(
        rare_shingles(items).join(items.select("_item", "n_words"), "_item").select("h", "s", "_item", "j", "n_words")
    )
    fits = index.count() <= BROADCAST_ROWS
    near = F.broadcast if fits else (lambda df: df)
    last = F.size("_words") - SHINGLE + 1
    at = F.posexplode(F.array_repeat(F.lit(0), last)).alias("_at", "_unused")
    gram = [F.col("_words")[F.col("_at") + k] for k in range(SHINGLE)]
    grams = (
        keyed(docs)
        .select("_doc", "_th", words_of("text").alias("_words"))
        .filter(F.size("_words") >= SHINGLE)
        .select("_doc", "_th", "_words", at)
        .withColumn("h", F.xxhash64(F.concat_ws(" ", *gram)))
    )
    # A hit lies in the windows that start in the ``reach`` places up to it. These
    # lie in one or two stretches of ``reach`` starts each, shared by all their hits.
    reach = F.col("n_words") - SHINGLE + 1
    final = F.greatest(F.lit(0), F.size("_words") - F.col("n_words"))
    stretches = F.sequence(
        F.floor(F.greatest(F.lit(0), F.col("_at") - reach + 1) / reach).cast("int"),
        F.floor(F.least(F.col("_at"), final) / reach).cast("int"),
    )
    found = (
        grams.join(near(index), "h")
        .filter(F.concat_ws(" ", *gram) == F.col("s"))
        .select("_doc", "_th", "_item", "n_words", "_words", F.explode(stretches).alias("_stretch"))
        .withColumn("_from", F.col("_stretch") * reach)
        .select("_doc", "_th", "_item", "_from", F.slice("_words", F.col("_from") + 1, reach - 1 + F.col("n_words")).alias("_part"))
        .groupBy("_doc", "_th", "_item", "_from")
        .agg(F.first("_part").alias("_part"))
    )
    small = fits and items.count() * (RADIUS + 1) <= BROADCAST_ROWS
    few = F.broadcast if small else (lambda df: df)
    known = items.select("_item", "n_words", hashes_of("item_shingles").alias("_known"))
    held = F.filter(
        F.transform("_grams", lambda g, i: F.when(F.array_contains("_known", F.xxhash64(g)), i)), lambda i: i.isNotNull()
    )
    size = F.least(reach, F.size("_grams"))
    windows = (
        found.withColumn("_grams", shingles_of("_part"))
        .join(few(known), "_item")
        .withColumn("_held", held)
        .withColumn("_size", size)
        .withColumn("_last", F.least(reach - 1, F.size("_grams") - F.col("_size")))
        .withColumn("_start", F.explode(window_starts("_held", F.col("_size"), F.size("_known"), F.col("_last"))))
        .select(
            "_doc",
            "_th",
            "_item",
            (F.col("_from") + F.col("_start")).alias("start_word"),
            F.slice("_grams", F.col("_start") + 1, F.col("_size")).alias("shingles"),
        )
    )
    # Few rows, but long work on each: spread evenly, and done once.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = windows.repartition(tasks, "_th", "_item", "start_word")
    marked = stored(with_simhash(spread, "shingles", "mark"))
    item_blocks = items.select("_item", "item_id", "n_words", "item_mark", "item_shingles", F.explode(blocks_of("item_mark")).alias("b"))
    item_blocks = item_blocks.select("_item", "item_id", "n_words", "item_mark", "item_shingles", "b.k", "b.v")
    distance = F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark")))
    near_by = (
        marked.select("*", F.explode(blocks_of("mark")).alias("b"))
        .select("_doc", "_th", "_item", "start_word", "shingles", "mark", "b.k", "b.v")
        .join(few(item_blocks), ["_item", "k", "v"])
        .withColumn("distance", distance.cast("int"))
        .filter(F.col("distance") <= RADIUS)
        # A pair may agree in many blocks; it is verified at the first of them.
        .filter(F.col("k") == F.array_position(F.transform(F.arrays_zip(blocks_of("mark").alias("x"), blocks_of("item_mark").alias("y")), lambda p: p["x"]["v"] == p["y"]["v"]), True) - 1)
        .drop("k", "v")
    )
    without = lambda a, b: F.col(a).bitwiseAND(F.bitwise_not(b)) == 0
    beyond = (
        marked.join(few(items), "_item")
        .withColumn("distance", distance.cast("int"))
        .filter(F.col("distance") > RADIUS)
        .filter(without("item_least", "mark") & without("mark", "item_most"))
        .drop("item_least", "item_most")
    )
    pairs = (
        near_by.unionByName(beyond)
        .withColumn("similarity", weighted_similarity("shingles", "item_shingles"))
        .filter(F.col("similarity") >= SIMILARITY)
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words", "distance")).alias("b")
    return pairs.groupBy("_doc", "_th", "item_id").agg(best).select(
        F.col("_doc").alias("doc_id"),
        "_th",
        "item_id",
        F.col("b.start_word").alias("start_word"),
        F.col("b.n_words").alias("n_words"),
        F.round(-F.col("b.s"), 6).alias("similarity"),
        F.col("b.distance").alias("distance"),
    )


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).distinct()
    held = docs["doc_id"].eqNullSafe(found["_d"]) & (text_key(docs["text"]) == found["_t"])
    return docs.join(found, held, "left_anti")
