"""Next-activity models and batch scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.durable import durable
from cartrail.functions.lookup import small_lookup
from cartrail.operators.traces import activity_vocabulary, next_activity_pairs
from cartrail.spec import EventLog

# Look-back of the model, number of suggestions, seed.
MAX_LEN = 20
SUGGESTIONS = 3
SEED = 42

# Contexts up to this length recur in very many sequences; they are few, so
# they are joined by broadcast (after a size check), the longer ones by shuffle.
SHORT_CONTEXT = 3


def contexts(log: EventLog, max_len: int = MAX_LEN) -> DataFrame:
    """(case_id, context, next): the last ``max_len`` activities before each event."""
    s = log.spec
    return (
        log.sequences()
        .over(
            max_len,
            lambda df, w: df.withColumn(
                "context", F.collect_list(s.activity).over(w.rowsBetween(-max_len, -1))
            ),
        )
        .rows()
        .filter(F.size("context") > 0)
        .select(F.col(s.case).alias("case_id"), "context", F.col(s.activity).alias("next"))
    )


def _tail(values: Column, length: Column) -> Column:
    return F.slice(values, F.size(values) - length + 1, length)


def ngram_model(pairs: DataFrame) -> DataFrame:
    """Back-off table (context, length, next, n, prob) for all lengths 0 to the longest.

    ``pairs`` has columns context and next. Equal full contexts are counted
    first; shorter contexts are then summed from those counts, so the events
    are not multiplied by the number of lengths.
    """
    whole = pairs.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))
    counts = (
        whole.select(
            "context", "next", "n", F.explode(F.sequence(F.lit(0), F.size("context"))).alias("length")
        )
        .withColumn("context", _tail(F.col("context"), F.col("length")))
        .groupBy("context", "next")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("context"))
    return counts.select(
        "context",
        F.size("context").cast("bigint").alias("length"),
        "next",
        "n",
        (F.col("n") / total).alias("prob"),
    )


def train_ngram(log: EventLog, max_len: int = MAX_LEN) -> DataFrame:
    return ngram_model(contexts(log, max_len))


def suggestions(model: DataFrame, top: int = SUGGESTIONS) -> DataFrame:
    """Best next activities of each context, as an array of (activity, prob)."""
    by_prob = Window.partitionBy("context").orderBy(F.col("prob").desc(), "next")
    best = model.withColumn("rank", F.row_number().over(by_prob)).filter(F.col("rank") <= top)
    return best.groupBy("context", "length").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("rank").cast("bigint").alias("rank"),
                    F.col("next").alias("activity"),
                    "prob",
                )
            )
        ).alias("best")
    )


def score_tails(tails: DataFrame, model: DataFrame, top: int = SUGGESTIONS) -> DataFrame:
    """(tail, length, best) for distinct ``tail`` arrays: the longest known context wins."""
    known = suggestions(model, top)
    short = small_lookup(known.filter(F.col("length").between(1, SHORT_CONTEXT)))
    long = known.filter(F.col("length") > SHORT_CONTEXT)
    tried = (
        tails.select(
            "tail",
            F.explode(F.sequence(F.lit(0), F.size("tail"))).alias("_length"),
        )
        .withColumn("context", _tail(F.col("tail"), F.col("_length")))
        .drop("_length")
    )
    size = F.size("context")
    # Length 0 matches every tail, so it is a default and not a join.
    default = known.filter("length = 0").select("best").scalar()
    hits = (
        tried.filter(size.between(1, SHORT_CONTEXT))
        .join(short, "context")
        .unionByName(tried.filter(size > SHORT_CONTEXT).join(long, "context"))
        .unionByName(
            tried.filter(size == 0).select(
                "context", "tail", F.lit(0).cast("bigint").alias("length"), default.alias("best")
            )
        )
    )
    return (
        hits.filter(F.col("best").isNotNull())
        .groupBy("tail")
        .agg(F.max("length").alias("length"), F.max_by("best", "length").alias("best"))
    )


def known_only(sequences: DataFrame, vocabulary: DataFrame, column: str = "sequence") -> DataFrame:
    """Drop activities outside the vocabulary; order and repeats stay.

    Every row keeps its own sequence, whatever its other columns hold: steps are
    looked up as rows under a key generated for the row.
    """
    rows = durable(sequences.withColumn("_row", F.monotonically_increasing_id()))
    steps = rows.select("_row", F.posexplode(column).alias("pos", "activity"))
    kept = (
        steps.join(small_lookup(vocabulary.select("activity")), "activity")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "activity")))["activity"].alias("_kept"))
    )
    none = F.array().cast("array<string>")
    return (
        rows.join(kept, "_row", "left")
        .withColumn(column, F.coalesce("_kept", none))
        .drop("_row", "_kept")
    )


def predict_next(
    sequences: DataFrame,
    model: DataFrame,
    vocabulary: DataFrame,
    max_len: int = MAX_LEN,
    top: int = SUGGESTIONS,
) -> DataFrame:
    """Suggestions (seq_id, rank, activity, prob) for sequences (seq_id, sequence).

    ``model`` is read several times: pass a stored table, not a fresh plan.
    Unknown activities are dropped from the whole sequence before its end is
    taken. A sequence without any known one gets no rows; see ``unanswered``.
    """
    known = known_only(sequences, vocabulary)
    tail = _tail(F.col("sequence"), F.least(F.size("sequence"), F.lit(max_len)))
    return predict_tails(known.select("seq_id", tail.alias("sequence")), model, top)


def predict_tails(tails: DataFrame, model: DataFrame, top: int = SUGGESTIONS) -> DataFrame:
    """Suggestions for the ends (seq_id, sequence) of sequences of known activities.

    Equal tails are scored once. Their sequences are dealt over parts of each
    tail, because a short tail may belong to a large share of all sequences.
    """
    parts = 16
    asked = tails.filter(F.size("sequence") > 0).select(
        "seq_id", F.col("sequence").alias("tail"), F.pmod(F.xxhash64("seq_id"), F.lit(parts)).alias("_part")
    )
    scored = score_tails(asked.select("tail").distinct(), model, top)
    dealt = scored.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return (
        asked.join(dealt, ["tail", "_part"])
        .select("seq_id", F.explode("best").alias("b"))
        .select("seq_id", "b.rank", "b.activity", "b.prob")
    )


def known_tails(log: EventLog, vocabulary: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(seq_id, sequence): the last ``max_len`` known activities of each case that has one."""
    s = log.spec
    known = small_lookup(vocabulary.select(F.col("activity").alias(s.activity)))
    return case_tails(replace(log, df=log.df.join(known, s.activity, "left_semi")), max_len)


def unanswered_cases(log: EventLog, vocabulary: DataFrame) -> DataFrame:
    """Cases without any known activity, with the reason."""
    s = log.spec
    known = small_lookup(vocabulary.select(F.col("activity").alias(s.activity), F.lit(1).alias("_known")))
    return (
        log.df.join(known, s.activity, "left")
        .groupBy(F.col(s.case).alias("seq_id"))
        .agg(F.max("_known").alias("_known"))
        .filter(F.col("_known").isNull())
        .select("seq_id", F.lit("no known activity").alias("reason"))
    )


def unanswered(sequences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sequences that get no suggestion, with the reason."""
    was_empty = F.coalesce(F.size("sequence"), F.lit(0)) <= 0
    marked = sequences.withColumn("reason", F.when(was_empty, "empty sequence"))
    return (
        known_only(marked, vocabulary)
        .filter(F.coalesce(F.size("sequence"), F.lit(0)) <= 0)
        .select("seq_id", F.coalesce("reason", F.lit("no known activity")).alias("reason"))
    )


def case_tails(log: EventLog, length: int) -> DataFrame:
    """(seq_id, sequence): the last ``length`` activities of each case."""
    s = log.spec
    back = length - 1
    tails = log.sequences().over(
        back,
        lambda df, w: df.withColumn(
            "sequence", F.collect_list(s.activity).over(w.rowsBetween(-back, 0))
        ),
    )
    at_end = F.max_by("sequence", F.struct(*[F.col(c) for c in s.order]))
    return (
        tails.rows()
        .groupBy(F.col(s.case).alias("seq_id"))
        .agg(at_end.alias("sequence"))
    )


def in_holdout(case: Column) -> Column:
    """Three sixteenths of the cases, by the first digit of a hash."""
    return F.substring(F.md5(case.cast("string")), 1, 1).isin("0", "1", "2")


def next_activity_accuracy(log: EventLog, max_len: int = MAX_LEN) -> DataFrame:
    """Share of held-out events whose activity is the first suggestion."""
    pairs = contexts(log, max_len)
    held = in_holdout(F.col("case_id"))
    model = durable(ngram_model(pairs.filter(~held)))
    asked = (
        pairs.filter(held)
        .groupBy(F.col("context").alias("tail"), "next")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scored = score_tails(asked.select("tail").distinct(), model, top=1)
    hit = F.when(F.col("best")[0]["activity"] == F.col("next"), F.col("n")).otherwise(0)
    return (
        asked.join(scored, "tail", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
            F.coalesce(F.sum(hit), F.lit(0)).alias("hits"),
        )
        .withColumn("accuracy", F.coalesce(F.try_divide("hits", "pairs"), F.lit(0.0)))
    )


# Bytes of rows, as stored or as unpacked for the network, that one task of its fit should hold.
TASK_BYTES = 64 << 20


def _slots(x: str, max_len: int) -> list[Column]:
    return [F.col(x)[i].cast("double").alias(f"s{i}") for i in range(max_len)]


def _fit_tasks(log: EventLog, max_len: int, size: int, max_rows: int | None) -> int:
    """Parts to deal the rows of a network over, by the events that may give a row.

    Training passes over the rows once per iteration: at least one part a core,
    and as many more as keep a part near TASK_BYTES, however long the log is.
    """
    events = log.complete().count()
    stored = events * 8 * (max_len + 4)
    fitted = events if max_rows is None else min(events, max_rows)
    unpacked = fitted * 8 * (max_len * (size + 1) + size)
    parts = -(-max(stored, unpacked) // TASK_BYTES)
    return max(log.df.sparkSession.sparkContext.defaultParallelism, parts)


def train_classifier(
    log: EventLog,
    max_len: int = MAX_LEN,
    max_iter: int = 30,
    hidden: int = 64,
    max_rows: int | None = None,
    hold_out: bool = True,
) -> tuple[PipelineModel, DataFrame]:
    """A fitted network on one-hot slots of the last activities, and its held-out rows.

    Fitted on every row that is not held out, and on the rows of every case
    without ``hold_out``. Only a caller that gives ``max_rows`` gets a fit on
    about so many rows of whole cases; all held-out rows are returned.
    """
    pairs = next_activity_pairs(log, max_len)
    size = activity_vocabulary(log).count()
    rows = pairs.select("case_id", (F.col("y") - 1).cast("double").alias("label"), *_slots("x", max_len))
    rows = durable(rows.repartition(_fit_tasks(log, max_len, size, max_rows)))
    held = in_holdout(F.col("case_id")) if hold_out else F.lit(False)
    fitted = rows.filter(~held)
    if max_rows is not None:
        share = min(1.0, max_rows / max(1, rows.count()))
        fitted = fitted.filter(F.pmod(F.xxhash64("case_id"), F.lit(1_000_000)) < share * 1_000_000)
    slots = [f"s{i}" for i in range(max_len)]
    encoded = [f"v{i}" for i in range(max_len)]
    # One reference row per id fixes the width of every slot.
    ids = log.df.sparkSession.range(size + 1)
    widths = ids.select(*[F.col("id").cast("double").alias(c) for c in slots])
    encoder = OneHotEncoder(inputCols=slots, outputCols=encoded, dropLast=False).fit(widths)
    stages = Pipeline(
        stages=[
            encoder,
            VectorAssembler(inputCols=encoded, outputCol="features"),
            MultilayerPerceptronClassifier(
                layers=[max_len * (size + 1), hidden, size],
                maxIter=max_iter,
                seed=SEED,
                featuresCol="features",
                labelCol="label",
            ),
        ]
    )
    return stages.fit(fitted), rows.filter(held)


def classifier_suggestions(
    model: PipelineModel,
    tails: DataFrame,
    vocabulary: DataFrame,
    max_len: int = MAX_LEN,
    top: int = SUGGESTIONS,
) -> DataFrame:
    """(seq_id, rank, activity, prob) by a fitted network for the ends of sequences.

    ``tails`` (seq_id, sequence) hold known activities only, as from
    ``known_tails``; ``vocabulary`` is that of the log the model was fitted on.
    """
    ids = small_lookup(vocabulary.select("activity", (F.col("id") + 1).alias("id")))
    rows = durable(tails.filter(F.size("sequence") > 0).withColumn("_row", F.monotonically_increasing_id()))
    coded = (
        rows.select("_row", F.posexplode("sequence").alias("pos", "activity"))
        .join(ids, "activity")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"].alias("x"))
    )
    padding = F.array_repeat(F.lit(0).cast("bigint"), F.lit(max_len) - F.size("x"))
    slotted = rows.join(coded.withColumn("x", F.concat(padding, "x")), "_row").select("seq_id", *_slots("x", max_len))
    scored = model.transform(slotted).select("seq_id", vector_to_array("probability").alias("p"))
    ranked = F.slice(
        F.array_sort(F.transform("p", lambda p, i: F.struct((-p).alias("minus"), i.cast("bigint").alias("at")))), 1, top
    )
    best = scored.select("seq_id", F.posexplode(ranked).alias("rank", "b"))
    return best.join(ids, F.col("b.at") + 1 == F.col("id")).select(
        "seq_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "activity", (-F.col("b.minus")).alias("prob")
    )


def classifier_accuracy(log: EventLog, max_len: int = MAX_LEN, max_iter: int = 30) -> DataFrame:
    model, held = train_classifier(log, max_len, max_iter)
    hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
    return model.transform(held).agg(
        F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy")
    )
