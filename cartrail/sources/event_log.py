"""Reading an event log and bringing it to its canonical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartrail.spec import EventLog, LogSpec

# Fixed values of the log format: time pattern, default text.
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC$"
UNKNOWN = "Unknown"

FORMATS = ("csv", "parquet", "orc", "json")


def log_columns(spec: LogSpec = LogSpec()) -> list[str]:
    """The columns a log must have, by the names of the spec."""
    return [
        spec.time, spec.activity, spec.product, spec.category, spec.category_id,
        spec.brand, spec.price, spec.user, spec.case,
    ]


def parse_log_time(text: Column) -> Column:
    """``2024-03-04 00:00:09 UTC`` to a zone-less timestamp; null if it does not match."""
    return F.when(text.rlike(TIME_PATTERN), F.substring(text, 1, 19)).try_cast("timestamp_ntz")


def scientific_to_long(text: Column) -> Column:
    """``2.05E+18`` to bigint: bad text is an error, overflow is null."""
    return text.cast("double").try_cast("bigint")


def fill_defaults(df: DataFrame, columns: tuple[str, ...] = ("brand", "category_code")) -> DataFrame:
    return df.na.fill(UNKNOWN, subset=list(columns))


def csv_scan(spark: SparkSession, path: str, spec: LogSpec = LogSpec()) -> DataFrame:
    """The nine log columns of a headed CSV as text, picked by name.

    A quote inside quotes is doubled. A line with more or fewer fields than the
    header is an error; so is a quoted field with a line end in it, because
    lines are what large files are split at.

    Files of one folder must agree on their header; ``enforceSchema`` off makes
    a file with another column order an error instead of mixed-up columns.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    # Without pruning each line is read whole, so its fields can be counted.
    strict = reader.option("escape", '"').option("mode", "FAILFAST").option("columnPruning", False)
    return strict.csv(path).select(*log_columns(spec))


def canonical(raw: DataFrame, spec: LogSpec = LogSpec()) -> DataFrame:
    """Typed log: strict numbers, lenient time and category id, default texts.

    Rows whose time cannot be parsed are dropped. Columns that already have
    their type, as in a parquet log, pass through the same casts unchanged.
    """
    types = dict(raw.dtypes)
    time = F.col(spec.time)
    if types[spec.time] == "string":
        time = parse_log_time(time)
    category_id = F.col(spec.category_id)
    if types[spec.category_id] != "bigint":
        category_id = scientific_to_long(category_id)
    typed = raw.select(
        time.cast("timestamp_ntz").alias(spec.time),
        spec.activity,
        F.col(spec.product).cast("bigint").alias(spec.product),
        spec.category,
        category_id.alias(spec.category_id),
        spec.brand,
        F.col(spec.price).cast("double").alias(spec.price),
        F.col(spec.user).cast("bigint").alias(spec.user),
        spec.case,
    )
    return fill_defaults(typed.filter(F.col(spec.time).isNotNull()), (spec.brand, spec.category))


def load_event_log(
    spark: SparkSession, path: str, spec: LogSpec = LogSpec(), fmt: str = "csv"
) -> EventLog:
    """Load and type a log. A CSV source must be named ``*.csv`` or be a folder."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported log format {fmt!r}; use one of {', '.join(FORMATS)}")
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if fmt == "csv" and "." in last and not last.lower().endswith(".csv"):
        raise ValueError(f"{last!r} does not end in .csv; name another format with fmt=")
    if fmt == "csv":
        raw = csv_scan(spark, path, spec)
    else:
        raw = spark.read.format(fmt).load(path).select(*log_columns(spec))
    return EventLog(canonical(raw, spec), spec)


def normalized(log: EventLog) -> DataFrame:
    """Rows fit for process discovery, under the standard event-log names."""
    s = log.spec
    return (
        log.complete()
        .withColumnsRenamed(
            {s.case: "case:concept:name", s.activity: "concept:name", s.time: "time:timestamp"}
        )
    )


def sorted_normalized(log: EventLog) -> DataFrame:
    """``normalized`` in case and time order.

    A range sort on the whole tuple: a case with very many events spreads over
    several output files instead of filling one task.
    """
    names = {log.spec.time: "time:timestamp", log.spec.activity: "concept:name"}
    order = [names.get(c, c) for c in log.spec.order]
    return normalized(log).orderBy("case:concept:name", *order)
