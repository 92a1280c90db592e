"""The whole analysis of one log, as tables and as one JSON document."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.functions.lookup import settled
from cartrail.operators import commerce, discovery, graph, predict, sampling, traces, tree
from cartrail.plans import dashboards
from cartrail.sources.results import to_json_rows
from cartrail.spec import EventLog

REPORTED = 3  # leading steps and bottlenecks in a report


def important_steps(log: EventLog, top: int = REPORTED) -> DataFrame:
    return traces.activity_share(log, top)


def _list(df: DataFrame, drop_key: bool = False) -> Column:
    """A small ranking as one sorted array, its first column the sort key."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    if drop_key:
        rows = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in df.columns[1:]]))
    return df.agg(rows).scalar()


def _row(df: DataFrame) -> Column:
    return df.select(F.struct(*df.columns)).scalar()


def insight_context(log: EventLog) -> DataFrame:
    """The short facts a reader or a model needs about the log, in one row."""
    steps = important_steps(log)
    ranked = steps.select((-F.col("events")).alias("order"), "activity", "share")  # most first
    bottlenecks = settled(graph.bottlenecks(graph.activity_graph(log), REPORTED))
    return log.df.sparkSession.range(1).select(
        _list(ranked, drop_key=True).alias("important_steps"),
        _list(bottlenecks).alias("bottlenecks"),
        _list(traces.top_paths(log)).alias("top_paths"),
        _row(commerce.kpis(log)).alias("kpis"),
        _row(commerce.metrics(log)).alias("metrics"),
    )


def insight_rows(context: DataFrame) -> DataFrame:
    """The same facts one per row: section, rank, key and value."""

    def listed(section: str, key: str, value: str) -> DataFrame:
        return context.select(F.posexplode(section).alias("at", "x")).select(
            F.lit(section).alias("section"),
            (F.col("at") + 1).cast("bigint").alias("rank"),
            F.col(f"x.{key}").alias("key"),
            F.col(f"x.{value}").cast("double").alias("value"),
        )

    def named(section: str) -> DataFrame:
        names = context.schema[section].dataType.names
        facts = [F.struct(F.lit(n).alias("key"), F.col(f"{section}.{n}").cast("double").alias("value")) for n in names]
        return context.select(F.posexplode(F.array(*facts)).alias("at", "x")).select(
            F.lit(section).alias("section"), (F.col("at") + 1).cast("bigint").alias("rank"), "x.key", "x.value"
        )

    return (
        listed("important_steps", "activity", "share")
        .unionByName(listed("bottlenecks", "activity", "betweenness"))
        .unionByName(listed("top_paths", "path", "cases"))
        .unionByName(named("kpis"))
        .unionByName(named("metrics"))
    )


def report_tables(log: EventLog, facts_folder: str | None = None) -> dict[str, DataFrame]:
    """Every table of the analysis by name.

    The shop tables come from facts stored in one pass over the log, in
    ``facts_folder`` or else the shared folder.
    """
    edges = graph.activity_graph(log)
    shop = dashboards.dashboard_tables(dashboards.stored_facts(log, facts_folder))
    return shop | {
        "graph": edges.drop("first"),
        "activity_share": traces.activity_share(log),
        "bottlenecks": graph.bottlenecks(edges),
        "top_paths": traces.top_paths(log),
        "petri": discovery.petri_arcs(log),
        "bpmn": tree.bpmn_flows(log),
        "next_activity_model": predict.train_ngram(log),
    }


def report_json(log: EventLog) -> DataFrame:
    """The run's result as one JSON text.

    Only rankings, KPIs and the preview are in it; all are of fixed size. The
    tables that grow with the log are written by ``run_report``.
    """
    preview = sampling.event_log_preview(log)
    document = insight_context(log).select(
        log.df.agg(F.count(F.lit(1))).scalar().alias("sample_size_used"),
        _list(preview, drop_key=True).alias("event_log"),
        "important_steps",
        "bottlenecks",
        "top_paths",
        F.struct("kpis", "metrics").alias("ecommerce"),
    )
    return to_json_rows(document, "report")


def run_report(log: EventLog, folder: str) -> list[str]:
    """Write the typed log, every table and the JSON document below ``folder``.

    The log is written first and read back, so that the tables read only their
    columns of it instead of parsing the source again. ``facts`` holds what the
    shop tables are counted from.
    """
    spark = log.df.sparkSession
    log.df.write.mode("overwrite").parquet(f"{folder}/log")
    stored = replace(log, df=spark.read.parquet(f"{folder}/log"), _hot={})
    written = []
    for name, table in report_tables(stored, f"{folder}/facts").items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        written.append(name)
    report_json(stored).write.mode("overwrite").text(f"{folder}/report")
    return [*written, "report"]
