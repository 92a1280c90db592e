"""Every operator as a named query over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartrail.functions.durable import durable
from cartrail.functions.labels import LABEL_WIDTH, PATH_WIDTH, wrapped
from cartrail.functions.lookup import settled
from cartrail.operators import commerce, discovery, graph, predict, sampling, sketches, traces, tree
from cartrail.plans import dashboards, report
from cartrail.sources import bindings, event_log, results
from cartrail.spec import EventLog

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_SHARE = 0.25  # row budget of the sample query, as a share of the log


def _on(log: Callable[[SparkSession, str], EventLog], operator, *args, **kwargs) -> Query:
    return lambda spark, sf_dir: operator(log(spark, sf_dir), *args, **kwargs)


def _shop(operator, *args, **kwargs) -> Query:
    return _on(bindings.shop_log, operator, *args, **kwargs)


def _session(operator, *args, **kwargs) -> Query:
    return _on(bindings.session_log, operator, *args, **kwargs)


def _dialogue(operator, *args, **kwargs) -> Query:
    return _on(bindings.dialogue_log, operator, *args, **kwargs)


def _csv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.csv_scan(spark, bindings.csv_log_folder(spark, sf_dir))


def log_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_raw(spark, sf_dir).withColumn("price", F.col("price").cast("double"))


def log_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = event_log.parse_log_time(F.col("event_time"))
    return (
        _csv_raw(spark, sf_dir)
        .select("user_session", "product_id", time.alias("event_time"))
        .filter(F.col("event_time").isNotNull())
    )


def log_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = event_log.fill_defaults(_csv_raw(spark, sf_dir))
    return filled.groupBy("brand", "category_code").agg(F.count(F.lit(1)).alias("rows"))


def log_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_raw(spark, sf_dir).select(
        "user_session",
        "product_id",
        event_log.scientific_to_long(F.col("category_id")).alias("category_id"),
    )


def log_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.load_event_log(spark, bindings.csv_log_folder(spark, sf_dir)).df


def log_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.sorted_normalized(bindings.session_log(spark, sf_dir))


def sanitize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with NaN and infinities put in, alone and in an array."""
    k = F.col("product_id") % 10
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    dirty = F.when(k == 1, nan).when(k == 2, inf).when(k == 3, -inf).otherwise(F.col("price"))
    rows = bindings.shop_log(spark, sf_dir).df.select(
        "event_id", dirty.alias("price"), F.array(dirty, F.lit(1.5)).alias("pair")
    )
    safe = results.sanitize_numeric(rows)
    return safe.select(
        "event_id",
        "price",
        F.col("pair")[0].alias("pair_first"),
        F.col("pair")[1].alias("pair_second"),
    )


def _sample_budget(log: EventLog) -> int:
    return int(log.df.count() * SAMPLE_SHARE)


def sample_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bindings.session_log(spark, sf_dir)
    return sampling.sample_sessions(log, _sample_budget(log)).select("event_id", "user_session")


def important_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.important_steps(bindings.session_log(spark, sf_dir))


def _variants(log: EventLog, collapse: bool) -> DataFrame:
    """Every variant with its path; the counts are stored, as the texts are read off them."""
    return traces.with_paths(log, durable(traces.variants(log, collapse)), collapse)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(bindings.session_log(spark, sf_dir), collapse=True)


def variants_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(bindings.session_log(spark, sf_dir), collapse=False)


def variant_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bindings.session_log(spark, sf_dir)
    return traces.variant_steps(log, durable(traces.variants(log)))


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.path_tree(bindings.session_log(spark, sf_dir))


def next_activity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = traces.next_activity_pairs(bindings.session_log(spark, sf_dir))
    return pairs.select("case_id", F.array_join("x", ",").alias("x"), "y")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(graph.activity_graph(bindings.graph_log(spark, sf_dir)))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(graph.activity_graph(bindings.graph_log(spark, sf_dir)))


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph.betweenness(_graph(spark, sf_dir))
    return scored.withColumn("betweenness", F.round("betweenness", 6))


def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = graph.bottlenecks(_graph(spark, sf_dir))
    return ranked.withColumn("betweenness", F.round("betweenness", 6))


def ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = predict.train_ngram(bindings.session_log(spark, sf_dir))
    return model.withColumn("context", F.array_join("context", ","))


def predict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the end of every session; a seventh of the steps has a name the model does not know."""
    log = bindings.session_log(spark, sf_dir)
    model = durable(predict.train_ngram(log))
    tails = predict.known_tails(_with_unknown_steps(log), traces.activity_vocabulary(log))
    return predict.predict_tails(tails, model)


def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bindings.session_log(spark, sf_dir)
    return predict.unanswered_cases(_with_unknown_steps(log), traces.activity_vocabulary(log))


def _with_unknown_steps(log: EventLog) -> EventLog:
    s = log.spec
    name = F.when(F.col("event_id") % 7 == 0, "unheard").otherwise(F.col(s.activity))
    return EventLog(log.df.withColumn(s.activity, name), s, log.hot_rows)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.round("value", 6))


def insight_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the report, one per row."""
    return _rounded(report.insight_rows(report.insight_context(bindings.shop_log(spark, sf_dir))))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts again, read out of the report's JSON text."""
    log = bindings.shop_log(spark, sf_dir)
    text = durable(report.report_json(log))
    kpis, metrics = (table(log).schema.simpleString() for table in (commerce.kpis, commerce.metrics))
    schema = (
        "struct<sample_size_used:bigint,event_log:array<struct<event_type:string>>,"
        "important_steps:array<struct<activity:string,share:double>>,"
        "bottlenecks:array<struct<activity:string,betweenness:double>>,"
        f"top_paths:array<struct<path:string,cases:bigint>>,ecommerce:struct<kpis:{kpis},metrics:{metrics}>>"
    )
    parsed = text.select(F.from_json(F.col(text.columns[0]), schema).alias("d"))
    facts = parsed.select(
        "d.important_steps", "d.bottlenecks", "d.top_paths", "d.ecommerce.kpis", "d.ecommerce.metrics"
    )
    sizes = F.array(
        F.struct(F.lit("sample_size_used").alias("key"), F.col("d.sample_size_used").cast("double").alias("value")),
        F.struct(F.lit("event_log").alias("key"), F.size("d.event_log").cast("double").alias("value")),
    )
    counted = parsed.select(F.posexplode(sizes).alias("at", "x")).select(
        F.lit("sizes").alias("section"), (F.col("at") + 1).cast("bigint").alias("rank"), "x.key", "x.value"
    )
    return _rounded(report.insight_rows(facts).unionByName(counted))


def classifier_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suggestions each session gets from the fitted network, and whether they are in order."""
    log = bindings.session_log(spark, sf_dir)
    vocabulary = durable(traces.activity_vocabulary(log))
    model, _ = predict.train_classifier(log, max_iter=5, hold_out=False)
    tails = predict.known_tails(_with_unknown_steps(log), vocabulary)
    best = predict.classifier_suggestions(model, tails, vocabulary)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "activity", "prob")))
    falling = F.forall(
        F.sequence(F.lit(1), F.size("b") - 1), lambda k: F.col("b")[k - 1]["prob"] >= F.col("b")[k]["prob"]
    )
    return best.groupBy("seq_id").agg(ranked.alias("b")).select(
        "seq_id", F.size("b").alias("suggestions"), F.size(F.array_distinct("b.activity")).alias("activities"), falling.alias("in_order")
    )


def _metrics(log: EventLog) -> DataFrame:
    rates = commerce.metrics(log)
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


def dashboard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shop tables of the report from one pass, one number per row: table, key, measure and value."""
    tables = dashboards.dashboard_tables(dashboards.stored_facts(bindings.shop_log(spark, sf_dir)))
    keys = {
        "brand_compare": ["brand"],
        "purchase_rate": ["category"],
        "abandonment_rate": ["category"],
        "window_shopper": ["category"],
        "loyal_returning": ["date"],
        "remove_purchase": ["date"],
        "session_price_dist": ["price_label"],
        "purchase_price_dist": ["price_label"],
        "session_heatmap": ["price_bin"],
        "purchase_heatmap": ["price_bin"],
        "session_hour_price": ["hour", "segment"],
        "purchase_hour_price": ["hour", "segment"],
    }
    whole = None
    for name, rows in tables.items():
        key = F.concat_ws("/", F.lit(""), *[F.col(k).cast("string") for k in keys.get(name, [])])
        measures = [c for c in rows.columns if c not in keys.get(name, [])]
        long = rows.select(
            F.lit(name).alias("table"), key.alias("key"), *[F.col(c).cast("double").alias(c) for c in measures]
        ).unpivot(["table", "key"], measures, "measure", "value")
        whole = long if whole is None else whole.unionByName(long)
    return _rounded(whole)


def kpis_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of every week, from the sketches of its days."""
    days = sketches.daily_sketches(bindings.shop_log(spark, sf_dir))
    week = F.trunc("day", "week").alias("week")
    return sketches.estimates(sketches.merged(days, week))


def wrapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all activities, brands, categories and collapsed paths, in lines as charts show them."""
    log = bindings.shop_log(spark, sf_dir)
    s = log.spec
    named = log.df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"), F.lit(LABEL_WIDTH).alias("width"))
                    for kind, c in (("activity", s.activity), ("brand", s.brand), ("category", s.category))
                ]
            )
        ).alias("x")
    ).select("x.*").distinct()
    paths = _variants(bindings.session_log(spark, sf_dir), collapse=True).select(
        F.lit("path").alias("kind"), F.col("path").alias("name"), F.lit(PATH_WIDTH).alias("width")
    )
    return named.unionByName(paths).select(
        "kind",
        "name",
        F.when(F.col("width") == LABEL_WIDTH, wrapped(F.col("name"), LABEL_WIDTH))
        .otherwise(wrapped(F.col("name"), PATH_WIDTH))
        .alias("label"),
    )


QUERIES: dict[str, Query] = {
    # sources and sinks
    "log_csv_scan": log_csv_scan,
    "log_time_parse": log_time_parse,
    "log_fill_defaults": log_fill_defaults,
    "log_try_cast": log_try_cast,
    "log_canonical": log_canonical,
    "log_normalized": log_normalized,
    "sanitize_numeric": sanitize_numeric,
    # sampling and browsing
    "sample_sessions": sample_sessions,
    "distinct_cases": _session(sampling.distinct_cases),
    "event_log_preview": _shop(sampling.event_log_preview),
    # traces
    "traces": _session(traces.traces),
    "collapsed_log": _session(traces.collapsed_log),
    "dfg_collapsed": _session(traces.directly_follows),
    "dfg_raw": _session(traces.directly_follows, collapse=False),
    "start_activities": _session(traces.start_activities),
    "end_activities": _session(traces.end_activities),
    "variants": variants,
    "variants_raw": variants_raw,
    "variant_steps": variant_steps,
    "path_tree": path_tree,
    "top_paths": _session(traces.top_paths),
    "activity_share": _session(traces.activity_share),
    "important_steps": important_steps,
    "next_activity_pairs": next_activity_pairs,
    "activity_vocab": _session(traces.activity_vocabulary),
    # graph
    "graph_nodes": graph_nodes,
    "betweenness": betweenness,
    "bottlenecks": bottlenecks,
    # discovery
    "footprint": _dialogue(discovery.footprint),
    "alpha_places": _dialogue(discovery.alpha_places),
    "petri_arcs": _dialogue(discovery.petri_arcs),
    "process_tree": _dialogue(tree.process_tree),
    "bpmn_flows": _dialogue(tree.bpmn_flows),
    # commerce
    "kpis": _shop(commerce.kpis),
    "metrics": _shop(_metrics),
    "session_price_dist": _shop(commerce.price_distribution),
    "purchase_price_dist": _shop(commerce.price_distribution, purchases=True),
    "session_heatmap": _shop(commerce.price_hour_heatmap),
    "purchase_heatmap": _shop(commerce.price_hour_heatmap, purchases=True),
    "session_price_hour": _shop(commerce.price_hour_counts),
    "session_hour_price": _shop(commerce.hour_price_segments),
    "purchase_hour_price": _shop(commerce.hour_price_segments, purchases=True),
    "brand_compare": _shop(commerce.brand_compare),
    "brand_compare_long": _shop(commerce.brand_compare_long),
    "purchase_rate_by_category": _shop(commerce.purchase_rate_by_category),
    "purchase_rate_top20": _shop(commerce.purchase_rate_by_category, commerce.TOP_CATEGORIES),
    "cart_abandonment": _shop(commerce.cart_abandonment),
    "cart_abandonment_top20": _shop(commerce.cart_abandonment, commerce.TOP_CATEGORIES),
    "window_shoppers": _session(commerce.window_shoppers),
    "window_shopper_rate": _session(commerce.window_shopper_rate),
    "window_shopper_by_category": _shop(commerce.window_shopper_by_category),
    "user_loyalty": _session(commerce.user_loyalty),
    "session_order": _session(commerce.session_order),
    "daily_returning": _session(commerce.daily_returning),
    "remove_then_purchase": _session(commerce.remove_then_purchase),
    "remove_purchase_rate": _session(commerce.remove_purchase_rate),
    "remove_purchase_daily": _session(commerce.remove_purchase_daily),
    "outer_join_counts": _shop(commerce.outer_join_counts),
    # next activity
    "ngram_model": ngram_model,
    "predict_next": predict_next,
    "unanswered": unanswered,
    "next_activity_accuracy": _session(predict.next_activity_accuracy),
    "classifier_suggestions": classifier_suggestions,
    "mlp_next_activity": _session(predict.classifier_accuracy),
    # report
    "insight_context": insight_context,
    "dashboard_facts": dashboard_facts,
    "kpis_sketched": kpis_sketched,
    "wrapped_labels": wrapped_labels,
    "report_json": report_json,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directly-follows graph of the whole log."""
    return QUERIES["dfg_collapsed"](spark, sf_dir)
