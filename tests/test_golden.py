"""Known results, worked out by hand, on the sample log of 25 rows."""

import datetime as dt

from pytest import approx

from cartrail.operators import commerce, discovery, graph, sampling, traces
from conftest import as_set


def test_kpis(clicks):
    want = dict(
        rows=25, sessions=8, users=3, purchase_sessions=4, products=5, categories=5, brands=4, event_types=4
    )
    assert commerce.kpis(clicks).first().asDict() == want
    assert commerce.kpis(clicks, approx=True).first()["rows"] == 25


def test_activity_share(clicks):
    got = {r.activity: (r.events, r.share) for r in traces.activity_share(clicks).collect()}
    want = {"view": 11, "cart": 8, "purchase": 4, "remove_from_cart": 2}
    assert got == {a: (n, n / 25) for a, n in want.items()}


def test_directly_follows(clicks):
    collapsed = {
        ("view", "cart", 7),
        ("cart", "purchase", 4),
        ("cart", "remove_from_cart", 2),
        ("remove_from_cart", "cart", 1),
        ("remove_from_cart", "view", 1),
    }
    assert as_set(traces.directly_follows(clicks), "src", "dst", "weight") == collapsed
    raw = traces.directly_follows(clicks, collapse=False)
    assert as_set(raw, "src", "dst", "weight") == collapsed | {("view", "view", 2)}


def test_case_ends(clicks):
    assert as_set(traces.start_activities(clicks), "activity", "cases") == {("view", 8)}
    assert as_set(traces.end_activities(clicks), "activity", "cases") == {("purchase", 4), ("view", 2), ("cart", 2)}


def test_top_paths(clicks):
    got = [(r["path"], r["cases"]) for r in traces.top_paths(clicks).orderBy("rank").collect()]
    assert got == [
        ("view -> cart -> purchase", 2),
        ("view", 2),
        ("view -> cart", 2),
        ("view -> cart -> remove_from_cart -> cart -> purchase", 1),
        ("view -> cart -> remove_from_cart -> view -> cart -> purchase", 1),
    ]


def test_bottlenecks(clicks):
    got = [tuple(r) for r in graph.bottlenecks(graph.activity_graph(clicks)).orderBy("rank").collect()]
    assert [r[1] for r in got] == ["cart", "remove_from_cart", "view", "purchase"]
    assert [r[2] for r in got] == approx([1 / 2, 1 / 6, 0, 0], abs=1e-8)


def test_footprint_and_places(clicks):
    causes = {("view", "cart"), ("cart", "purchase"), ("remove_from_cart", "view")}
    want = {(a, b, "->") for a, b in causes} | {(b, a, "<-") for a, b in causes}
    both = {("cart", "remove_from_cart", "||"), ("remove_from_cart", "cart", "||"), ("view", "view", "||")}
    assert as_set(discovery.footprint(clicks), "a", "b", "relation") == want | both
    assert as_set(discovery.alpha_places(clicks), "place") == {"({cart},{purchase})", "source", "sink"}


def test_next_activity_pairs(clicks):
    rows = traces.next_activity_pairs(clicks).collect()
    assert len(rows) == 17
    assert all(len(r.x) == 20 and r.x[-1] > 0 for r in rows)


def test_price_tables(clicks):
    everything = {0: 3, 50: 2, 100: 2, 300: 2, 1450: 1}
    bought = {0: 2, 50: 1, 300: 1}
    assert as_set(commerce.price_distribution(clicks), "price_bin", "session_count") == set(everything.items())
    got = commerce.price_distribution(clicks, purchases=True)
    assert as_set(got, "price_bin", "session_count") == set(bought.items())
    labels = as_set(commerce.price_distribution(clicks), "price_label")
    assert "$0-$49" in labels and "$1450-$1499" in labels


def test_hour_segments(clicks):
    rows = commerce.hour_price_segments(clicks).collect()
    assert len(rows) == 30
    cells = {(r.hour, r.segment): r.session_count for r in rows if r.session_count}
    assert cells == {
        (8, "0-50"): 1,
        (8, "50-100"): 1,
        (9, "50-100"): 1,
        (9, "200-500"): 1,
        (9, "1000+"): 1,
        (10, "100-200"): 2,
        (10, "200-500"): 1,
        (21, "0-50"): 1,
        (23, "0-50"): 1,
    }


def test_brands(clicks):
    got = {r.brand: (r.sessions, r.purchase, r.conversion_rate) for r in commerce.brand_compare(clicks).collect()}
    named = {b: v for b, v in got.items() if b != "Unknown"}
    assert named == {"norda": (5, 3, 60.0), "tessel": (2, 1, 50.0), "ulmo": (2, 0, 0.0)}
    assert commerce.brand_compare_long(clicks).count() == 2 * len(got)


def test_categories(clicks):
    got = {
        r.category: (r.total_sessions, r.purchase_sessions, r.cart_sessions)
        for r in commerce.category_counts(clicks).collect()
    }
    assert got == {
        "garden.tools.rake": (3, 2, 2),
        "kitchen.kettle": (2, 1, 1),
        "garden.bench": (2, 1, 1),
        "office.chair": (2, 0, 2),
        "Unknown": (1, 0, 1),
    }
    rates = dict(as_set(commerce.cart_abandonment(clicks), "category", "abandonment_rate"))
    assert rates["office.chair"] == 100.0 and rates["kitchen.kettle"] == 0.0


def test_metrics(clicks):
    got = commerce.metrics(clicks).first().asDict()
    assert got["purchase_rate_avg"] == approx((200 / 3 + 50 + 50) / 5)
    assert got["window_shopper_rate"] == approx(25.0)
    assert got["remove_cart_purchase_rate"] == 100.0
    assert got["returning_rate"] == 100.0


def test_daily_tables(clicks):
    day = lambda n: dt.date(2024, 3, n)
    got = dict(as_set(commerce.daily_returning(clicks), "date", "returning_rate"))
    assert got == {day(4): 0, day(5): 50, day(6): 100, day(7): 100}
    assert as_set(commerce.remove_purchase_daily(clicks), "date", "sessions") == {(day(5), 2)}


def test_preview_keeps_cases_together(clicks):
    rows = sampling.event_log_preview(clicks, 7).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(1, 8))
    assert rows[0].event_time == "2024-03-04 08:10:00"
    cases = [r.user_session for r in rows]
    assert len(set(cases)) == sum(a != b for a, b in zip([None, *cases], cases))
    assert sampling.event_log_preview(clicks, 0).count() == 0
