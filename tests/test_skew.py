"""A case or user that holds much of the log gives the same rows either way."""

import random

import pytest
from pyspark.sql import functions as F

from cartrail import EventLog
from cartrail.functions import ordering
from cartrail.functions.ordering import Ordered, hot_keys
from cartrail.operators import commerce, predict, traces, tree
from cartrail.sources.bindings import sessionize
from conftest import as_set

HOT = 5


def words(seed=3):
    rng = random.Random(seed)
    small = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    return small + ["".join(rng.choice("abcd") for _ in range(120)), "ab" * 40, "a" * 60]


def collapse(word):
    return [b for a, b in zip([None, *word], word) if a != b]


@pytest.fixture(scope="module")
def both(make_log):
    return make_log(words()), make_log(words(), HOT)


def same(both, operator, *args, **kwargs):
    cold, hot = (operator(log, *args, **kwargs).collect() for log in both)
    assert hot and sorted(map(str, cold)) == sorted(map(str, hot))
    return cold


def test_hot_keys_are_found(both):
    assert both[0].hot("case") == []
    assert set(both[1].hot("case")[:3]) == {"c025", "c026", "c027"}


def test_sampled_detection_finds_the_large_key(spark):
    df = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'bot', CAST(id AS string)) AS k")
    assert hot_keys(df, "k", 10_000) == ["bot"]


@pytest.mark.parametrize("collapsing", [True, False])
def test_transitions(both, collapsing):
    want = {}
    for w in words():
        steps = collapse(w) if collapsing else list(w)
        for pair in zip(steps, steps[1:]):
            want[pair] = want.get(pair, 0) + 1
    got = same(both, traces.directly_follows, collapsing)
    assert {(r.src, r.dst): r.weight for r in got} == want


def test_traces_and_repeats(both):
    got = same(both, traces.traces)
    assert {(r.case_id, r.pos, r.activity) for r in got} == {
        (f"c{i:03d}", p + 1, a) for i, w in enumerate(words()) for p, a in enumerate(w)
    }
    same(both, traces.collapsed_log)


@pytest.mark.parametrize("stretch", [3, 1000])
def test_variants_with_long_paths(both, stretch):
    want = {}
    for i, w in enumerate(words()):
        want.setdefault(tuple(collapse(w)), []).append(f"c{i:03d}")
    got = same(both, lambda log: traces.with_paths(log, traces.variants(log), text_steps=stretch))
    assert sorted((r.steps, r.cases, r.first_case) for r in got) == sorted(
        (len(p), len(c), min(c)) for p, c in want.items()
    )
    assert {r.path for r in got} == {" -> ".join(p) for p in want}
    assert {r.variant_id for r in got} == {r.variant_id for r in same(both, traces.variants)}
    for log in both:
        steps = {}
        for r in traces.variant_steps(log, traces.variants(log)).collect():
            steps.setdefault(r.variant_id, {})[r.pos] = r.activity
        assert {tuple(s[p] for p in sorted(s)) for s in steps.values()} == set(want)
        assert set(steps) == {r.variant_id for r in got}


@pytest.mark.parametrize("collapsing", [True, False])
def test_path_tree(both, collapsing):
    want = {}
    for i, w in enumerate(words()):
        steps = collapse(w) if collapsing else list(w)
        for n in range(1, len(steps) + 1):
            want.setdefault(tuple(steps[:n]), []).append(f"c{i:03d}")
    nodes = {r.node: r for r in same(both, traces.path_tree, collapsing)}

    def path(node):
        return [] if node is None else path(nodes[node].parent) + [nodes[node].activity]

    assert len(nodes) == len(want)
    for r in (r for r in nodes.values() if r.pos <= 200):
        assert (r.cases, r.first_case) == (len(want[tuple(path(r.node))]), min(want[tuple(path(r.node))]))


def test_examples_and_tails(both):
    same(both, traces.next_activity_pairs, max_len=4)
    same(both, predict.train_ngram, max_len=3)
    same(both, predict.case_tails, 7)
    want = {(f"c{i:03d}", tuple(w[-7:])) for i, w in enumerate(words())}
    assert {(r.seq_id, tuple(r.sequence)) for r in predict.case_tails(both[1], 7).collect()} == want


def test_filtered_rows_are_renumbered(both):
    log = both[1]
    kept = log.sequences().filter(F.col("act") != "b")
    got = kept.over(1, lambda df, w: df.withColumn("prev", F.lag("act").over(w)))
    pairs = as_set(got.rows(), "case", "t", "prev", "act")
    want = set()
    for i, w in enumerate(words()):
        seen = None
        for t, a in enumerate(w):
            if a != "b":
                want.add((f"c{i:03d}", t, seen, a))
                seen = a
    assert pairs == want


def test_visits_of_a_hot_user(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for user, size in ((1, 80), (2, 4), (3, 1)):
        hour = 0
        for _ in range(size):
            hour += rng.choice([0, 1, 5, 13, 30])
            rows.append((n, user, hour))
            n += 1
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, h int").selectExpr(
        "event_id", "user_id", "CAST(timestamp_seconds(h * 3600) AS timestamp_ntz) AS ts"
    )
    want = set()
    for user in (1, 2, 3):
        visit, last = 0, None
        for e, _, h in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            visit += last is not None and h - last > 12
            last = h
            want.add((e, f"{user}-{visit}"))
    for hot in (4, 2_000_000):
        got = sessionize(df, "user_id", "ts", "event_id", 12, hot_rows=hot)
        assert as_set(got, "event_id", "user_session") == want


def test_session_order_of_a_hot_user(shop_rows):
    rows = [
        {"user_id": 1 if i % 3 else i, "user_session": f"s{i:02d}", "event_time": f"2020-01-{1 + i % 20:02d} 00:00:00"}
        for i in range(40)
    ]
    cold, hot = shop_rows(rows), shop_rows(rows, hot_rows=4)
    want = as_set(commerce.session_order(cold), "user_id", "case_id", "session_order")
    assert as_set(commerce.session_order(hot), "user_id", "case_id", "session_order") == want
    returning = {}
    for r in commerce.session_order(cold).collect():
        returning.setdefault(r.start.date(), []).append(r.session_order > 1)
    got = dict(as_set(commerce.daily_returning(cold), "date", "returning_rate"))
    assert got == {d: 100.0 * sum(v) / len(v) for d, v in returning.items()}


def test_tree_of_hot_cases(make_log):
    cases = ["abcab" + "cab" * 6, "ab", "abcab"]
    cold = as_set(tree.process_tree(make_log(cases)), "node", "kind", "activity")
    assert as_set(tree.process_tree(make_log(cases, 4)), "node", "kind", "activity") == cold


def test_copies_of_one_event(make_log, spark):
    rows = [("bot", "view", 1)] * 50 + [("bot", "cart", 2)] * 3 + [("x", "view", 1), ("x", "cart", 2)]
    df = spark.createDataFrame(rows, "case string, act string, t bigint")
    spec = make_log(["a"]).spec
    for hot in (5, 2_000_000):
        log = EventLog(df, spec, hot)
        assert as_set(traces.with_paths(log, traces.variants(log)), "path", "cases") == {("view -> cart", 2)}
        raw = as_set(traces.directly_follows(log, False), "src", "dst", "weight")
        assert raw == {("view", "view", 49), ("view", "cart", 2), ("cart", "cart", 2)}


def test_copies_are_split_into_runs(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES_PER_TASK", 4)
    df = spark.createDataFrame([("a", 1)] * 11 + [("a", 2)] * 4 + [("b", None)], "k string, v int")
    got = sorted(map(str, ordering.with_copy_numbers(df).collect()))
    want = [("a", 1, i) for i in range(1, 12)] + [("a", 2, i) for i in range(1, 5)] + [("b", None, 1)]
    assert got == sorted(f"Row(k={k!r}, v={v!r}, _copy={i})" for k, v, i in want)
    placed = as_set(ordering.range_positions(df, "k", ["v"]), "k", "v", "_pos")
    assert placed == {("a", 1 if i <= 11 else 2, i) for i in range(1, 16)} | {("b", None, 1)}


def test_block_borders(spark):
    df = spark.createDataFrame([("k", i) for i in range(37)], "k string, t bigint")
    for block in (1, 2, 5, 36, 37, 100):
        seq = Ordered.of(df, "k", ["t"], ["k"], block)
        sums = seq.running_sum(F.col("t"), "total").rows()
        assert as_set(sums, "t", "total") == {(i, i * (i + 1) // 2) for i in range(37)}
        back = seq.over(
            3, lambda d, w: d.withColumn("seen", F.collect_list("t").over(w.rowsBetween(-3, -1)))
        )
        got = {(r.t, tuple(r.seen)) for r in back.rows().collect()}
        assert got == {(i, tuple(range(max(0, i - 3), i))) for i in range(37)}
