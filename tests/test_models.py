"""Graph, process models and samples against brute force."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from pytest import approx

from cartrail.functions import cuts
from cartrail.operators import discovery, graph, predict, sampling, traces, tree
from cartrail.plans import registry, report
import dense_cuts
from conftest import as_set


def brute_betweenness(edges):
    nodes = sorted({x for e in edges for x in e})
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for a, b in edges:
                if a == v:
                    if b not in dist:
                        dist[b], count[b] = dist[v] + 1, 0
                        queue.append(b)
                    if dist[b] == dist[v] + 1:
                        count[b] += count[v]

        def paths(t):
            if t == s:
                return [[s]]
            return [p + [t] for a, b in edges if b == t and dist.get(a, -9) + 1 == dist[t] for p in paths(a)]

        for t in dist:
            if t != s:
                for p in paths(t):
                    for v in p[1:-1]:
                        score[v] += 1 / len(paths(t))
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def test_betweenness(spark):
    rng = random.Random(11)
    nodes = "abcdefgh"
    edges = {tuple(rng.sample(nodes, 2)) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = as_set(graph.betweenness(df), "activity", "betweenness")
    assert dict(got) == approx(brute_betweenness(sorted(edges)))
    few = as_set(graph.betweenness(df, max_pivots=3), "activity", "betweenness")
    assert len(few) == len({x for e in edges for x in e})


def test_betweenness_is_exact_for_many_nodes(spark):
    around = [f"n{i}" for i in range(520)]
    edges = [e for a in around for e in ((a, "hub"), ("hub", a))]
    got = dict(as_set(graph.betweenness(spark.createDataFrame(edges, "src string, dst string")), "activity", "betweenness"))
    assert len(got) == 521 and got["hub"] == approx(1.0)
    assert all(got[a] == 0 for a in around)


def test_two_nodes(spark):
    df = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert as_set(graph.betweenness(df), "activity", "betweenness") == {("a", 0.0), ("b", 0.0)}


def test_alpha_places_are_the_maximal_pairs(make_log):
    cases = ["abd", "acd", "aed", "abcd", "acbd", "af"]
    follows = {p for w in cases for p in zip(w, w[1:])}
    acts = sorted(set("".join(cases)))
    causes = {(a, b) for a, b in follows if (b, a) not in follows}
    apart = lambda s: all((a, b) not in follows for a in s for b in s)
    sets = [s for k in range(1, len(acts) + 1) for s in itertools.combinations(acts, k) if apart(s)]
    pairs = [(x, y) for x in sets for y in sets if all((a, b) in causes for a in x for b in y)]
    best = {
        (x, y)
        for x, y in pairs
        if not any((set(x) <= set(p) and set(y) <= set(q) and (x, y) != (p, q)) for p, q in pairs)
    }
    got = as_set(discovery.alpha_places(make_log(cases)), "inputs", "outputs")
    assert got == {(",".join(x), ",".join(y)) for x, y in best} | {("", "a"), ("d,f", "")}


def brute_pairs(relations):
    """All maximal pairs, from every pair of sets."""
    acts = sorted({x for r in relations for x in r[:2]})
    related = {r[:2] for r in relations}
    causes = {r[:2] for r in relations if r[2] == "->"}
    apart = lambda s: all((a, b) not in related for a in s for b in s)
    sets = [s for k in range(1, len(acts) + 1) for s in itertools.combinations(acts, k) if apart(s)]
    pairs = [(x, y) for x in sets for y in sets if all((a, b) in causes for a in x for b in y)]
    return sorted(
        (x, y) for x, y in pairs if not any(set(x) <= set(p) and set(y) <= set(q) and (x, y) != (p, q) for p, q in pairs)
    )


@pytest.mark.parametrize("seed", range(4))
def test_maximal_pairs_of_random_relations(spark, seed):
    rng = random.Random(seed)
    relations = [("a", "a", "||")] if seed % 2 else []
    for a, b in itertools.combinations("abcdefg", 2):
        kind = rng.random()
        if kind < 0.5:
            a, b = (a, b) if kind < 0.25 else (b, a)
            relations += [(a, b, "->"), (b, a, "<-")]
        elif kind < 0.55:
            relations += [(a, b, "||"), (b, a, "||")]
    df = spark.createDataFrame(relations, "a string, b string, relation string")
    got = [(tuple(r.inputs), tuple(r.outputs)) for r in discovery.maximal_pairs(df).collect()]
    assert sorted(got) == brute_pairs(relations)


def test_a_place_of_twelve_by_twelve(spark):
    """Its parts are no rows: the search goes from a causal pair to the whole place."""
    forth = [(f"x{i:02d}", f"y{j:02d}", "->") for i in range(12) for j in range(12)]
    df = spark.createDataFrame(forth + [(b, a, "<-") for a, b, _ in forth], "a string, b string, relation string")
    rows = discovery.maximal_pairs(df).collect()
    assert [(len(r.inputs), len(r.outputs)) for r in rows] == [(12, 12)]


def text(rows):
    below = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r)

    def show(r):
        if r.kind in ("activity", "tau"):
            return r.activity or "tau"
        inner = sorted(below.get(r.node, []), key=lambda c: c.position)
        return f"{r.kind}({', '.join(show(c) for c in inner)})"

    return show(below[None][0])


KNOWN = [
    (["a"], "a"),
    (["abc"], "sequence(a, b, c)"),
    (["ab", "cd"], "xor(sequence(a, b), sequence(c, d))"),
    (["abc", "ac"], "sequence(a, xor(tau, b), c)"),
    (["a", "ab", "abc"], "sequence(a, xor(tau, sequence(b, xor(tau, c))))"),
    (["abcd", "acbd", "aed"], "sequence(a, xor(parallel(b, c), e), d)"),
    (["ab", "abcab"], "loop(sequence(a, b), c)"),
    (["abbb", "ab"], "sequence(a, loop(b, tau))"),
    # No cut, and no activity that every case has once: one runs beside a cut of the others.
    (["cd", "dcadc"], "parallel(xor(tau, a), loop(c, tau), loop(d, tau))"),
    (["abd", "cab", "dcb"], "parallel(b, xor(tau, a), sequence(xor(tau, d), xor(tau, c)))"),
    (["abc", "xabc", "axbc", "abxxc", "abcx", "xabxc"], "parallel(sequence(a, b, c), xor(tau, loop(x, tau)))"),
]


def test_flows_of_a_loop(make_log):
    got = as_set(tree.bpmn_flows(make_log(["ab", "abcab"])), "source", "target")
    assert got == {
        ("start", "loop_join_0"),
        ("loop_join_0", "task_a"),
        ("task_a", "task_b"),
        ("task_b", "loop_split_0"),
        ("loop_split_0", "task_c"),
        ("task_c", "loop_join_0"),
        ("loop_split_0", "end"),
    }


def random_logs(count):
    rng = random.Random(4)
    logs = [["ab", "ba", "aab"], ["axb", "xab", "abx", "aabxx"], ["abcabc", "acb", "cc"], ["a" * 5, "a"], ["xaybxz", "aybz", "aybxxz"]]
    while len(logs) < count:
        letters = "abcdef"[: rng.randint(2, 6)]
        if rng.random() < 0.5:
            logs.append(["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 5))])
        else:
            # Shuffled stretches of a fixed order, with steps left out.
            cut = rng.randint(0, len(letters))
            logs.append(
                [
                    "".join(a for part in (letters[:cut], letters[cut:]) for a in rng.sample(part, len(part)) if rng.random() < 0.8) or "a"
                    for _ in range(rng.randint(2, 8))
                ]
            )
    return logs


def test_trees_match_the_slow_way(spark):
    """Every cut and fall-through, on many logs in one run, against traces that are really projected."""
    logs = [cases for cases, _ in KNOWN] + random_logs(7)
    rows = [
        (str(n), f"{n}-{w}", p, a) for n, words in enumerate(logs) for w in set(words) for p, a in enumerate(w)
    ]
    events = spark.createDataFrame(rows, "node string, trace string, pos long, activity string")
    found = tree.grown_trees(events, 2_000_000).collect()
    below = {}
    for r in found:
        below.setdefault(r.node.split(".")[0], []).append(r)
    for n, words in enumerate(logs):
        assert text(below[str(n)]) == dense_cuts.as_text(dense_cuts.folded(dense_cuts.mine(words))), words
    for n, (_, want) in enumerate(KNOWN):
        assert text(below[str(n)]) == want
    plan = cuts.ordered_parts(events.select("node", events.activity.alias("x")).distinct(), events.selectExpr("node", "activity a", "activity b"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def split(facts, spark):
    points = {(k, x, x) for _, a, b in facts for k, x in (("point", a), ("point", b))}
    df = spark.createDataFrame(sorted({("0", *f) for f in facts} | {("0", *p) for p in points}), "node string, kind string, a string, b string")
    return cuts.split_nodes(df, lambda nodes: df.limit(0)).collect()


def test_chain_with_early_exits_is_split_at_once(spark):
    """Cases a, ab, abc: one call decides every level of the chain."""
    facts = [("start", "a", "a"), ("edge", "a", "b"), ("edge", "b", "c")]
    facts += [("end", x, x) for x in "abc"] + [("once", "a", "a")]
    rows = {(r.node, r.op, r.activity, r.part, r.leaf, r.optional, r.last) for r in split(facts, spark)}
    assert rows == {
        ("0", "sequence", "a", 0, True, False, True),
        ("0", "sequence", "b", 1, False, True, False),
        ("0", "sequence", "c", 1, False, True, False),
        ("0.1.1", "sequence", "b", 0, True, False, True),
        ("0.1.1", "sequence", "c", 1, True, True, True),
    }


def test_loop_of_the_facts(spark):
    facts = [("edge", "a", "b"), ("edge", "b", "c"), ("edge", "c", "a"), ("start", "a", "a"), ("end", "b", "b")]
    rows = split(facts, spark)
    assert {r.op for r in rows if r.node == "0"} == {"loop"}
    assert {r.activity: r.part for r in rows if r.node == "0"} == {"a": 0, "b": 0, "c": 1}


def test_cuts_of_a_long_chain_and_wide_nodes(spark, monkeypatch):
    """Tables too large to be held as literal rows."""
    monkeypatch.setattr("cartrail.functions.lookup.MAX_LOOKUP_ROWS", 100)
    chain = [f"n{(k * 37) % 120:03d}" for k in range(120)]
    facts = [("0", "edge", a, b) for a, b in zip(chain, chain[1:])] + [("1", "edge", f"w{k}", f"w{(k + 1) % 40}") for k in range(40)]
    df = spark.createDataFrame(facts, "node string, kind string, a string, b string")
    members = df.selectExpr("node", "a x").unionByName(df.selectExpr("node", "b x")).distinct()
    place = {(r.node, r.x): r.c for r in cuts.ordered_parts(members, cuts.edges(df)).collect()}
    assert [place["0", x] for x in chain] == list(range(120))
    assert {place["1", f"w{k}"] for k in range(40)} == {0}
    linked = df.select("node", "a", "b").unionByName(df.selectExpr("node", "b a", "a b"))
    assert {r.label for r in cuts.unlinked_groups(members, linked).collect()} == {min(chain), "w0"}


def test_sample_keeps_whole_sessions(clicks):
    whole = {}
    for r in clicks.df.collect():
        whole.setdefault(r.user_session, []).append(r)
    picked = sampling.sample_sessions(clicks, 12).collect()
    cases = {r.user_session for r in picked}
    assert len(cases) == int(8 * (12 / 25)) == 3
    assert len(picked) == sum(len(whole[c]) for c in cases)
    again = type(clicks)(clicks.df.repartition(5), clicks.spec)
    assert {r.user_session for r in sampling.sample_sessions(again, 12).collect()} == cases
    assert sampling.sample_sessions(clicks, 25).count() == 25
    assert sampling.sample_sessions(clicks, 0).select("user_session").distinct().count() == 1


def test_classifier_rows_are_dealt_by_their_bytes(make_log, monkeypatch):
    log = make_log(["abcdabcd"] * 120)
    few = predict.train_classifier(log, max_len=4, max_iter=1)[1]
    cores = log.df.sparkSession.sparkContext.defaultParallelism
    assert few.rdd.getNumPartitions() == cores
    # 960 events of 8 * (4 * 5 + 4) bytes unpacked; of 8 * (4 + 4) bytes stored, where few are unpacked.
    monkeypatch.setattr(predict, "TASK_BYTES", 3000, raising=False)
    many = predict.train_classifier(log, max_len=4, max_iter=1)[1]
    assert many.rdd.getNumPartitions() == 62
    assert max(many.rdd.glom().map(len).collect()) <= 3000 // 192
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    stored = predict.train_classifier(log, max_len=4, max_iter=1, max_rows=200)[1]
    assert stored.rdd.getNumPartitions() == 21 and stored.count() == few.count()


def test_classifier_suggests_for_every_case_from_many_parts(make_log, monkeypatch):
    log = make_log(["abcd"] * 60)
    vocabulary = traces.activity_vocabulary(log)
    monkeypatch.setattr(predict, "TASK_BYTES", 3000, raising=False)
    model, held = predict.train_classifier(log, max_len=4, max_iter=40)
    assert held.rdd.getNumPartitions() == 16
    best = predict.classifier_suggestions(model, make_log(["abc"] * 9).df.groupBy(F.col("case").alias("seq_id")).agg(
        F.array_sort(F.collect_list("act")).alias("sequence")
    ), vocabulary, max_len=4)
    assert as_set(best.filter("rank = 1"), "seq_id", "activity") == {(f"c{i:03d}", "d") for i in range(9)}
    assert best.count() == 27


MANY_PAIRS = 5_100_000  # more than the five million that a network was once fitted on


@pytest.fixture
def many_pairs(spark, make_log, monkeypatch):
    """A log whose pairs are replaced by many, and the numbers of rows that networks are fitted on."""
    pairs = spark.range(MANY_PAIRS).selectExpr("string(id) case_id", "array(1 + id % 3) x", "1 + id % 4 y")
    monkeypatch.setattr(predict, "next_activity_pairs", lambda log, max_len: pairs)
    fitted = []

    class Knowing:
        """Stands in for the network, which would take long to fit, and is always right."""

        def __init__(self, stages):
            pass

        def fit(self, rows):
            fitted.append(rows.count())
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.col("label"))

    monkeypatch.setattr(predict, "Pipeline", Knowing)
    return make_log(["abcd"]), fitted


def test_classifier_is_fitted_on_all_rows_of_a_long_log(many_pairs):
    log, fitted = many_pairs
    held = predict.train_classifier(log, max_len=1, hold_out=False)[1]
    assert fitted == [MANY_PAIRS] and held.isEmpty()


def test_accuracy_is_of_a_network_of_all_rows_outside_the_holdout(many_pairs):
    log, fitted = many_pairs
    row = predict.classifier_accuracy(log, max_len=1).first()
    assert 0 < row.pairs < MANY_PAIRS / 4 and fitted == [MANY_PAIRS - row.pairs]
    assert row.accuracy == 1.0


def test_suggestions_are_fitted_on_every_case(spark, tmp_path, monkeypatch):
    """The query scores with a network of all sessions; none are set aside, as it measures nothing."""
    kinds = "element_at(array('view', 'click', 'purchase', 'signup'), 1 + int(id * id + id div 40) % 4)"
    spark.range(200).selectExpr(
        "id event_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) ts",
        "id % 40 user_id",
        f"{kinds} event_type",
        "1.0D value",
        """'{"k": 1}' props""",
    ).write.parquet(f"{tmp_path}/events.parquet")
    fitted = []

    class Counting(predict.Pipeline):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(predict, "Pipeline", Counting)
    rows = registry.classifier_suggestions(spark, str(tmp_path)).collect()
    assert fitted == [160]
    assert len(rows) == 40 and all((r.suggestions, r.activities, r.in_order) == (3, 3, True) for r in rows)


def test_classifier_learns_a_fixed_order(make_log):
    row = predict.classifier_accuracy(make_log(["abcd"] * 60), max_len=4, max_iter=40).first()
    assert row.pairs > 0 and row.accuracy == 1.0


def test_accuracy_of_a_fixed_order(make_log):
    row = predict.next_activity_accuracy(make_log(["abcd"] * 60)).first()
    assert row.pairs > 0 and row.accuracy == 1.0


def test_report(clicks, tmp_path, spark):
    import json

    names = report.run_report(clicks, str(tmp_path))
    assert {"graph", "petri", "bpmn", "kpis", "brand_compare", "report"} <= set(names)
    for name in names:
        assert any((tmp_path / name).iterdir())
    lines = spark.read.text(str(tmp_path / "report")).collect()
    document = json.loads(lines[0][0])
    assert document["sample_size_used"] == 25 and len(document["event_log"]) == 25
    assert document["ecommerce"]["kpis"]["sessions"] == 8
    assert [s["activity"] for s in document["important_steps"]] == ["view", "cart", "purchase"]
    assert document["top_paths"][0]["path"] == "view -> cart -> purchase"
