"""Hand-written logs for the awkward rows."""

import math

import pytest

from cartrail import EventLog, LogSpec
from cartrail.operators import commerce, predict, traces
from cartrail.sources import event_log, results
from conftest import as_set

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"


def write(tmp_path, *lines):
    file = tmp_path / "log.csv"
    file.write_text(HEADER + "\n".join(lines) + "\n")
    return str(file)


def test_bad_time_is_dropped_and_defaults_fill(spark, tmp_path):
    path = write(
        tmp_path,
        "2019-10-01 00:00:09 UTC,view,1,2.05E+18,,,1.5,7,s",
        "yesterday,view,1,2.05E+18,a,b,1.5,7,s",
        "2019-10-01 00:00:09,view,1,9.9E+30,a,b,1.5,7,s",
        "2019-10-01 00:00:10 UTC,cart,1,9.9E+30,a,b,1.5,7,s",
    )
    rows = event_log.load_event_log(spark, path).df.orderBy("event_time").collect()
    assert [r.event_type for r in rows] == ["view", "cart"]
    assert (rows[0].brand, rows[0].category_code) == ("Unknown", "Unknown")
    assert rows[0].category_id == 2050000000000000000 and rows[1].category_id is None


@pytest.mark.parametrize("line", ["abc,a,b,1.5", "2.05E+18,a,b,x"])
def test_malformed_number_is_an_error(spark, tmp_path, line):
    path = write(tmp_path, f"2019-10-01 00:00:09 UTC,view,1,{line},7,s")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        event_log.load_event_log(spark, path).df.collect()


def test_only_csv_names(spark):
    with pytest.raises(ValueError):
        event_log.load_event_log(spark, "/data/log.xlsx")
    with pytest.raises(ValueError):
        event_log.load_event_log(spark, "/data/log.csv", fmt="avro")


def test_missing_column_is_an_error(spark, tmp_path):
    file = tmp_path / "short.csv"
    file.write_text("event_time,event_type\n2019-10-01 00:00:09 UTC,view\n")
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        event_log.load_event_log(spark, str(file))


def test_doubled_quotes_and_commas_in_fields(spark, tmp_path):
    path = write(tmp_path, '2019-10-01 00:00:09 UTC,view,1,2.05E+18,"a ""b"", c","x,y",1.5,7,s')
    row = event_log.load_event_log(spark, path).df.first()
    assert (row.category_code, row.brand, row.price, row.user_session) == ('a "b", c', "x,y", 1.5, "s")


@pytest.mark.parametrize("line", ["UTC,view,1,2.05E+18,c,b,1.5,7,s,more", "UTC,view,1,2.05E+18,c,b,1.5", 'UTC,view,1,2,"c\nd",b,1.5,7,s'])
def test_surplus_short_and_broken_lines_are_errors(spark, tmp_path, line):
    path = write(tmp_path, f"2019-10-01 00:00:09 {line}")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        event_log.load_event_log(spark, path).df.collect()


def test_log_with_other_column_names(spark, tmp_path):
    file = tmp_path / "own.csv"
    file.write_text(
        "at,event_type,product_id,category_id,category_code,brand,price,user_id,sid\n"
        "2019-10-01 00:00:09 UTC,view,1,2.05E+18,,b,1.5,7,x\n"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        log = event_log.load_event_log(spark, str(file), LogSpec(case="sid", time="at"))
        row = log.df.first()
        assert (row.sid, str(row.at), row.category_code) == ("x", "2019-10-01 00:00:09", "Unknown")
        assert as_set(traces.start_activities(log), "activity", "cases") == {("view", 1)}
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_files_of_a_folder_must_agree(spark, tmp_path):
    names = HEADER.strip().split(",")
    line = "2019-10-01 00:00:09 UTC,view,1,2.05E+18,c,b,1.5,7,s".split(",")
    for name, order in (("a", names), ("b", names[::-1])):
        values = [line[names.index(c)] for c in order]
        (tmp_path / f"{name}.csv").write_text(",".join(order) + "\n" + ",".join(values) + "\n")
    with pytest.raises(Exception, match="CSV header"):
        event_log.load_event_log(spark, str(tmp_path)).df.collect()
    one = event_log.load_event_log(spark, str(tmp_path / "b.csv")).df.first()
    assert (one.user_session, one.price) == ("s", 1.5)


def test_parquet_log_round_trip(spark, clicks, tmp_path):
    clicks.df.write.parquet(str(tmp_path / "log"))
    again = event_log.load_event_log(spark, str(tmp_path / "log"), fmt="parquet").df
    assert again.exceptAll(clicks.df.select(again.columns)).count() == 0 and again.count() == 25


def test_null_session(shop_rows):
    log = shop_rows([{"user_session": None, "category_code": "only"}, {}, {"event_type": "cart", "event_time": "2020-01-01 00:01:00"}])
    row = commerce.kpis(log).first()
    assert (row["rows"], row["sessions"]) == (3, 1)
    assert as_set(traces.with_paths(log, traces.variants(log)), "path", "cases") == {("view -> cart", 1)}
    assert as_set(traces.directly_follows(log), "src", "dst", "weight") == {("view", "cart", 1)}
    rates = {r.category: r.total_sessions for r in commerce.purchase_rate_by_category(log).collect()}
    assert rates == {"only": 0, "c": 1}
    window = {r.category: tuple(r)[1:] for r in commerce.window_shopper_by_category(log).collect()}
    assert window == {"only": (0, 0, 0.0), "c": (1, 0, 0.0)}


def test_price_borders(shop_rows):
    prices = [0.0, 50.0, 50.01, 2049.99, 2050.0, None, math.nan]
    log = shop_rows([{"price": p, "user_session": f"s{i}"} for i, p in enumerate(prices)])
    bins = as_set(commerce.price_distribution(log), "price_bin", "session_count")
    assert bins == {(0, 1), (50, 2), (2000, 1)}
    cells = {r.segment: r.session_count for r in commerce.hour_price_segments(log).collect()}
    assert cells == {"0-50": 1, "50-100": 1, "100-200": 0, "200-500": 0, "500-1000": 0, "1000+": 2}


def test_abandonment_is_clipped(shop_rows):
    log = shop_rows(
        [
            {"event_type": "purchase", "category_code": "no_cart"},
            {"event_type": "cart", "category_code": "more", "user_session": "a"},
            {"event_type": "purchase", "category_code": "more", "user_session": "a"},
            {"event_type": "purchase", "category_code": "more", "user_session": "b"},
            {"event_type": "view", "category_code": "seen"},
        ]
    )
    got = as_set(commerce.cart_abandonment(log), "category", "abandonment_rate")
    assert got == {("no_cart", 0.0), ("more", 0.0)}


def test_first_purchase_before_first_remove(shop_rows):
    types = ["purchase", "remove_from_cart", "purchase"]
    log = shop_rows([{"event_type": t, "event_time": f"2020-01-01 00:0{i}:00"} for i, t in enumerate(types)])
    assert commerce.remove_then_purchase(log).count() == 0
    row = commerce.remove_purchase_rate(log).first()
    assert (row.sessions, row.removals, row.remove_cart_purchase_rate) == (0, 1, 0.0)


def test_window_shoppers_need_views_only(shop_rows):
    log = shop_rows(
        [{"user_session": "a"}, {"user_session": "a"}, {"user_session": "b"}, {"user_session": "b", "event_type": None}]
    )
    assert as_set(commerce.window_shoppers(log), "case_id") == {"a"}


def test_equal_times_follow_the_ties(shop_rows):
    log = shop_rows([{"event_type": t} for t in ("view", "purchase", "cart")])
    want = {("cart -> purchase -> view")}
    assert as_set(traces.with_paths(log, traces.variants(log)), "path") == want
    for k in (1, 3, 7):
        shuffled = EventLog(log.df.repartition(k), log.spec)
        assert as_set(traces.with_paths(shuffled, traces.variants(shuffled)), "path") == want


def test_single_event_case(make_log):
    log = make_log(["a"])
    assert traces.directly_follows(log).count() == 0
    assert traces.next_activity_pairs(log).count() == 0
    assert as_set(traces.with_paths(log, traces.variants(log)), "path", "cases") == {("a", 1)}


def test_empty_log(shop_rows):
    log = shop_rows([])
    assert commerce.kpis(log).first()["rows"] == 0
    assert set(commerce.metrics(log).first().asDict().values()) == {0.0}
    assert traces.variants(log).count() == 0
    assert commerce.user_loyalty(log).first().returning_rate == 0.0


def test_sanitize(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame(
        [(nan, [1.0, inf, None], (-inf, "x"), {"k": nan}, None)],
        "a double, b array<double>, c struct<d: float, e: string>, f map<string, double>, g double",
    )
    row = results.sanitize_numeric(df).first()
    assert (row.a, row.b, tuple(row.c), row.f, row.g) == (0.0, [1.0, 0.0, None], (0.0, "x"), {"k": 0.0}, None)
    text = results.to_json_rows(df).first()[0]
    assert "NaN" not in text and "Infinity" not in text and '"g":null' in text


def test_long_case_keeps_last_twenty(make_log):
    word = "abcdefghij" * 3
    rows = traces.next_activity_pairs(make_log([word])).collect()
    ids = {c: i + 1 for i, c in enumerate(sorted(set(word)))}
    got = sorted((tuple(r.x), r.y) for r in rows)
    want = sorted(
        (tuple([0] * (20 - len(word[:i][-20:])) + [ids[c] for c in word[:i][-20:]]), ids[word[i]])
        for i in range(1, len(word))
    )
    assert got == want


def test_prediction_inputs(spark, make_log):
    log = make_log(["abc", "abc", "abd"])
    model, words = predict.train_ngram(log), traces.activity_vocabulary(log)
    asked = spark.createDataFrame(
        [("known", ["a", "b"]), ("noise", ["a", "?", "b"]), ("lost", ["?"]), ("none", [])],
        "seq_id string, sequence array<string>",
    )
    got = predict.predict_next(asked, model, words).collect()
    assert {r.seq_id for r in got} == {"known", "noise"}
    best = [(r.activity, r.prob) for r in sorted(got, key=lambda r: r["rank"]) if r.seq_id == "noise"]
    assert best == [("c", 2 / 3), ("d", 1 / 3)]
    reasons = as_set(predict.unanswered(asked, words), "seq_id", "reason")
    assert reasons == {("lost", "no known activity"), ("none", "empty sequence")}


def test_many_unknown_steps_at_the_end(spark, make_log):
    """The end is taken after unknown steps are gone, on arrays and on rows."""
    train = make_log(["abc", "abd", "abc"])
    model, words = predict.train_ngram(train), traces.activity_vocabulary(train)
    asked = spark.createDataFrame([("x", list("ab") + ["?"] * 40)], "seq_id string, sequence array<string>")
    want = {("c", 2 / 3), ("d", 1 / 3)}
    assert as_set(predict.predict_next(asked, model, words), "activity", "prob") == want
    tails = predict.known_tails(make_log(["ab" + "z" * 40, "zz"]), words)
    assert as_set(predict.predict_tails(tails, model), "seq_id", "activity", "prob") == {("c000", *w) for w in want}
    assert as_set(predict.unanswered_cases(make_log(["az", "zz"]), words), "seq_id") == {"c001"}


def test_rows_with_one_name_keep_their_own_sequence(spark, make_log):
    words = traces.activity_vocabulary(make_log(["ab"]))
    asked = spark.createDataFrame([("x", list("ab")), ("x", list("b?aa"))], "seq_id string, sequence array<string>")
    got = {tuple(r.sequence) for r in predict.known_only(asked, words).collect()}
    assert got == {("a", "b"), ("b", "a", "a")}


def test_unseen_context_backs_off(spark, make_log):
    log = make_log(["ab", "cb", "cb"])
    model, words = predict.train_ngram(log), traces.activity_vocabulary(log)
    asked = spark.createDataFrame([("x", ["b"]), ("y", ["b", "a"])], "seq_id string, sequence array<string>")
    got = as_set(predict.predict_next(asked, model, words), "seq_id", "activity", "prob")
    assert got == {("x", "b", 1.0), ("y", "b", 1.0)}


def test_time_of_day_is_the_log_clock(spark, shop_rows):
    log = shop_rows([{"event_time": "2020-03-29 02:30:00"}])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert as_set(commerce.hour_price_segments(log).filter("session_count > 0"), "hour") == {2}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fill_defaults_leaves_values(spark):
    df = spark.createDataFrame([("x", None)], "brand string, category_code string")
    assert tuple(event_log.fill_defaults(df).first()) == ("x", "Unknown")
