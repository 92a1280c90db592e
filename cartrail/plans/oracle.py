"""The same results in plain SQL, for checking the Spark queries."""

from __future__ import annotations

SESSIONS = """
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                      > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS g
  FROM events),
visits AS (
  SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(sum(g) OVER (
              PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS user_session,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM gaps)"""

SHOP = (
    SESSIONS
    + """,
log AS (
  SELECT v.event_id, v.ts AS event_time,
         CASE v.event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart'
              ELSE v.event_type END AS event_type,
         v.k AS product_id, v.value * 10 AS price, v.user_id, v.user_session,
         coalesce(p.p_brand, 'Unknown') AS brand,
         coalesce(p.p_type, 'Unknown') AS category_code
  FROM visits v LEFT JOIN part p ON p.p_partkey = v.k AND v.k % 10 <> 0)"""
)

STEPS = (
    SHOP
    + """,
steps AS (
  SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS pos,
         count(*) OVER (PARTITION BY user_session) AS n
  FROM log WINDOW w AS (PARTITION BY user_session ORDER BY event_time, event_id)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY user_session ORDER BY pos) AS cpos
  FROM steps WHERE prev IS NULL OR prev <> event_type)"""
)



def _paths(name: str, rows: str, pos: str) -> str:
    digest = f"md5({pos} || '|' || event_type)"
    bits = ", ".join(
        f"bit_xor(CAST('0x' || substr({digest}, {at}, 15) AS BIGINT)) AS x{at}" for at in (1, 16)
    )
    return f"""
{name} AS (
  SELECT user_session, path, steps, steps || '-' || hex(x1) || '-' || hex(x16) AS variant_id FROM (
    SELECT user_session, string_agg(event_type, ' -> ' ORDER BY pos) AS path, count(*) AS steps, {bits}
    FROM {rows} GROUP BY user_session))"""


PATHS = STEPS + "," + _paths("paths", "kept", "cpos") + "," + _paths("raw_paths", "steps", "pos")

CSV = (
    SHOP
    + """,
text AS (
  SELECT CASE WHEN product_id % 10 = 3 THEN 'unknown'
              ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS event_time,
         event_type, CAST(product_id AS VARCHAR) AS product_id,
         nullif(category_code, 'Unknown') AS category_code,
         CASE WHEN product_id % 10 = 7 THEN '9.9E+30'
              ELSE '2.' || lpad(CAST(product_id AS VARCHAR), 2, '0') || 'E+18' END AS category_id,
         nullif(brand, 'Unknown') AS brand, price,
         CAST(user_id AS VARCHAR) AS user_id, user_session
  FROM log),
typed AS (
  SELECT date_trunc('second', event_time) AS event_time, event_type, product_id, category_code,
         CASE WHEN product_id % 10 = 7 THEN NULL
              ELSE CAST(CAST('2.' || lpad(CAST(product_id AS VARCHAR), 2, '0') || 'E+18' AS DOUBLE)
                        AS BIGINT) END AS category_id,
         brand, price, user_id, user_session
  FROM log)"""
)

GRAPH = (
    SESSIONS
    + """,
acts AS (
  SELECT event_id, ts, user_session, event_type || ':' || CAST(k // 5 AS VARCHAR) AS a
  FROM visits),
pairs AS (
  SELECT lag(a) OVER (PARTITION BY user_session ORDER BY ts, event_id) AS src, a AS dst,
         user_session, ts, event_id FROM acts),
edges AS (
  SELECT src, dst, count(*) AS w, min((user_session, ts, event_id)) AS first
  FROM pairs WHERE src IS NOT NULL GROUP BY src, dst),
kept AS (SELECT src, dst, first FROM edges WHERE src <> dst),
nodes AS (SELECT src AS a FROM kept UNION SELECT dst FROM kept),
walks AS (
  SELECT a AS s, a AS v, 0 AS d FROM nodes
  UNION
  SELECT w.s, k.dst, w.d + 1 FROM walks w JOIN kept k ON k.src = w.v
  WHERE w.d < (SELECT count(*) FROM nodes)),
dist AS (SELECT s, v, min(d) AS d FROM walks GROUP BY s, v),
routes AS (
  SELECT a AS s, a AS v, 0 AS d FROM nodes
  UNION ALL
  SELECT r.s, k.dst, r.d + 1 FROM routes r JOIN kept k ON k.src = r.v
  JOIN dist x ON x.s = r.s AND x.v = k.dst AND x.d = r.d + 1),
sigma AS (SELECT s, v, any_value(d) AS d, CAST(count(*) AS DOUBLE) AS n FROM routes GROUP BY s, v),
shares AS (
  SELECT sv.v AS a, sum(sv.n * vt.n / st.n) AS total
  FROM sigma sv JOIN sigma vt ON vt.s = sv.v JOIN sigma st ON st.s = sv.s AND st.v = vt.v
  WHERE sv.s <> sv.v AND vt.v <> sv.v AND sv.s <> vt.v AND sv.d + vt.d = st.d
  GROUP BY sv.v),
scored AS (
  SELECT n.a AS activity,
         coalesce(s.total, 0.0) / greatest(1, ((SELECT count(*) FROM nodes) - 1)
                                  * ((SELECT count(*) FROM nodes) - 2)) AS betweenness
  FROM nodes n LEFT JOIN shares s ON s.a = n.a)"""
)

DIALOGUE = """
said AS (SELECT conv_id, turn, role || CAST(turn AS VARCHAR) AS a FROM conversations),
follow AS (
  SELECT DISTINCT p, a FROM (
    SELECT lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS p, a FROM said) WHERE p IS NOT NULL),
ends AS (
  SELECT min_by(a, turn) AS first, max_by(a, turn) AS last FROM said GROUP BY conv_id),
either AS (SELECT p AS a, a AS b FROM follow UNION SELECT a, p FROM follow),
relation AS (
  SELECT e.a, e.b, CASE WHEN f.p IS NOT NULL AND g.p IS NOT NULL THEN '||'
                        WHEN f.p IS NOT NULL THEN '->' ELSE '<-' END AS relation
  FROM either e LEFT JOIN follow f ON f.p = e.a AND f.a = e.b
                LEFT JOIN follow g ON g.p = e.b AND g.a = e.a)"""

PLACES = (
    DIALOGUE
    + """,
causal AS (
  SELECT a, b FROM relation WHERE relation = '->'
  AND a NOT IN (SELECT a FROM relation WHERE a = b) AND b NOT IN (SELECT a FROM relation WHERE a = b)),
grown AS (
  SELECT [a] AS ins, [b] AS outs FROM causal
  UNION
  SELECT CASE WHEN side = 0 THEN list_sort(list_append(ins, x)) ELSE ins END,
         CASE WHEN side = 1 THEN list_sort(list_append(outs, x)) ELSE outs END
  FROM (
    SELECT g.ins, g.outs, c.a AS x, 0 AS side FROM grown g JOIN causal c ON c.b = g.outs[1]
    UNION ALL
    SELECT g.ins, g.outs, c.b AS x, 1 AS side FROM grown g JOIN causal c ON c.a = g.ins[1]) e
  WHERE NOT list_contains(CASE WHEN side = 0 THEN ins ELSE outs END, x)
    AND NOT EXISTS (SELECT 1 FROM relation r WHERE r.a = x
                    AND list_contains(CASE WHEN side = 0 THEN ins ELSE outs END, r.b))
    AND (SELECT count(*) FROM causal c WHERE CASE WHEN side = 0
           THEN c.a = x AND list_contains(outs, c.b) ELSE c.b = x AND list_contains(ins, c.a) END)
        = len(CASE WHEN side = 0 THEN outs ELSE ins END)),
best AS (
  SELECT ins, outs FROM grown g WHERE NOT EXISTS (
    SELECT 1 FROM grown h WHERE list_has_all(h.ins, g.ins) AND list_has_all(h.outs, g.outs)
    AND len(h.ins) + len(h.outs) > len(g.ins) + len(g.outs))),
places AS (
  SELECT '({' || array_to_string(ins, ',') || '},{' || array_to_string(outs, ',') || '})' AS place,
         ins, outs FROM best)"""
)

# Names the events before each one, nearest last.
CONTEXTS = (
    STEPS
    + """,
ctx AS (
  SELECT user_session AS case_id, event_type AS next,
         list(event_type) OVER (PARTITION BY user_session ORDER BY event_time, event_id
                                ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS context
  FROM log),
pairs AS (SELECT * FROM ctx WHERE len(context) > 0)"""
)


def _model(pairs: str) -> str:
    """CTEs ``counts`` and ``model`` of the back-off table over a set of pairs."""
    return f"""
suffixes AS (
  SELECT context[len(context) - l + 1:] AS context, l AS length, next
  FROM (SELECT context, next, unnest(range(0, len(context) + 1)) AS l FROM {pairs})),
counts AS (
  SELECT context, length, next, count(*) AS n FROM suffixes GROUP BY context, length, next),
model AS (
  SELECT context, length, next, n, n / sum(n) OVER (PARTITION BY context) AS prob FROM counts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY context ORDER BY prob DESC, next) AS rank FROM model)"""


def _sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _percent(part: str, whole: str) -> str:
    return f"coalesce(100.0 * ({part}) / nullif({whole}, 0), 0.0)"


BUYS = "event_type = 'purchase'"
BIN = "CAST(floor(price / 50) * 50 AS BIGINT)"

CATEGORY = (
    SHOP
    + """,
cat AS (
  SELECT category_code AS category, count(DISTINCT user_session) AS total,
         count(DISTINCT user_session) FILTER (WHERE event_type = 'purchase') AS bought,
         count(DISTINCT user_session) FILTER (WHERE event_type = 'cart') AS carted,
         count(DISTINCT user_session) FILTER (WHERE event_type = 'view') AS viewed
  FROM log GROUP BY category_code),
only_view AS (
  SELECT user_session FROM log GROUP BY user_session HAVING bool_and(event_type = 'view'))"""
)

PURCHASE_RATE = f"""SELECT category, total AS total_sessions, bought AS purchase_sessions,
       total - bought AS non_purchase_sessions, {_percent('bought', 'total')} AS purchase_rate FROM cat"""
ABANDON_RATE = f"least(100.0, greatest(0.0, {_percent('carted - bought', 'carted')}))"
ABANDONMENT = f"""SELECT category, carted AS cart_sessions, bought AS purchase_sessions,
       {ABANDON_RATE} AS abandonment_rate FROM cat WHERE carted + bought > 0"""

BRANDS = f"""brands AS (
  SELECT brand, count(DISTINCT user_session) AS sessions,
         count(DISTINCT user_session) FILTER (WHERE {BUYS}) AS purchase
  FROM log GROUP BY brand ORDER BY sessions DESC, brand LIMIT 15),
rated AS (SELECT *, {_percent('purchase', 'sessions')} AS conversion_rate FROM brands)"""

LOYALTY = f"""users AS (SELECT user_id, count(DISTINCT user_session) AS n FROM log GROUP BY user_id),
loyal AS (SELECT {_percent('count(*) FILTER (WHERE n > 1)', 'count(*)')} AS returning_rate,
          {_percent('count(*) FILTER (WHERE n > 3)', 'count(*)')} AS loyal_rate FROM users)"""

REMOVED = """removed AS (
  SELECT user_session AS case_id, CAST(min(event_time) AS DATE) AS date FROM log
  GROUP BY user_session
  HAVING min(event_time) FILTER (WHERE event_type = 'purchase')
         > min(event_time) FILTER (WHERE event_type = 'remove_from_cart'))"""

STARTS = """starts AS (
  SELECT user_id, user_session AS case_id, min(event_time) AS start
  FROM log GROUP BY user_id, user_session),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, case_id) AS session_order
  FROM starts)"""

WINDOW_RATE = f"""shoppers AS (
  SELECT (SELECT count(*) FROM only_view) AS window_sessions,
         (SELECT count(DISTINCT user_session) FROM log) AS sessions)"""


def _bins(where: str) -> str:
    return _sql(
        SHOP,
        f"""SELECT {BIN} AS price_bin,
       '$' || CAST({BIN} AS VARCHAR) || '-$' || CAST({BIN} + 49 AS VARCHAR) AS price_label,
       count(DISTINCT user_session) AS session_count
FROM log WHERE {BIN} <= 2000 AND {where} GROUP BY {BIN}""",
    )


def _heatmap(where: str) -> str:
    hours = ", ".join(
        f"count(DISTINCT user_session) FILTER (WHERE hour(event_time) = {h}) AS h{h:02d}"
        for h in range(24)
    )
    return _sql(
        SHOP,
        f"SELECT {BIN} AS price_bin, {hours} FROM log WHERE {BIN} <= 2000 AND {where} GROUP BY {BIN}",
    )


def _segments(where: str) -> str:
    return _sql(
        SHOP,
        f"""SELECT h.hour, s.segment, count(DISTINCT l.user_session) AS session_count
FROM (SELECT DISTINCT hour(event_time) AS hour FROM log WHERE {where}) h
CROSS JOIN (VALUES ('0-50', 0, 50), ('50-100', 50, 100), ('100-200', 100, 200), ('200-500', 200, 500),
                   ('500-1000', 500, 1000), ('1000+', 1000, NULL)) s(segment, low, high)
LEFT JOIN log l ON hour(l.event_time) = h.hour AND l.price > s.low
     AND (s.high IS NULL OR l.price <= s.high) AND {where.replace('event_type', 'l.event_type')}
GROUP BY h.hour, s.segment""",
    )


ARCS = """SELECT 'activity_to_place' AS kind, unnest(ins) AS source, place AS target FROM places
UNION ALL SELECT 'place_to_activity', place, unnest(outs) FROM places
UNION ALL SELECT DISTINCT 'place_to_activity', 'source', first FROM ends
UNION ALL SELECT DISTINCT 'activity_to_place', last, 'sink' FROM ends
UNION ALL SELECT 'initial_marking', 'source', '1'
UNION ALL SELECT 'final_marking', 'sink', '1'"""

ORACLE: dict[str, str] = {
    "log_csv_scan": _sql(CSV, "SELECT * FROM text"),
    "log_time_parse": _sql(
        CSV,
        """SELECT user_session, CAST(product_id AS VARCHAR) AS product_id, event_time
FROM typed WHERE product_id % 10 <> 3""",
    ),
    "log_fill_defaults": _sql(
        SHOP, "SELECT brand, category_code, count(*) AS rows FROM log GROUP BY ALL"
    ),
    "log_try_cast": _sql(
        CSV, "SELECT user_session, CAST(product_id AS VARCHAR) AS product_id, category_id FROM typed"
    ),
    "log_canonical": _sql(CSV, "SELECT * FROM typed WHERE product_id % 10 <> 3"),
    "log_normalized": _sql(
        SHOP,
        """SELECT event_id, event_time AS "time:timestamp", event_type AS "concept:name", user_id,
       user_session AS "case:concept:name" FROM log""",
    ),
    "sanitize_numeric": _sql(
        SHOP,
        """SELECT event_id, CASE WHEN product_id % 10 IN (1, 2, 3) THEN 0.0 ELSE price END AS price,
       CASE WHEN product_id % 10 IN (1, 2, 3) THEN 0.0 ELSE price END AS pair_first,
       CAST(1.5 AS DOUBLE) AS pair_second FROM log""",
    ),
    "sample_sessions": _sql(
        SHOP
        + """,
total AS (SELECT count(*) AS r, count(DISTINCT user_session) AS s FROM log),
chosen AS (
  SELECT user_session FROM (SELECT DISTINCT user_session FROM log)
  ORDER BY md5('42:' || user_session), user_session
  LIMIT (SELECT greatest(1, CAST(floor(s * (CAST(floor(r * 0.25) AS DOUBLE) / r)) AS BIGINT)) FROM total))""",
        "SELECT event_id, user_session FROM log WHERE user_session IN (SELECT user_session FROM chosen)",
    ),
    "distinct_cases": _sql(SHOP, "SELECT DISTINCT user_session AS case_id FROM log"),
    "event_log_preview": _sql(
        SHOP
        + """,
begun AS (SELECT *, min(event_time) OVER (PARTITION BY user_session) AS start FROM log)""",
        """SELECT row_number() OVER (ORDER BY start, user_session, event_time, event_id) AS row,
       event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, event_type, product_id,
       price, user_id, user_session, brand, category_code
FROM begun ORDER BY row LIMIT 1500""",
    ),
    "traces": _sql(STEPS, "SELECT user_session AS case_id, pos, event_type AS activity FROM steps"),
    "collapsed_log": _sql(
        STEPS,
        "SELECT user_session AS case_id, cpos AS pos, event_type AS activity, event_time FROM kept",
    ),
    "dfg_collapsed": _sql(
        STEPS,
        """SELECT prev AS src, event_type AS dst, count(*) AS weight FROM kept
WHERE prev IS NOT NULL GROUP BY ALL""",
    ),
    "dfg_raw": _sql(
        STEPS,
        """SELECT prev AS src, event_type AS dst, count(*) AS weight FROM steps
WHERE prev IS NOT NULL GROUP BY ALL""",
    ),
    "start_activities": _sql(
        STEPS, "SELECT event_type AS activity, count(*) AS cases FROM steps WHERE pos = 1 GROUP BY ALL"
    ),
    "end_activities": _sql(
        STEPS, "SELECT event_type AS activity, count(*) AS cases FROM steps WHERE pos = n GROUP BY ALL"
    ),
    "variants": _sql(
        PATHS,
        """SELECT any_value(variant_id) AS variant_id, path, any_value(steps) AS steps, count(*) AS cases,
       min(user_session) AS first_case FROM paths GROUP BY path""",
    ),
    "variants_raw": _sql(
        PATHS,
        """SELECT any_value(variant_id) AS variant_id, path, any_value(steps) AS steps, count(*) AS cases,
       min(user_session) AS first_case FROM raw_paths GROUP BY path""",
    ),
    "variant_steps": _sql(
        PATHS,
        """SELECT DISTINCT p.variant_id, k.cpos AS pos, k.event_type AS activity
FROM paths p JOIN kept k USING (user_session)""",
    ),
    "path_tree": _sql(
        STEPS,
        f"""SELECT any_value(node) AS node, any_value(parent) AS parent, pos, any_value(activity) AS activity,
       count(*) AS cases, min(user_session) AS first_case
FROM (
  SELECT *, string_agg(activity, ' -> ') OVER w AS path,
         concat_ws('-', pos, {", ".join(f"hex((sum(d{k}) OVER w)::bigint)" for k in range(3))}) AS node,
         CASE WHEN pos > 1 THEN
           concat_ws('-', pos - 1, {", ".join(f"hex((sum(d{k}) OVER w)::bigint - d{k})" for k in range(3))}) END AS parent
  FROM (
    SELECT user_session, cpos AS pos, event_type AS activity,
           {", ".join(f"CAST('0x' || substr(md5(cpos || '|' || event_type), {8 * k + 1}, 8) AS BIGINT) & 2147483647 AS d{k}" for k in range(3))}
    FROM kept)
  WINDOW w AS (PARTITION BY user_session ORDER BY pos))
GROUP BY pos, path""",
    ),
    "top_paths": _sql(
        PATHS,
        """SELECT row_number() OVER (ORDER BY cases DESC, first_case) AS rank, path, cases, first_case
FROM (SELECT path, count(*) AS cases, min(user_session) AS first_case FROM paths GROUP BY path)
ORDER BY rank LIMIT 5""",
    ),
    "activity_share": _sql(
        SHOP,
        """SELECT event_type AS activity, count(*) AS events,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM log) AS share
FROM log GROUP BY event_type ORDER BY events DESC, activity LIMIT 10""",
    ),
    "important_steps": _sql(
        SHOP,
        """SELECT event_type AS activity, count(*) AS events,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM log) AS share
FROM log GROUP BY event_type ORDER BY events DESC, activity LIMIT 3""",
    ),
    "next_activity_pairs": _sql(
        CONTEXTS
        + """,
vocab AS (
  SELECT event_type AS a, row_number() OVER (ORDER BY event_type) AS id
  FROM (SELECT DISTINCT event_type FROM log)),
coded AS (
  SELECT l.user_session, l.event_time, l.event_id, v.id,
         list(v.id) OVER (PARTITION BY l.user_session ORDER BY l.event_time, l.event_id
                          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS x
  FROM log l JOIN vocab v ON v.a = l.event_type)""",
        """SELECT user_session AS case_id,
       repeat('0,', CAST(20 - len(x) AS BIGINT)) || array_to_string(x, ',') AS x, id AS y
FROM coded WHERE len(x) > 0""",
    ),
    "activity_vocab": _sql(
        SHOP,
        """SELECT event_type AS activity, row_number() OVER (ORDER BY event_type) - 1 AS id
FROM (SELECT DISTINCT event_type FROM log)""",
    ),
    "graph_nodes": _sql(
        GRAPH,
        """SELECT src AS activity FROM edges WHERE src <> dst
UNION SELECT dst FROM edges WHERE src <> dst""",
    ),
    "betweenness": _sql(GRAPH, "SELECT activity, round(betweenness, 6) AS betweenness FROM scored"),
    "bottlenecks": _sql(
        GRAPH
        + """,
seen AS (
  SELECT a, min(spot) AS spot FROM (
    SELECT src AS a, (first, 0) AS spot FROM kept UNION ALL SELECT dst, (first, 1) FROM kept)
  GROUP BY a)""",
        """SELECT row_number() OVER (ORDER BY round(c.betweenness, 9) DESC, s.spot) AS rank, c.activity,
       round(c.betweenness, 6) AS betweenness
FROM scored c JOIN seen s ON s.a = c.activity ORDER BY rank LIMIT 10""",
    ),
    "footprint": _sql(DIALOGUE, "SELECT a, b, relation FROM relation"),
    "alpha_places": _sql(
        PLACES,
        """SELECT place, array_to_string(ins, ',') AS inputs, array_to_string(outs, ',') AS outputs
FROM places
UNION ALL SELECT 'source', '', string_agg(DISTINCT first, ',' ORDER BY first) FROM ends
UNION ALL SELECT 'sink', string_agg(DISTINCT last, ',' ORDER BY last), '' FROM ends""",
    ),
    "petri_arcs": _sql(PLACES, ARCS),
    "kpis": _sql(
        SHOP,
        f"""SELECT count(*) AS rows, count(DISTINCT user_session) AS sessions,
       count(DISTINCT user_id) AS users,
       count(DISTINCT user_session) FILTER (WHERE {BUYS}) AS purchase_sessions,
       count(DISTINCT product_id) AS products, count(DISTINCT category_code) AS categories,
       count(DISTINCT brand) AS brands, count(DISTINCT event_type) AS event_types FROM log""",
    ),
    "metrics": _sql(
        f"{CATEGORY},\n{LOYALTY},\n{REMOVED},\n{WINDOW_RATE}",
        f"""SELECT (SELECT round(coalesce(avg(purchase_rate), 0.0), 6) FROM ({PURCHASE_RATE})) AS purchase_rate_avg,
       (SELECT round(coalesce(avg(abandonment_rate), 0.0), 6) FROM ({ABANDONMENT})) AS abandonment_rate_avg,
       (SELECT round({_percent('window_sessions', 'sessions')}, 6) FROM shoppers) AS window_shopper_rate,
       (SELECT round(100.0 * (SELECT count(*) FROM removed) / greatest(1, count(*)), 6) FROM log
        WHERE event_type = 'remove_from_cart') AS remove_cart_purchase_rate,
       round(returning_rate, 6) AS returning_rate, round(loyal_rate, 6) AS loyal_rate FROM loyal""",
    ),
    "session_price_dist": _bins("TRUE"),
    "purchase_price_dist": _bins(BUYS),
    "session_heatmap": _heatmap("TRUE"),
    "purchase_heatmap": _heatmap(BUYS),
    "session_price_hour": _sql(
        SHOP,
        f"""SELECT {BIN} AS price_bin, hour(event_time) AS hour,
       count(DISTINCT user_session) AS session_count
FROM log WHERE {BIN} <= 2000 GROUP BY ALL""",
    ),
    "session_hour_price": _segments("TRUE"),
    "purchase_hour_price": _segments(BUYS),
    "brand_compare": _sql(f"{SHOP},\n{BRANDS}", "SELECT * FROM rated"),
    "brand_compare_long": _sql(
        f"{SHOP},\n{BRANDS}",
        """SELECT brand, conversion_rate, 'sessions' AS type, sessions AS count FROM rated
UNION ALL SELECT brand, conversion_rate, 'purchase', purchase FROM rated""",
    ),
    "purchase_rate_by_category": _sql(CATEGORY, PURCHASE_RATE),
    "purchase_rate_top20": _sql(
        CATEGORY, f"{PURCHASE_RATE} ORDER BY total_sessions DESC, category LIMIT 20"
    ),
    "cart_abandonment": _sql(CATEGORY, ABANDONMENT),
    "cart_abandonment_top20": _sql(
        CATEGORY, f"{ABANDONMENT} ORDER BY abandonment_rate DESC, category LIMIT 20"
    ),
    "window_shoppers": _sql(CATEGORY, "SELECT user_session AS case_id FROM only_view"),
    "window_shopper_rate": _sql(
        f"{CATEGORY},\n{WINDOW_RATE}",
        f"""SELECT window_sessions, sessions,
       {_percent('window_sessions', 'sessions')} AS window_shopper_rate FROM shoppers""",
    ),
    "window_shopper_by_category": _sql(
        CATEGORY
        + """,
windowed AS (
  SELECT category_code AS category, count(DISTINCT user_session) AS n FROM log
  WHERE user_session IN (SELECT user_session FROM only_view) GROUP BY category_code)""",
        f"""SELECT c.category, viewed AS view_sessions, coalesce(w.n, 0) AS window_sessions,
       {_percent('coalesce(w.n, 0)', 'viewed')} AS window_rate
FROM cat c LEFT JOIN windowed w ON w.category = c.category WHERE viewed > 0
ORDER BY window_rate DESC, c.category LIMIT 20""",
    ),
    "user_loyalty": _sql(f"{SHOP},\n{LOYALTY}", "SELECT * FROM loyal"),
    "session_order": _sql(
        f"{SHOP},\n{STARTS}", "SELECT user_id, case_id, start, session_order FROM ordered"
    ),
    "daily_returning": _sql(
        f"{SHOP},\n{STARTS}",
        f"""SELECT CAST(start AS DATE) AS date,
       {_percent('count(*) FILTER (WHERE session_order > 1)', 'count(*)')} AS returning_rate
FROM ordered GROUP BY 1""",
    ),
    "remove_then_purchase": _sql(f"{SHOP},\n{REMOVED}", "SELECT case_id, date FROM removed"),
    "remove_purchase_rate": _sql(
        f"{SHOP},\n{REMOVED}",
        """SELECT (SELECT count(*) FROM removed) AS sessions, count(*) AS removals,
       100.0 * (SELECT count(*) FROM removed) / greatest(1, count(*)) AS remove_cart_purchase_rate
FROM log WHERE event_type = 'remove_from_cart'""",
    ),
    "remove_purchase_daily": _sql(
        f"{SHOP},\n{REMOVED}", "SELECT date, count(*) AS sessions FROM removed GROUP BY date"
    ),
    "outer_join_counts": _sql(
        SHOP,
        """SELECT category, coalesce(c, 0) AS cart_sessions, coalesce(p, 0) AS purchase_sessions FROM
 (SELECT category_code AS category, count(DISTINCT user_session) AS c FROM log
  WHERE event_type = 'cart' GROUP BY 1) FULL JOIN
 (SELECT category_code AS category, count(DISTINCT user_session) AS p FROM log
  WHERE event_type = 'purchase' GROUP BY 1) USING (category)""",
    ),
    "ngram_model": _sql(
        f"{CONTEXTS},{_model('pairs')}",
        "SELECT array_to_string(context, ',') AS context, length, next, n, prob FROM model",
    ),
    "predict_next": _sql(
        CONTEXTS
        + f""",{_model('pairs')},
tails AS (
  SELECT user_session AS seq_id, list(event_type ORDER BY event_time, event_id)[-20:] AS tail
  FROM log WHERE event_id % 7 <> 0 GROUP BY user_session),
tried AS (
  SELECT seq_id, tail, unnest(range(0, len(tail) + 1)) AS l FROM tails WHERE len(tail) > 0),
hits AS (
  SELECT t.seq_id, max(t.l) AS l, any_value(t.tail) AS tail FROM tried t
  WHERE EXISTS (SELECT 1 FROM model m WHERE m.context = t.tail[len(t.tail) - t.l + 1:])
  GROUP BY t.seq_id)""",
        """SELECT h.seq_id, r.rank, r.next AS activity, r.prob
FROM hits h JOIN ranked r ON r.context = h.tail[len(h.tail) - h.l + 1:] WHERE r.rank <= 3""",
    ),
    "unanswered": _sql(
        SHOP,
        """SELECT user_session AS seq_id, 'no known activity' AS reason FROM log
GROUP BY user_session HAVING bool_and(event_id % 7 = 0)""",
    ),
    "next_activity_accuracy": _sql(
        CONTEXTS
        + """,
held AS (
  SELECT context AS tail, next, count(*) AS n FROM pairs
  WHERE substr(md5(case_id), 1, 1) IN ('0', '1', '2') GROUP BY ALL),
train AS (SELECT * FROM pairs WHERE substr(md5(case_id), 1, 1) NOT IN ('0', '1', '2')),"""
        + _model("train")
        + """,
tried AS (
  SELECT tail, unnest(range(0, len(tail) + 1)) AS l FROM (SELECT DISTINCT tail FROM held)),
hits AS (
  SELECT t.tail, max(t.l) AS l FROM tried t
  WHERE EXISTS (SELECT 1 FROM model m WHERE m.context = t.tail[len(t.tail) - t.l + 1:])
  GROUP BY t.tail),
guess AS (
  SELECT h.tail, r.next AS guess FROM hits h
  JOIN ranked r ON r.context = h.tail[len(h.tail) - h.l + 1:] WHERE r.rank = 1)""",
        """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs,
       CAST(coalesce(sum(CASE WHEN guess = next THEN n ELSE 0 END), 0) AS BIGINT) AS hits,
       coalesce(sum(CASE WHEN guess = next THEN n ELSE 0 END)::DOUBLE / sum(n), 0.0) AS accuracy
FROM held LEFT JOIN guess USING (tail)""",
    ),
}


def _facts() -> str:
    """Section, rank, key and value of the report's facts, from the queries above."""
    graph = GRAPH.replace(
        "event_type || ':' || CAST(k // 5 AS VARCHAR) AS a",
        "CASE event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart' ELSE event_type END AS a",
    )
    bottlenecks = ORACLE["bottlenecks"].replace(GRAPH, graph).replace("LIMIT 10", "LIMIT 3")
    unpivot = (
        "SELECT '{0}' AS section, row_number() OVER () AS rank, name AS key, round(v, 6) AS value "
        "FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM ({1})) ON COLUMNS(*) INTO NAME name VALUE v)"
    )
    return "\nUNION ALL\n".join(
        [
            "SELECT 'important_steps' AS section, row_number() OVER (ORDER BY events DESC, activity) AS rank, "
            f"activity AS key, round(share, 6) AS value FROM ({ORACLE['important_steps']})",
            f"SELECT 'bottlenecks', rank, activity, round(betweenness, 6) FROM ({bottlenecks})",
            f"SELECT 'top_paths', rank, path, cases::DOUBLE FROM ({ORACLE['top_paths']})",
            unpivot.format("kpis", ORACLE["kpis"]),
            unpivot.format("metrics", ORACLE["metrics"]),
        ]
    )


ORACLE["insight_context"] = _facts()
ORACLE["report_json"] = (
    _facts()
    + f"""
UNION ALL SELECT 'sizes', 1, 'sample_size_used', count(*)::DOUBLE FROM events
UNION ALL SELECT 'sizes', 2, 'event_log', count(*)::DOUBLE FROM ({ORACLE['event_log_preview']})"""
)
ORACLE["classifier_suggestions"] = _sql(
    SHOP,
    """SELECT user_session AS seq_id, 3::INTEGER AS suggestions, 3::INTEGER AS activities, true AS in_order
FROM log WHERE event_id % 7 <> 0 GROUP BY user_session""",
)


def _long(table: str, query: str, keys: tuple[str, ...] = ()) -> str:
    key = " || ".join(["''", *[f"'/' || {k}::VARCHAR" for k in keys]])
    left_out = f"* EXCLUDE ({', '.join(keys)})" if keys else "*"
    return f"""
SELECT '{table}' AS "table", key, name AS measure, round(value, 6) AS value FROM (
  UNPIVOT (SELECT {key} AS key, COLUMNS({left_out})::DOUBLE FROM ({ORACLE[query]}))
  ON COLUMNS(* EXCLUDE (key)) INTO NAME name VALUE value)"""


ORACLE["dashboard_facts"] = "\nUNION ALL".join(
    [
        _long("kpis", "kpis"),
        _long("metrics", "metrics"),
        _long("brand_compare", "brand_compare", ("brand",)),
        _long("purchase_rate", "purchase_rate_top20", ("category",)),
        _long("abandonment_rate", "cart_abandonment_top20", ("category",)),
        _long("window_shopper", "window_shopper_by_category", ("category",)),
        _long("loyal_returning", "daily_returning", ("date",)),
        _long("remove_purchase", "remove_purchase_daily", ("date",)),
        *[
            _long(f"{who}_{name}", f"{who}_{name}", keys)
            for who in ("session", "purchase")
            for name, keys in (
                ("price_dist", ("price_label",)),
                ("heatmap", ("price_bin",)),
                ("hour_price", ("hour", "segment")),
            )
        ],
    ]
)

# Exact counts: the sketches are exact while a week has fewer values than one holds.
ORACLE["kpis_sketched"] = _sql(
    SHOP,
    f"""SELECT CAST(date_trunc('week', event_time) AS DATE) AS week, count(*) AS rows,
       count(DISTINCT user_session) AS sessions, count(DISTINCT user_id) AS users,
       count(DISTINCT user_session) FILTER (WHERE {BUYS}) AS purchase_sessions,
       count(DISTINCT product_id) AS products, count(DISTINCT category_code) AS categories,
       count(DISTINCT brand) AS brands, count(DISTINCT event_type) AS event_types FROM log GROUP BY 1""",
)

# Names here have single spaces, so a line ends at the last one that fits, or in the middle of a word
# that no line can hold.
ORACLE["wrapped_labels"] = f"""
WITH RECURSIVE {PATHS},
names AS (
  SELECT DISTINCT 'activity' AS kind, event_type AS name, 15 AS width FROM log
  UNION SELECT 'brand', brand, 15 FROM log
  UNION SELECT 'category', category_code, 15 FROM log
  UNION SELECT 'path', path, 40 FROM paths),
folded AS (
  SELECT kind, name, width, name AS rest, CAST('' AS VARCHAR) AS label FROM names
  UNION ALL
  SELECT kind, name, width, ltrim(substr(rest, taken + 1)), label || chr(10) || rtrim(left(rest, taken)) FROM (
    SELECT *, CASE WHEN length(rest) <= width THEN length(rest)
                   WHEN length(regexp_extract(substr(rest, head + 1), '^[^ ]*')) > width THEN width
                   ELSE head END AS taken
    FROM (SELECT *, length(regexp_extract(left(rest, width + 1), '^(.* )?', 0)) AS head
          FROM folded WHERE rest <> '')))
SELECT kind, name, substr(label, 2) AS label FROM folded WHERE rest = ''"""
