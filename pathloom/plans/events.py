"""Queries on events: parsing, enriching, windows, sessions, funnels, features, trends and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.model import WindowSettings
from pathloom.operators import events as E
from pathloom.operators import metrics as M
from pathloom.operators import sessions as S
from pathloom.plans.registry import query, rounded
from pathloom.sources import testdata as D

RAW = """e AS (SELECT event_id, ts AS event_timestamp, CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type, value AS price,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, user_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS user_session FROM events)"""
FULL = f"""{RAW}, x AS (SELECT e.*, p_name AS product_name, p_brand AS brand, p_type AS category_name, lower(p_type || '.' || replace(p_brand, '#', '')) AS category_code,
  p_retailprice AS original_price, c_mktsegment AS user_segment, c_nationkey AS nation FROM e LEFT JOIN part ON p_partkey = product_id LEFT JOIN customer ON c_custkey = user_id)"""
MIXED = f"""{FULL}, m AS (SELECT * EXCLUDE (user_session), user_id || '-' || CASE user_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN strftime(date_trunc('week', event_timestamp), '%Y-%m-%d')
  WHEN 2 THEN strftime(event_timestamp, '%Y-%m-%d') ELSE strftime(event_timestamp, '%Y-%m-%d-%H') END AS user_session FROM x)"""


def when(kind: str) -> str:
    return f"CAST(count(*) FILTER (WHERE event_type = '{kind}') AS BIGINT)"


COUNTS = ", ".join(f"{when(t)} AS {t}_count" for t in ("view", "cart", "purchase"))
SECONDS = "(floor(epoch(max(event_timestamp))) - floor(epoch(min(event_timestamp))))"


def share(a: str, b: str, scale: int = 1) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} * {scale} ELSE 0.0 END"


BEHAVIOUR = f"""{MIXED}, b AS (
  SELECT *, CASE WHEN raw_duration = 0 THEN 0.1 ELSE raw_duration END AS session_duration_minutes FROM (
    SELECT user_id, user_session, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS total_events, {COUNTS},
      {when("remove_from_cart")} AS remove_cart_count, count(DISTINCT product_id) AS unique_products, count(DISTINCT category_code) AS unique_categories,
      sum(price) FILTER (WHERE event_type = 'purchase') AS total_amount, avg(price) FILTER (WHERE event_type = 'purchase') AS avg_purchase_price,
      avg(price) AS avg_product_price_viewed, {SECONDS} / 60.0 / 600.0 AS raw_duration
    FROM m GROUP BY user_id, user_session)
), c AS (
  SELECT * EXCLUDE (raw_duration), CASE
      WHEN total_events >= 30 AND session_duration_minutes >= 30 AND purchase_count >= 2 THEN 'power_user'
      WHEN total_events BETWEEN 10 AND 29 AND session_duration_minutes BETWEEN 10 AND 30 AND cart_count >= 2 AND purchase_count >= 1 THEN 'engaged_shopper'
      WHEN total_events BETWEEN 3 AND 10 AND session_duration_minutes BETWEEN 1 AND 10 AND cart_count >= 1 AND purchase_count = 0 THEN 'browser'
      WHEN total_events BETWEEN 1 AND 2 AND session_duration_minutes < 1 AND cart_count = 0 AND purchase_count = 0 THEN 'bouncer'
      ELSE 'unclassified' END AS behavior_segment FROM b
), s AS (
  SELECT *, CASE behavior_segment WHEN 'power_user' THEN 100 WHEN 'engaged_shopper' THEN 75 WHEN 'browser' THEN 50 WHEN 'bouncer' THEN 25 ELSE 0 END AS segment_score FROM c)"""


def behaviours(spark, d):
    return S.behaviour_metrics(D.mixed_sessions(D.enriched(spark, d)), minute=60.0 * 600.0)


def classified(spark, d):
    return S.classify(behaviours(spark, d))


@query("p1_parse_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_payload(spark, d):
    raw = D.table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    return E.parse_events(raw, E.T.StructType.fromDDL("k long"), ("event_id",))


@query("p2_valid_messages", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def valid_messages(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{bad")).otherwise(F.col("props"))
    raw = D.table(spark, d, "events").select("event_id", broken.alias("value"))
    return E.split_valid(raw, E.T.StructType.fromDDL("k long"), ("k",), ("event_id",))[0]


@query("p2_dead_letters", "SELECT event_id, '{bad' AS value, 'k' AS missing FROM events WHERE event_id % 7 = 0")
def dead_letters(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{bad")).otherwise(F.col("props"))
    raw = D.table(spark, d, "events").select("event_id", broken.alias("value"))
    return E.split_valid(raw, E.T.StructType.fromDDL("k long"), ("k",), ("event_id",))[1].withColumn("missing", F.array_join("missing", ","))


@query("p3_event_times", "SELECT event_id, date_trunc('second', ts) AS event_timestamp FROM events")
def event_times(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return D.table(spark, d, "events").select("event_id", E.X.parse_time(text).cast("timestamp_ntz").alias("event_timestamp"))


@query("p4_funnel_events", f"WITH {RAW} SELECT user_session, user_id, event_type, event_timestamp FROM e WHERE event_type IN ('view', 'cart', 'purchase')")
def funnel_events(spark, d):
    return E.funnel_events(D.raw_events(spark, d))


@query("p5_usable_events", f"WITH {RAW} SELECT * FROM e WHERE event_timestamp IS NOT NULL AND user_id IS NOT NULL AND event_id % 13 <> 6 AND event_id % 5 <> 2")
def usable_events(spark, d):
    """Some events without a time or a user; the test tables have none."""
    gap = lambda c, every, at: F.when(F.col("event_id") % every != at, F.col(c))
    return E.usable_events(D.raw_events(spark, d).withColumns({"event_timestamp": gap("event_timestamp", 13, 6), "user_id": gap("user_id", 5, 2)}))


@query(
    "p15_dated_events",
    f"WITH {RAW} SELECT *, CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS event_date, CASE WHEN price < 50 THEN 'Budget' WHEN price < 200 THEN 'Mid-Range' WHEN price < 500 THEN 'Premium' WHEN price IS NOT NULL THEN 'Luxury' END AS price_category, "
    "CAST(hour(event_timestamp) AS INTEGER) AS event_hour, dayofweek(event_timestamp) IN (0, 6) AS is_weekend FROM e",
)
def dated_events(spark, d):
    return rounded(E.derived_columns(E.with_date(D.raw_events(spark, d))))


@query("j1_events_with_products", f"WITH {FULL} SELECT * EXCLUDE (user_segment, nation) FROM x")
def events_with_products(spark, d):
    return E.with_products(D.raw_events(spark, d), D.products(spark, d))


@query("j2_enriched_events", f"WITH {FULL} SELECT * FROM x")
def enriched_events(spark, d):
    return D.enriched(spark, d)


WINDOWED = """SELECT {start} AS window_start, {start} + INTERVAL {minutes} MINUTE AS window_end, event_type, count(*) AS event_count, round(sum(price) + 1e-9, 6) AS gross_price_sum, round(avg(price) + 1e-9, 6) AS avg_price,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products, count(DISTINCT user_session) AS unique_sessions FROM {source} GROUP BY ALL"""


@query("a1_windowed_metrics", f"WITH {RAW} " + WINDOWED.format(start="time_bucket(INTERVAL 5 MINUTE, event_timestamp)", minutes=5, source="e"))
def windowed_metrics(spark, d):
    return rounded(M.flat_window(M.windowed_metrics(D.raw_events(spark, d))))


@query(
    "st3_sliding_metrics",
    f"WITH {RAW}, w AS (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, event_timestamp), time_bucket(INTERVAL 5 MINUTE, event_timestamp) - INTERVAL 5 MINUTE]) AS s FROM e) " + WINDOWED.format(start="s", minutes=10, source="w"),
)
def sliding_metrics(spark, d):
    return rounded(M.flat_window(M.windowed_metrics(D.raw_events(spark, d), WindowSettings("10 minutes", "5 minutes"))))


@query("a2_category_metrics", f"WITH {FULL} SELECT category_name, event_type, count(*) AS event_count, round(sum(price) + 1e-9, 6) AS gross_price_sum, round(avg(price) + 1e-9, 6) AS avg_price, count(DISTINCT user_id) AS unique_users FROM x GROUP BY ALL")
def category_metrics(spark, d):
    return rounded(M.category_metrics(D.enriched(spark, d)))


@query("a3_user_metrics", f"WITH {RAW} SELECT user_id, count(*) AS total_events, {COUNTS}, round(sum(price) + 1e-9, 6) AS gross_price_sum, round(avg(price) + 1e-9, 6) AS avg_price, count(DISTINCT product_id) AS unique_products FROM e GROUP BY user_id")
def user_metrics(spark, d):
    return rounded(M.user_metrics(D.raw_events(spark, d)))


@query(
    "a4_session_metrics",
    f"""WITH {FULL} SELECT user_id, user_session, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS total_events, {COUNTS}, round(sum(price) + 1e-9, 6) AS gross_price_sum,
    count(DISTINCT product_id) AS unique_products, count(DISTINCT category_name) AS unique_categories, round({SECONDS} / 60.0 + 1e-9, 6) AS session_duration_minutes,
    {when("cart")} > 0 AS converted_to_cart, {when("purchase")} > 0 AS converted_to_purchase FROM x GROUP BY user_id, user_session""",
)
def session_metrics(spark, d):
    return rounded(S.session_metrics(D.enriched(spark, d)))


ROUNDED = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("total_amount", "avg_purchase_price", "avg_product_price_viewed", "session_duration_minutes"))
PLAIN = "user_id, user_session, session_start, session_end, total_events, view_count, cart_count, purchase_count, remove_cart_count, unique_products, unique_categories"


@query("a5_behaviour_metrics", f"WITH {BEHAVIOUR} SELECT {PLAIN}, {ROUNDED} FROM b")
def behaviour_metrics(spark, d):
    return rounded(behaviours(spark, d))


@query(
    "c1_classified_sessions",
    f"""WITH {BEHAVIOUR} SELECT {PLAIN}, {ROUNDED}, behavior_segment, segment_score,
    CASE behavior_segment WHEN 'power_user' THEN '🔵' WHEN 'engaged_shopper' THEN '🟢' WHEN 'browser' THEN '🟡' WHEN 'bouncer' THEN '🔴' ELSE '⚪' END AS segment_color,
    round(total_events / session_duration_minutes + 1e-9, 6) AS engagement_rate, round({share("cart_count", "view_count", 100)} + 1e-9, 6) AS cart_conversion_rate,
    round({share("purchase_count", "cart_count", 100)} + 1e-9, 6) AS purchase_conversion_rate, round({share("purchase_count", "view_count", 100)} + 1e-9, 6) AS overall_conversion_rate FROM s""",
)
def classified_sessions(spark, d):
    return rounded(classified(spark, d))


LISTS = " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in S.ACTIONS.items())


@query(
    "c6_recommended_actions",
    f"""WITH {BEHAVIOUR} SELECT user_id, user_session, behavior_segment, CASE behavior_segment {LISTS} ELSE '' END AS recommendations,
    CASE behavior_segment WHEN 'power_user' THEN 1 WHEN 'browser' THEN 2 WHEN 'engaged_shopper' THEN 3 WHEN 'bouncer' THEN 4 ELSE 5 END AS action_priority FROM s""",
)
def recommended_actions(spark, d):
    return S.recommend_actions(classified(spark, d)).select("user_id", "user_session", "behavior_segment", F.array_join("recommendations", "; ").alias("recommendations"), "action_priority")


@query(
    "a6_global_funnel",
    f"""WITH {RAW}, f AS (SELECT {", ".join(f"count(DISTINCT user_session) FILTER (WHERE event_type = '{t}') AS sessions_with_{t}" for t in ("view", "cart", "purchase"))}, count(*) AS total_events FROM e)
    SELECT *, round(sessions_with_cart / nullif(sessions_with_view, 0) + 1e-9, 6) AS view_to_cart_rate, round(sessions_with_purchase / nullif(sessions_with_cart, 0) + 1e-9, 6) AS cart_to_purchase_rate,
    round(sessions_with_purchase / nullif(sessions_with_view, 0) + 1e-9, 6) AS overall_conversion_rate FROM f""",
)
def global_funnel(spark, d):
    return rounded(S.global_funnel(D.raw_events(spark, d)))


@query(
    "a7_segment_funnel",
    f"""WITH {BEHAVIOUR}, f AS (SELECT behavior_segment, count(*) AS total_sessions, count(DISTINCT user_id) AS unique_users, {", ".join(f"CAST(sum({t}_count) AS BIGINT) AS total_{t}s" for t in ("view", "cart", "purchase"))},
      avg(session_duration_minutes) AS d, sum(total_amount) AS r, avg(total_amount) AS a FROM s GROUP BY behavior_segment)
    SELECT behavior_segment, total_sessions, unique_users, total_views, total_carts, total_purchases, round(d + 1e-9, 6) AS avg_session_duration, round(r + 1e-9, 6) AS total_revenue, round(a + 1e-9, 6) AS avg_revenue_per_session,
      round({share("total_carts", "total_views", 100)} + 1e-9, 6) AS view_to_cart_rate, round({share("total_purchases", "total_carts", 100)} + 1e-9, 6) AS cart_to_purchase_rate,
      round({share("total_purchases", "total_views", 100)} + 1e-9, 6) AS overall_conversion_rate, round(CASE WHEN total_purchases > 0 THEN r / total_purchases ELSE 0.0 END + 1e-9, 6) AS avg_order_value FROM f""",
)
def segment_funnel(spark, d):
    return rounded(S.segment_funnel(classified(spark, d)))


@query(
    "a8_segment_distribution",
    f"""WITH {BEHAVIOUR} SELECT time_bucket(INTERVAL 5 MINUTE, session_start) AS window_start, time_bucket(INTERVAL 5 MINUTE, session_start) + INTERVAL 5 MINUTE AS window_end, behavior_segment, count(*) AS session_count,
    round(avg(segment_score) + 1e-9, 6) AS avg_score, round(avg(total_events) + 1e-9, 6) AS avg_events, round(avg(session_duration_minutes) + 1e-9, 6) AS avg_duration, round(sum(total_amount) + 1e-9, 6) AS total_revenue, count(DISTINCT user_id) AS unique_users
    FROM s GROUP BY ALL""",
)
def segment_distribution(spark, d):
    return rounded(S.segment_distribution(classified(spark, d)))


@query(
    "a9_journey_paths",
    f"WITH {RAW} SELECT user_session, string_agg(event_type, '>' ORDER BY event_timestamp, event_id) AS journey_path, CAST(count(*) AS INTEGER) AS path_length, bool_or(event_type = 'purchase') AS contains_purchase FROM e GROUP BY user_session",
)
def journey_paths(spark, d):
    return S.journey_paths(D.raw_events(spark, d)).withColumn("journey_path", F.array_join("journey_path", ">"))


@query("w4_numbered_events", f"WITH {RAW} SELECT event_id, user_session, CAST(row_number() OVER (PARTITION BY user_session ORDER BY event_timestamp, event_id) AS INTEGER) AS event_sequence FROM e")
def numbered_events(spark, d):
    return S.numbered_events(D.raw_events(spark, d)).select("event_id", "user_session", "event_sequence")


STEPS = f"""{RAW}, t AS (SELECT user_session, {", ".join(f"bool_or(event_type = '{t}') AS has_{t}" for t in ("view", "cart", "purchase"))} FROM e WHERE event_type IN ('view', 'cart', 'purchase') GROUP BY user_session),
  f AS (SELECT count(*) AS total_sessions, count(*) FILTER (WHERE has_view) AS sessions_with_view, count(*) FILTER (WHERE has_view AND has_cart) AS sessions_view_and_cart,
  count(*) FILTER (WHERE has_view AND has_cart AND has_purchase) AS sessions_view_cart_and_purchase FROM t)"""


@query("w5_session_steps", f"WITH {STEPS} SELECT * FROM t")
def session_steps(spark, d):
    return S.session_steps(E.funnel_events(D.raw_events(spark, d)))


@query("a22_strict_funnel", f"WITH {STEPS} SELECT * FROM f")
def strict_funnel(spark, d):
    return S.strict_funnel(session_steps(spark, d))


RATES = f"{STEPS}, r AS (SELECT *, {share('sessions_view_and_cart', 'sessions_with_view', 100)} AS a, {share('sessions_view_cart_and_purchase', 'sessions_view_and_cart', 100)} AS b FROM f)"
VALUES = {m: f"CAST({m} AS DOUBLE)" for m in list(S.FUNNEL_TEXTS)[:4]} | {"rate_view_to_cart_percent": "round(a, 2)", "rate_cart_to_purchase_percent": "round(b, 2)", "dropoff_at_view_percent": "round(100 - a, 2)", "dropoff_at_cart_percent": "round(100 - b, 2)"}


@query("funnel_metrics", f"WITH {RATES} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value, '{S.FUNNEL_TEXTS[m]}' AS description FROM r WHERE total_sessions > 0" for m, v in VALUES.items()))
def funnel_metrics(spark, d):
    return S.funnel_metrics(strict_funnel(spark, d))


def featured(spark, d):
    from pathloom.model import FeatureSettings

    return M.user_features(E.derived_columns(D.enriched(spark, d)), FeatureSettings("2024-01-31"))


FEATURES = f"""{FULL}, g AS (SELECT user_id, count(*) AS total_events, count(DISTINCT user_session) AS total_sessions, count(DISTINCT product_id) AS unique_products_viewed, count(DISTINCT category_name) AS unique_categories,
    count(DISTINCT brand) AS unique_brands, {COUNTS}, sum(CASE WHEN event_type = 'purchase' THEN price ELSE 0.0 END) AS total_spent, avg(price) FILTER (WHERE event_type = 'purchase') AS avg_purchase_value,
    max(price) FILTER (WHERE event_type = 'purchase') AS max_purchase, count(*) FILTER (WHERE price < 50) AS budget_interactions, count(*) FILTER (WHERE price >= 50 AND price < 200) AS midrange_interactions,
    count(*) FILTER (WHERE price >= 200 AND price < 500) AS premium_interactions, count(*) FILTER (WHERE price >= 500) AS luxury_interactions, min(event_timestamp) AS first_event_date, max(event_timestamp) AS last_event_date,
    avg(price) AS avg_price_browsed, stddev_samp(price) AS price_stddev, avg(hour(event_timestamp)) AS avg_hour_of_day, count(*) FILTER (WHERE dayofweek(event_timestamp) IN (0, 6)) AS weekend_events FROM x GROUP BY user_id),
  h AS (SELECT *, CAST(date_diff('day', CAST(first_event_date AS DATE), CAST(last_event_date AS DATE)) + 1 AS INTEGER) AS days_active, total_events / total_sessions AS avg_events_per_session,
    {share("cart_count", "view_count")} AS view_to_cart_ratio, {share("purchase_count", "cart_count")} AS cart_to_purchase_ratio, {share("purchase_count", "total_events")} AS overall_conversion_rate, {share("weekend_events", "total_events")} AS weekend_ratio,
    CAST(date_diff('day', CAST(last_event_date AS DATE), DATE '2024-01-31') AS INTEGER) AS recency_days FROM g),
  u AS (SELECT * EXCLUDE (avg_purchase_value, max_purchase, price_stddev), coalesce(avg_purchase_value, 0) AS avg_purchase_value, coalesce(max_purchase, 0) AS max_purchase, coalesce(price_stddev, 0) AS price_stddev,
    CAST(recency_days > 7 AS INTEGER) AS is_churned, total_spent * 0.5 + purchase_count * 10 + total_sessions * 2 AS customer_value_score FROM h)"""
DOUBLES = ["total_spent", "avg_purchase_value", "max_purchase", "avg_price_browsed", "price_stddev", "avg_hour_of_day", "avg_events_per_session", "view_to_cart_ratio", "cart_to_purchase_ratio", "overall_conversion_rate", "weekend_ratio", "customer_value_score"]


@query("a10_user_features", f"WITH {FEATURES} SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in DOUBLES)}) FROM u")
def user_features(spark, d):
    return rounded(featured(spark, d))


DAILY = f"""{RAW}, dd AS (SELECT CAST(event_timestamp AS DATE) AS date, event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, count(DISTINCT user_session) AS unique_sessions,
  sum(CASE WHEN event_type = 'purchase' THEN price ELSE 0.0 END) AS revenue FROM e GROUP BY ALL)"""
TRENDS = f"""{DAILY}, tt AS (SELECT *, avg(event_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7day_events, avg(event_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma_3day_events,
  avg(unique_users) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7day_users, lag(event_count) OVER w AS prev_day_events FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY date)),
  gg AS (SELECT *, CASE WHEN prev_day_events > 0 THEN (event_count - prev_day_events) / prev_day_events * 100 ELSE 0.0 END AS day_over_day_growth FROM tt)"""
TREND_ROUNDS = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("revenue", "ma_7day_events", "ma_3day_events", "ma_7day_users", "day_over_day_growth"))


def trends(spark, d):
    return M.daily_trends(M.daily_metrics(D.raw_events(spark, d)))


@query("a13_daily_metrics", f"WITH {DAILY} SELECT * REPLACE (round(revenue + 1e-9, 6) AS revenue, CAST(date AS VARCHAR) AS date) FROM dd")
def daily_metrics(spark, d):
    return rounded(M.daily_metrics(D.raw_events(spark, d)))


@query("w6_daily_trends", f"WITH {TRENDS} SELECT * REPLACE ({TREND_ROUNDS}, CAST(date AS VARCHAR) AS date) FROM gg")
def daily_trends(spark, d):
    return rounded(trends(spark, d))


@query(
    "a14_category_statistics",
    f"""WITH {FULL} SELECT category_name, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, round(avg(price) + 1e-9, 6) AS avg_price, round(stddev_samp(price) + 1e-9, 6) AS stddev_price,
    round(quantile_disc(price, 0.5) + 1e-9, 6) AS median_price, round(quantile_disc(price, 0.95) + 1e-9, 6) AS p95_price FROM x GROUP BY category_name""",
)
def category_statistics(spark, d):
    return rounded(M.category_statistics(D.enriched(spark, d)))


@query(
    "a15_price_summary",
    f"""WITH {RAW} SELECT count(price) AS count, round(avg(price) + 1e-9, 6) AS mean, round(stddev_samp(price) + 1e-9, 6) AS stddev, round(min(price) + 1e-9, 6) AS min, round(quantile_disc(price, 0.25) + 1e-9, 6) AS p25,
    round(quantile_disc(price, 0.5) + 1e-9, 6) AS p50, round(quantile_disc(price, 0.75) + 1e-9, 6) AS p75, round(max(price) + 1e-9, 6) AS max FROM e""",
)
def price_summary(spark, d):
    return rounded(M.price_summary(D.raw_events(spark, d)))


PAIRS = {"price": "price", "event_hour": "hour(event_timestamp)", "is_purchase": "CAST(event_type = 'purchase' AS INTEGER)", "is_weekend": "CAST(dayofweek(event_timestamp) IN (0, 6) AS INTEGER)"}


@query("a16_correlations", f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({x}, {y}) + 1e-9, 6) AS correlation FROM e WHERE price IS NOT NULL" for a, x in PAIRS.items() for b, y in PAIRS.items()))
def correlations(spark, d):
    return rounded(M.correlations(E.derived_columns(D.raw_events(spark, d))))


@query("p13_complete_rows", f"WITH {RAW} SELECT event_id, price, product_id, user_id FROM e WHERE price IS NOT NULL AND product_id IS NOT NULL AND user_id IS NOT NULL AND event_id % 5 <> 2 AND event_id % 9 <> 4")
def complete_rows(spark, d):
    """Some rows without a price or a user; the test tables have none."""
    gap = lambda c, every, at: F.when(F.col("event_id") % every != at, F.col(c)).alias(c)
    return D.raw_events(spark, d).select("event_id", gap("price", 5, 2), "product_id", gap("user_id", 9, 4)).dropna()


@query("a24_cardinalities", f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count FROM e" for c in ("user_id", "user_session", "product_id")))
def cardinalities(spark, d):
    return M.cardinalities(D.raw_events(spark, d), ["user_id", "user_session", "product_id"])


@query("u2_distinct_sessions", f"WITH {RAW} SELECT DISTINCT user_id, user_session FROM e")
def distinct_sessions(spark, d):
    return D.raw_events(spark, d).select("user_id", "user_session").distinct()


@query("q13_segment_report", f"WITH {BEHAVIOUR} SELECT behavior_segment, count(*) AS session_count, round(avg(segment_score) + 1e-9, 6) AS avg_score, repeat('█', CAST(floor(count(*) / 10) AS BIGINT)) AS bar FROM s GROUP BY behavior_segment")
def segment_report(spark, d):
    return rounded(S.segment_report(classified(spark, d)))


@query("q14_revenue_by_segment", f"WITH {BEHAVIOUR} SELECT behavior_segment, round(sum(coalesce(total_amount, 0)) + 1e-9, 6) AS total_revenue, round(avg(coalesce(total_amount, 0)) + 1e-9, 6) AS avg_revenue, count(*) AS session_count FROM s GROUP BY behavior_segment")
def revenue_by_segment(spark, d):
    return rounded(S.revenue_by_segment(classified(spark, d)))


@query("q15_recent_sessions", f"WITH {BEHAVIOUR} SELECT user_id, user_session, session_start, behavior_segment, segment_score FROM s ORDER BY session_start DESC, user_id, user_session LIMIT 10")
def recent_sessions(spark, d):
    return S.recent_sessions(classified(spark, d)).select("user_id", "user_session", "session_start", "behavior_segment", "segment_score")


@query(
    "q15_segment_summary",
    f"WITH {BEHAVIOUR} SELECT behavior_segment AS scope, count(*) AS session_count, round(avg(segment_score) + 1e-9, 6) AS avg_score FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(segment_score) + 1e-9, 6) FROM s",
)
def segment_summary(spark, d):
    return rounded(S.segment_summary(classified(spark, d)))
