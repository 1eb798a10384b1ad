"""Read queries over results."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from pathloom.operators import metrics as M
from pathloom.operators import serving as Q
from pathloom.operators.learning import SEGMENT_NAMES
from pathloom.plans import events as P
from pathloom.plans.recommend import catalog
from pathloom.plans.registry import SQL, query, rounded
from pathloom.sources import testdata as D

RUNS = (datetime.datetime(2024, 2, 1), datetime.datetime(2024, 2, 2))


def metric_runs(spark, d):
    """Two runs of the funnel's metrics, a day apart."""
    one = P.funnel_metrics(spark, d)
    return one.crossJoin(spark.createDataFrame([(t,) for t in RUNS], "analysis_timestamp timestamp_ntz"))


def value_segments(spark, d):
    """Users by value with names, a rule in place of the clusters so that SQL can repeat it."""
    name = F.when(F.col("purchase_count") >= 16, "Champions").when(F.col("purchase_count") >= 12, "Potential Loyalists").when(F.col("purchase_count") >= 8, "At Risk").otherwise(SEGMENT_NAMES[3])
    return P.featured(spark, d).withColumn("segment_name", name).select("user_id", "segment_name", "customer_value_score", "total_spent", "purchase_count")


SEGMENTS = f"""{P.FEATURES}, sg AS (SELECT user_id, CASE WHEN purchase_count >= 16 THEN 'Champions' WHEN purchase_count >= 12 THEN 'Potential Loyalists' WHEN purchase_count >= 8 THEN 'At Risk' ELSE 'New/Low Engagement' END AS segment_name,
  total_spent, purchase_count, customer_value_score FROM u)"""


def churn_table(spark, d):
    return P.featured(spark, d).select("user_id", F.col("is_churned"), (F.col("total_events") < 65).cast("double").alias("churn_prediction"), "total_spent", "purchase_count")


CHURN = f"{P.FEATURES}, ch AS (SELECT user_id, is_churned, CAST(total_events < 65 AS DOUBLE) AS churn_prediction, total_spent, purchase_count FROM u)"


@query("q1_overview", "SELECT 'events' AS table_name, count(*) AS row_count FROM events UNION ALL SELECT 'users', count(*) FROM customer UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def overview(spark, d):
    names = {"events": "events", "users": "customer", "products": "part", "orders": "orders"}
    return Q.overview({n: D.table(spark, d, t) for n, t in names.items()})


@query("q2_latest_metrics", f"SELECT *, TIMESTAMP '2024-02-02' AS analysis_timestamp FROM ({SQL['funnel_metrics']})")
def latest_metrics(spark, d):
    return Q.latest_metrics(metric_runs(spark, d))


@query(
    "q3_segment_overview",
    f"WITH {SEGMENTS} SELECT segment_name, count(*) AS user_count, round(sum(total_spent) + 1e-9, 6) AS total_revenue, round(avg(total_spent) + 1e-9, 6) AS avg_spent, round(avg(purchase_count) + 1e-9, 6) AS avg_purchases, round(avg(customer_value_score) + 1e-9, 6) AS avg_value_score FROM sg GROUP BY segment_name",
)
def segment_overview(spark, d):
    return rounded(Q.segment_overview(value_segments(spark, d)))


@query("q3_top_spenders", f"WITH {SEGMENTS} SELECT user_id, segment_name, round(total_spent + 1e-9, 6) AS total_spent, purchase_count FROM (SELECT * FROM sg ORDER BY total_spent DESC, user_id LIMIT 20)")
def top_spenders(spark, d):
    return rounded(Q.top_spenders(value_segments(spark, d)))


@query("a12_segment_profile", f"WITH {SEGMENTS} SELECT segment_name, count(*) AS user_count, round(avg(sg.total_spent) + 1e-9, 6) AS avg_revenue, round(avg(sg.purchase_count) + 1e-9, 6) AS avg_purchases, round(avg(overall_conversion_rate) + 1e-9, 6) AS avg_conversion_rate, round(avg(sg.customer_value_score) + 1e-9, 6) AS avg_value_score FROM sg JOIN u USING (user_id) GROUP BY segment_name")
def segment_profile(spark, d):
    rate = P.featured(spark, d).select("user_id", "overall_conversion_rate")
    return rounded(M.segment_profile(value_segments(spark, d).join(rate, "user_id"), "segment_name"))


@query("q4_at_risk", f"WITH {CHURN} SELECT user_id, is_churned, churn_prediction, round(total_spent + 1e-9, 6) AS total_spent, purchase_count FROM (SELECT * FROM ch WHERE churn_prediction = 1 ORDER BY total_spent DESC, user_id LIMIT 50)")
def at_risk(spark, d):
    return rounded(Q.at_risk(churn_table(spark, d)))


@query("q4_churn_rate", f"WITH {CHURN}, n AS (SELECT count(*) AS total_users, count(*) FILTER (WHERE churn_prediction = 1) AS predicted_churn FROM ch) SELECT *, coalesce(round(predicted_churn / nullif(total_users, 0) * 100, 2), 0) AS churn_rate FROM n")
def churn_rate(spark, d):
    return Q.churn_rate(churn_table(spark, d))


@query("q5_recent_trends", f"WITH {P.TRENDS} SELECT CAST(date AS VARCHAR) AS date, event_type, event_count, unique_users, round(revenue + 1e-9, 6) AS revenue, round(ma_7day_events + 1e-9, 6) AS ma_7day_events, round(day_over_day_growth + 1e-9, 6) AS day_over_day_growth FROM (SELECT * FROM gg ORDER BY date DESC, event_type LIMIT 100)")
def recent_trends(spark, d):
    return rounded(Q.recent_trends(P.trends(spark, d)))


@query(
    "q6_user_profiles",
    f"""WITH {CHURN}, sg AS (SELECT user_id, CASE WHEN purchase_count >= 16 THEN 'Champions' WHEN purchase_count >= 12 THEN 'Potential Loyalists' WHEN purchase_count >= 8 THEN 'At Risk' ELSE 'New/Low Engagement' END AS segment_name FROM u)
    SELECT c_custkey AS user_id, total_events, segment_name, churn_prediction FROM customer LEFT JOIN u ON u.user_id = c_custkey LEFT JOIN sg ON sg.user_id = c_custkey LEFT JOIN ch ON ch.user_id = c_custkey WHERE c_custkey % 5 = 0""",
)
def user_profiles(spark, d):
    asked = D.users(spark, d).filter("user_id % 5 = 0").select("user_id")
    return Q.user_profile(asked, P.featured(spark, d).select("user_id", "total_events"), value_segments(spark, d).select("user_id", "segment_name"), churn_table(spark, d).select("user_id", "churn_prediction"))


@query("q7_product", "SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS price FROM part WHERE p_partkey = 7")
def product(spark, d):
    return Q.product(catalog(spark, d), "7").select("product_id", "product_name", "price")


@query("q9_product_page", "SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS price, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_partkey LIMIT 20 OFFSET 20")
def product_page(spark, d):
    return Q.product_page(catalog(spark, d).select("product_id", "product_name", "price"), 20, 20)


@query("q16_collection_counts", "SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier")
def collection_counts(spark, d):
    return M.table_counts({t: D.table(spark, d, t) for t in ("lineitem", "supplier")})


@query(
    "q17_trend_summary",
    f"WITH {P.TRENDS} SELECT event_type, CAST(sum(event_count) AS BIGINT) AS total_events, round(avg(event_count)) AS mean_events, CAST(arg_max(date, (event_count, -epoch(date))) AS VARCHAR) AS peak_day, round(avg(nullif(day_over_day_growth, 0)) + 1e-9, 6) AS mean_growth, max(event_count) AS peak_events FROM gg GROUP BY event_type",
)
def trend_summary(spark, d):
    return rounded(Q.trend_summary(P.trends(spark, d)))


@query("q17_scaled_bars", f"WITH {P.STEPS} SELECT user_id, n, round(n / max(n) OVER () * 100, 1) AS bar FROM (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)")
def scaled_bars(spark, d):
    return Q.scaled_bars(D.raw_events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("q18_display_price", "SELECT p_partkey AS product_id, round(p_retailprice * 1.2, 2) AS shown_before, '-17%' AS shown_cut FROM part")
def display_price(spark, d):
    return Q.display_price(catalog(spark, d).select("product_id", "price")).drop("price")
