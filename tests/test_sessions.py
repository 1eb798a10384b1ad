"""Boundaries of the classifier, rates without denominators, journeys."""

import datetime

import pytest
from pyspark.sql import functions as F

from pathloom.operators import sessions as S

COLUMNS = "user_id long, user_session string, total_events long, view_count long, cart_count long, purchase_count long, session_duration_minutes double, total_amount double, session_start timestamp_ntz"
START = datetime.datetime(2024, 1, 1, 10, 2)


def rows(spark, cases):
    return spark.createDataFrame([(k, f"s{k}", e, v, c, p, d, a, START) for k, (e, v, c, p, d, a) in enumerate(cases)], COLUMNS)


@pytest.mark.parametrize(
    "events, minutes, carts, purchases, segment",
    [
        (30, 30.0, 0, 2, "power_user"),
        (29, 30.0, 0, 2, "unclassified"),
        (30, 29.99, 2, 2, "unclassified"),
        (30, 30.0, 5, 1, "unclassified"),
        (31, 30.01, 0, 3, "power_user"),
        (29, 30.0, 2, 1, "engaged_shopper"),
        (10, 10.0, 2, 1, "engaged_shopper"),
        (9, 10.0, 2, 1, "unclassified"),
        (10, 9.99, 2, 1, "unclassified"),
        (20, 30.01, 2, 1, "unclassified"),
        (20, 20.0, 1, 1, "unclassified"),
        (20, 20.0, 2, 0, "unclassified"),
        (3, 1.0, 1, 0, "browser"),
        (10, 10.0, 1, 0, "browser"),
        (11, 10.0, 1, 0, "unclassified"),
        (2, 1.0, 1, 0, "unclassified"),
        (3, 0.99, 1, 0, "unclassified"),
        (3, 10.01, 1, 0, "unclassified"),
        (3, 5.0, 0, 0, "unclassified"),
        (3, 5.0, 1, 1, "unclassified"),
        (1, 0.1, 0, 0, "bouncer"),
        (2, 0.99, 0, 0, "bouncer"),
        (2, 1.0, 0, 0, "unclassified"),
        (2, 0.5, 1, 0, "unclassified"),
        (2, 0.5, 0, 1, "unclassified"),
        (0, 0.5, 0, 0, "unclassified"),
        (2, None, 0, 0, "unclassified"),
        (40, None, 5, 5, "unclassified"),
    ],
)
def test_segment_boundaries(spark, events, minutes, carts, purchases, segment):
    r = S.classify(rows(spark, [(events, 1, carts, purchases, minutes, None)])).first()
    assert r.behavior_segment == segment
    assert r.segment_score == {"power_user": 100, "engaged_shopper": 75, "browser": 50, "bouncer": 25}.get(segment, 0)


def test_rates_without_denominators_and_above_a_hundred(spark):
    r = S.classify(rows(spark, [(3, 0, 0, 3, 0.1, 5.0), (6, 1, 3, 2, 0.0, 5.0)])).orderBy("user_id").collect()
    assert (r[0].cart_conversion_rate, r[0].purchase_conversion_rate, r[0].overall_conversion_rate, r[0].engagement_rate) == (0.0, 0.0, 0.0, 30.0)
    assert r[1].cart_conversion_rate == 300.0 and r[1].engagement_rate is None


def test_actions(spark):
    got = {r.behavior_segment: (len(r.recommendations), r.action_priority) for r in S.recommend_actions(S.classify(rows(spark, [(1, 1, 0, 0, 0.1, None), (3, 2, 1, 0, 2.0, None), (15, 9, 2, 1, 15.0, 3.0), (40, 9, 2, 3, 45.0, 3.0), (5, 5, 0, 0, 1.0, None)]))).collect()}
    assert got == {"bouncer": (5, 4), "browser": (5, 2), "engaged_shopper": (5, 3), "power_user": (5, 1), "unclassified": (0, 5)}


def test_funnel_of_nothing_and_without_steps(spark):
    empty = spark.createDataFrame([], "user_session string, user_id long, event_type string, event_timestamp timestamp_ntz")
    assert S.funnel_metrics(S.strict_funnel(S.session_steps(empty))).count() == 0
    views = spark.createDataFrame([("a", 1, "view", START), ("b", 1, "purchase", START)], empty.schema)
    got = {r.metric: r.value for r in S.funnel_metrics(S.strict_funnel(S.session_steps(views)), START).collect()}
    assert got["sessions_with_view"] == 1 and got["rate_view_to_cart_percent"] == 0 and got["dropoff_at_view_percent"] == 100 and got["dropoff_at_cart_percent"] == 100
    g = S.global_funnel(views).first()
    assert g.view_to_cart_rate == 0.0 and g.cart_to_purchase_rate is None
    counts = S.strict_funnel(S.session_steps(views)).first()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3]


def test_sessions_of_one_moment_and_types_of_money(spark):
    e = spark.createDataFrame(
        [(1, "a", "view", 10.0, 1, "x", "x.y", START), (1, "a", "remove_from_cart", 20.0, 2, None, None, START), (2, "b", "purchase", 5.0, 1, "x", "x.y", START), (2, "b", "view", None, 1, "x", "x.y", START + datetime.timedelta(seconds=90, microseconds=999999))],
        "user_id long, user_session string, event_type string, price double, product_id long, category_name string, category_code string, event_timestamp timestamp_ntz",
    )
    a, b = S.behaviour_metrics(e).orderBy("user_id").collect()
    assert (a.session_duration_minutes, a.total_amount, a.remove_cart_count, a.unique_categories, a.avg_product_price_viewed) == (0.1, None, 1, 1, 15.0)
    assert (b.session_duration_minutes, b.total_amount, b.avg_purchase_price) == (1.5, 5.0, 5.0)
    a, b = S.session_metrics(e).orderBy("user_id").collect()
    assert (a.session_duration_minutes, a.gross_price_sum, a.converted_to_cart) == (0.0, 30.0, False) and b.converted_to_purchase


def test_journeys_are_ordered_and_contain_rather_than_end(spark):
    t = lambda k: START + datetime.timedelta(seconds=k)
    e = spark.createDataFrame([("a", t(2), 3, "view"), ("a", t(1), 2, "purchase"), ("a", t(1), 1, "cart")], "user_session string, event_timestamp timestamp_ntz, event_id long, event_type string").repartition(3)
    r = S.journey_paths(e).first()
    assert r.journey_path == ["cart", "purchase", "view"] and r.path_length == 3 and r.contains_purchase


def test_distribution_and_summary(spark):
    c = S.classify(rows(spark, [(1, 1, 0, 0, 0.1, None), (2, 1, 0, 0, 0.2, 7.0), (40, 9, 2, 3, 45.0, 3.0)]))
    d = {r.behavior_segment: r for r in S.segment_distribution(c).collect()}
    assert d["bouncer"].session_count == 2 and d["bouncer"].window_start == datetime.datetime(2024, 1, 1, 10, 0) and d["bouncer"].total_revenue == 7.0
    s = {r.scope: (r.session_count, r.avg_score) for r in S.segment_summary(c).collect()}
    assert s["all"] == (3, 50.0) and s["bouncer"] == (2, 25.0)
    assert {r.behavior_segment: r.bar for r in S.segment_report(c.unionByName(*[c] * 1).unionByName(c).unionByName(c).unionByName(c)).collect()}["bouncer"] == "█"
    f = {r.behavior_segment: r for r in S.segment_funnel(c).collect()}
    assert f["bouncer"].avg_order_value == 0.0 and f["power_user"].avg_order_value == 1.0
    assert f["bouncer"].avg_revenue_per_session == 7.0 and S.revenue_by_segment(c).filter("behavior_segment = 'bouncer'").first().avg_revenue == 3.5
