import datetime
import math

from pyspark.sql import functions as F

from pathloom.functions import expressions as X
from pathloom.operators import events as E
from pathloom.operators import metrics as M

GOOD = '{"event_time":"2019-10-01 00:00:00 UTC","event_type":"view","product_id":1,"price":2.5,"user_id":7,"user_session":"s"}'


def test_time_formats(spark):
    texts = ["2019-10-01 00:00:00 UTC", "2019-10-01T00:00:00", "2019-10-01T00:00:00.250000", "garbage", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_time("t").cast("timestamp_ntz")).collect()]
    day = datetime.datetime(2019, 10, 1)
    assert got == [day, day, day + datetime.timedelta(milliseconds=250), None, None, None]


def test_malformed_messages_become_dead_letters(spark):
    wrong = GOOD.replace("2.5", '"dear"')
    values = [GOOD, wrong, GOOD.replace("2.5", "NaN"), "{bad", "{}", "[]", "null", "", None, GOOD.replace("2019-10-01 00:00:00 UTC", "later")]
    raw = spark.createDataFrame([(v,) for v in values], "value string")
    good, bad = E.split_valid(raw)
    prices = [r.price for r in good.collect()]
    assert len(prices) == 3 and 2.5 in prices and None in prices and any(p is not None and math.isnan(p) for p in prices)
    missing = {r.value: r.missing for r in bad.collect()}
    assert bad.count() == 7 and missing["{}"] == ["event_time", "event_type", "product_id", "user_id", "user_session"]
    assert [m for v, m in missing.items() if v and "later" in v] == [["event_time"]]
    assert E.parse_events(raw).filter("user_id is not null").count() == 4


def test_the_event_s_columns_win_over_the_product_s(spark):
    e = spark.createDataFrame([(1, "own", 5, "own.code"), (2, None, 6, None)], "product_id long, brand string, category_id long, category_code string")
    p = spark.createDataFrame([(1, "catalogue", 9, "other.code", "Phones")], "product_id long, brand string, category_id long, category_code string, category_name string")
    out = E.with_products(e, p)
    assert sorted(out.columns) == ["brand", "category_code", "category_id", "category_name", "product_id"]
    got = {r.product_id: (r.brand, r.category_name) for r in out.collect()}
    assert got == {1: ("own", "Phones"), 2: (None, None)}
    assert E.with_users(e, None) is e and E.with_products(e, None) is e


def test_dimensions_are_broadcast_only_while_small(spark):
    e = spark.range(1000).withColumnRenamed("id", "product_id")
    p = spark.range(1000).select(F.col("id").alias("product_id"), F.lit("x").alias("name"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(E.with_products(e, p)) and "strategy=broadcast" not in plan(E.with_products(e, p, limit=10))


def test_filters_and_columns_reach_the_scan(spark):
    from pathloom.sources import testdata as D

    plan = E.funnel_events(D.raw_events(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan and "Python" not in plan


def test_price_bands_hours_and_weekends(spark):
    rows = [(p, datetime.datetime(2024, 1, 6 + k, 23)) for k, p in enumerate([49.99, 50.0, 199.99, 200.0, 500.0, None])]
    got = E.derived_columns(spark.createDataFrame(rows, "price double, event_timestamp timestamp_ntz")).orderBy("event_timestamp").collect()
    assert [r.price_category for r in got] == ["Budget", "Mid-Range", "Mid-Range", "Premium", "Luxury", None]
    assert [r.is_weekend for r in got] == [True, True, False, False, False, False] and {r.event_hour for r in got} == {23}


def test_every_event_is_in_one_tumbling_and_two_sliding_windows(spark):
    from pathloom.model import WindowSettings
    from pathloom.sources import testdata as D

    e = D.raw_events(spark, "/root/testdata/sf0.001")
    n = e.count()
    assert M.windowed_metrics(e).agg(F.sum("event_count")).first()[0] == n
    assert M.windowed_metrics(e, WindowSettings("10 minutes", "5 minutes")).agg(F.sum("event_count")).first()[0] == 2 * n


def test_sparse_days(spark):
    d = lambda k: datetime.date(2024, 1, k)
    daily = spark.createDataFrame([(d(1), "view", 0, 1, 1, 0.0), (d(2), "view", 10, 2, 2, 0.0), (d(4), "view", 5, 3, 3, 1.0)], "date date, event_type string, event_count long, unique_users long, unique_sessions long, revenue double")
    got = M.daily_trends(daily).orderBy("date").collect()
    assert [r.day_over_day_growth for r in got] == [0.0, 0.0, -50.0] and [r.ma_3day_events for r in got] == [0.0, 5.0, 5.0] and got[0].prev_day_events is None
    filled = M.daily_trends(M.with_all_days(daily)).orderBy("date").collect()
    assert [r.event_count for r in filled] == [0, 10, 0, 5] and filled[3].day_over_day_growth == 0.0


def test_features_of_users_without_purchases(spark):
    t = datetime.datetime(2019, 10, 20, 12)
    e = spark.createDataFrame([(1, "a", 1, "view", 10.0, t, "c", "b")], "user_id long, user_session string, product_id long, event_type string, price double, event_timestamp timestamp_ntz, category_name string, brand string")
    r = M.user_features(E.derived_columns(e)).first()
    assert (r.total_spent, r.avg_purchase_value, r.max_purchase, r.price_stddev, r.view_to_cart_ratio, r.recency_days, r.is_churned, r.customer_value_score) == (0.0, 0.0, 0.0, 0.0, 0.0, 12, 1, 2.0)
    assert len(M.user_features(E.derived_columns(e)).columns) == 31
