"""Windowed, category, user, daily and descriptive metrics, and user features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.functions import expressions as X
from pathloom.model import FeatureSettings, WindowSettings
from pathloom.operators.sessions import distinct

#: Percentiles are off by at most one part in so many ranks, and exact for groups of no more rows.
ACCURACY = 20_000


def windowed_metrics(events: DataFrame, s: WindowSettings = WindowSettings(), exact: bool | None = None) -> DataFrame:
    """Per window of event time and event type: count, sum and mean of all prices, distinct users, products and sessions.

    On a stream the watermark is set here, and distinct counts are estimates."""
    exact = not events.isStreaming if exact is None else exact
    if events.isStreaming:
        events = events.withWatermark("event_timestamp", s.watermark)
    window = F.window("event_timestamp", s.duration, s.slide) if s.slide else F.window("event_timestamp", s.duration)
    return events.groupBy(window.alias("time_window"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("price").alias("gross_price_sum"),
        F.avg("price").alias("avg_price"),
        *[distinct(c, exact).alias(f"unique_{n}") for c, n in (("user_id", "users"), ("product_id", "products"), ("user_session", "sessions"))],
    )


def flat_window(df: DataFrame, window: str = "time_window") -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end"), *rest)


def category_metrics(events: DataFrame, exact: bool = True) -> DataFrame:
    return events.groupBy("category_name", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("price").alias("gross_price_sum"), F.avg("price").alias("avg_price"), distinct("user_id", exact).alias("unique_users")
    )


def user_metrics(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per user; gross_price_sum is over all events, whatever their type."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        *[X.count_type(t).alias(f"{t}_count") for t in ("view", "cart", "purchase")],
        F.sum("price").alias("gross_price_sum"),
        F.avg("price").alias("avg_price"),
        distinct("product_id", exact).alias("unique_products"),
    )


def user_features(events: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """21 aggregates and 9 derived features per user, from events with derived_columns and the product's brand and category."""
    bought = F.when(X.is_type("purchase"), F.col("price"))
    bands = {"budget": "Budget", "midrange": "Mid-Range", "premium": "Premium", "luxury": "Luxury"}
    out = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("user_session").alias("total_sessions"),
        F.count_distinct("product_id").alias("unique_products_viewed"),
        F.count_distinct("category_name").alias("unique_categories"),
        F.count_distinct("brand").alias("unique_brands"),
        *[X.count_type(t).alias(f"{t}_count") for t in ("view", "cart", "purchase")],
        F.sum(F.when(X.is_type("purchase"), F.col("price")).otherwise(0.0)).alias("total_spent"),
        F.avg(bought).alias("avg_purchase_value"),
        F.max(bought).alias("max_purchase"),
        *[F.count_if(F.col("price_category") == label).alias(f"{name}_interactions") for name, label in bands.items()],
        F.min("event_timestamp").alias("first_event_date"),
        F.max("event_timestamp").alias("last_event_date"),
        F.avg("price").alias("avg_price_browsed"),
        F.stddev_samp("price").alias("price_stddev"),
        F.avg("event_hour").alias("avg_hour_of_day"),
        F.count_if("is_weekend").alias("weekend_events"),
    )
    reference = F.lit(s.reference_date).cast("date")
    out = out.withColumns(
        {
            "days_active": F.datediff("last_event_date", "first_event_date") + 1,
            "avg_events_per_session": F.try_divide(F.col("total_events"), F.col("total_sessions")),
            "view_to_cart_ratio": X.share("cart_count", "view_count"),
            "cart_to_purchase_ratio": X.share("purchase_count", "cart_count"),
            "overall_conversion_rate": X.share("purchase_count", "total_events"),
            "weekend_ratio": X.share("weekend_events", "total_events"),
            "recency_days": F.datediff(reference, "last_event_date"),
        }
    )
    out = out.withColumns(
        {
            "is_churned": (F.col("recency_days") > s.churn_after_days).cast("int"),
            "customer_value_score": F.col("total_spent") * 0.5 + F.col("purchase_count") * 10 + F.col("total_sessions") * 2,
        }
    )
    return out.fillna({c: 0.0 for c in ("avg_purchase_value", "max_purchase", "price_stddev", "customer_value_score")})


def daily_metrics(events: DataFrame) -> DataFrame:
    """Per day and event type, revenue of purchases only."""
    return events.groupBy(F.to_date("event_timestamp").alias("date"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("user_session").alias("unique_sessions"),
        F.sum(F.when(X.is_type("purchase"), F.col("price")).otherwise(0.0)).alias("revenue"),
    )


def daily_trends(daily: DataFrame) -> DataFrame:
    """Moving averages over the last 7 and 3 rows, the row before and growth over it (0 without a positive one).

    Frames count rows: a missing day isn't filled in, see with_all_days."""
    days = Window.orderBy("date").partitionBy("event_type")
    last = lambda n: days.rowsBetween(1 - n, 0)
    out = daily.withColumns(
        {
            "ma_7day_events": F.avg("event_count").over(last(7)),
            "ma_3day_events": F.avg("event_count").over(last(3)),
            "ma_7day_users": F.avg("unique_users").over(last(7)),
            "prev_day_events": F.lag("event_count", 1).over(days),
        }
    )
    change = (F.col("event_count") - F.col("prev_day_events")) / F.col("prev_day_events") * 100
    return out.withColumn("day_over_day_growth", F.when(F.col("prev_day_events") > 0, change).otherwise(0.0))


def with_all_days(daily: DataFrame) -> DataFrame:
    """daily with zero rows for days missing between a type's first and last."""
    span = daily.groupBy("event_type").agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("interval 1 day"))).alias("date"))
    return span.join(daily, ["date", "event_type"], "left").fillna(0)


def category_statistics(events: DataFrame) -> DataFrame:
    """Percentiles and distinct users are aggregated apart: together, a sketch would be kept for each category and user."""
    stats = events.groupBy("category_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("price").alias("avg_price"),
        F.stddev_samp("price").alias("stddev_price"),
        F.percentile_approx("price", 0.5, ACCURACY).alias("median_price"),
        F.percentile_approx("price", 0.95, ACCURACY).alias("p95_price"),
    )
    users = events.groupBy(F.col("category_name").alias("__category")).agg(F.count_distinct("user_id").alias("unique_users"))
    joined = stats.join(users, F.col("category_name").eqNullSafe(F.col("__category")))
    return joined.select("category_name", "event_count", "unique_users", "avg_price", "stddev_price", "median_price", "p95_price").orderBy(F.desc("event_count"), "category_name")


def price_summary(events: DataFrame) -> DataFrame:
    """One row of typed statistics where a summary table would give strings."""
    q = lambda x: F.percentile_approx("price", x, ACCURACY)
    return events.agg(
        F.count("price").alias("count"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("stddev"), F.min("price").alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("price").alias("max"),
    )


def correlations(events: DataFrame, columns: dict | None = None) -> DataFrame:
    """Pearson's r of each pair of columns, in long form, over rows where all are present; one pass."""
    columns = columns or {
        "price": F.col("price"),
        "event_hour": F.col("event_hour").cast("double"),
        "is_purchase": X.is_type("purchase").cast("double"),
        "is_weekend": F.col("is_weekend").cast("double"),
    }
    names = list(columns)
    rows = events.select(*[c.alias(n) for n, c in columns.items()]).dropna()
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in names for b in names])
    parts = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{a}|{b}`").alias("correlation")) for a in names for b in names]
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def segment_profile(segmented: DataFrame, by: str = "segment") -> DataFrame:
    return segmented.groupBy(by).agg(
        F.count(F.lit(1)).alias("user_count"),
        *[F.avg(c).alias(f"avg_{n}") for c, n in (("total_spent", "revenue"), ("purchase_count", "purchases"), ("overall_conversion_rate", "conversion_rate"), ("customer_value_score", "value_score"))],
    ).orderBy(by)


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and distinct values of each column, a row each."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(f"d{k}") for k, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"d{k}").alias("distinct_count")) for k, c in enumerate(columns)]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, a row each."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in tables.items()])
