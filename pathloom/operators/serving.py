"""Read queries over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.metrics import table_counts


def latest_metrics(metrics: DataFrame, n: int = 8) -> DataFrame:
    """The last run's rows, at most n."""
    return metrics.orderBy(F.desc("analysis_timestamp"), "metric").limit(n)


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table; of segments, that is users with one."""
    return table_counts(tables)


def segment_overview(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("user_count"),
        F.sum("total_spent").alias("total_revenue"),
        F.avg("total_spent").alias("avg_spent"),
        F.avg("purchase_count").alias("avg_purchases"),
        F.avg("customer_value_score").alias("avg_value_score"),
    ).orderBy(F.desc("avg_spent"), "segment_name")


def top_spenders(segments: DataFrame, n: int = 20) -> DataFrame:
    return segments.select("user_id", "segment_name", "total_spent", "purchase_count").orderBy(F.desc("total_spent"), "user_id").limit(n)


def at_risk(churn: DataFrame, n: int = 50) -> DataFrame:
    return churn.filter("churn_prediction = 1").orderBy(F.desc("total_spent"), "user_id").limit(n)


def churn_rate(churn: DataFrame) -> DataFrame:
    out = churn.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("churn_prediction") == 1).alias("predicted_churn"))
    return out.withColumn("churn_rate", F.coalesce(F.round(F.try_divide(F.col("predicted_churn"), F.col("total_users")) * 100, 2), F.lit(0.0)))


def recent_trends(trends: DataFrame, n: int = 100) -> DataFrame:
    wanted = ["date", "event_type", "event_count", "unique_users", "revenue", "ma_7day_events", "day_over_day_growth"]
    return trends.select(*wanted).orderBy(F.desc("date"), "event_type").limit(n)


def user_profile(users: DataFrame, features: DataFrame, segments: DataFrame, churn: DataFrame) -> DataFrame:
    """Each asked user with what the three tables have; null where one has nothing."""
    return users.select("user_id").distinct().join(features, "user_id", "left").join(segments, "user_id", "left").join(churn, "user_id", "left")


def product(catalog: DataFrame, product_id: str) -> DataFrame:
    """The product with this id, given as text; no row if there is none."""
    return catalog.filter(F.col("product_id").cast("string") == str(product_id))


def product_page(catalog: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page by id with the number of all products; NaN becomes null."""
    total = catalog.agg(F.count(F.lit(1)).alias("total"))
    page = catalog.orderBy("product_id").offset(skip).limit(limit)
    clean = page.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in page.schema])
    return clean.crossJoin(F.broadcast(total))  # one row


def display_price(catalog: DataFrame, price: Column | str = "price") -> DataFrame:
    return catalog.withColumns({"shown_before": F.round(F.col(price) * 1.2 if isinstance(price, str) else price * 1.2, 2), "shown_cut": F.lit("-17%")})


def trend_summary(trends: DataFrame) -> DataFrame:
    """Per event type: total, rounded mean a row, peak day, mean of growths that aren't zero, and the largest row."""
    return trends.groupBy("event_type").agg(
        F.sum("event_count").alias("total_events"),
        F.round(F.avg("event_count")).alias("mean_events"),
        F.max_by("date", F.struct("event_count", F.datediff(F.lit("2100-01-01"), "date"))).alias("peak_day"),
        F.avg(F.expr("nullif(day_over_day_growth, 0)")).alias("mean_growth"),
        F.max("event_count").alias("peak_events"),
    )


def scaled_bars(rows: DataFrame, value: str, width: int = 100) -> DataFrame:
    """bar: the value as a share of the largest, in width steps."""
    most = rows.agg(F.max(value).alias("__most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("bar", F.coalesce(F.round(F.try_divide(F.col(value), F.col("__most")) * width, 1), F.lit(0.0))).drop("__most")
