"""The test tables seen as this engine's inputs. The renaming of clicks, the grains of sessions and the unit of duration are devices for these data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import expressions as X
from pathloom.operators import events as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the session a user's day."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return rows.select(
        "event_id",
        F.col("ts").alias("event_timestamp"),
        kind.alias("event_type"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("user_session"),
    )


def mixed_sessions(events: DataFrame) -> DataFrame:
    """Sessions of a month, week, day or hour by user, so that each behaviour segment occurs."""
    t, u = F.col("event_timestamp"), F.col("user_id") % 4
    part = F.when(u == 0, "m").when(u == 1, F.date_format(F.date_trunc("week", t), "yyyy-MM-dd")).when(u == 2, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd-HH"))
    return events.withColumn("user_session", F.concat(F.col("user_id").cast("string"), F.lit("-"), part))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_name"),
        F.lower(F.concat("p_type", F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("")))).alias("category_code"),
        F.col("p_retailprice").alias("original_price"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_segment"), F.col("c_nationkey").alias("nation"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.enrich(raw_events(spark, sf_dir), products(spark, sf_dir), users(spark, sf_dir))


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: an order is a session, a returned line a view and any other a purchase."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("user_session"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") == "R", "view").otherwise("purchase").alias("event_type"),
        F.col("l_shipdate").alias("event_timestamp"),
        F.col("l_extendedprice").alias("price"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions, with what their products are."""
    parts = products(spark, sf_dir).select("product_id", "brand", "category_code")
    return E.interactions(E.with_products(basket_lines(spark, sf_dir), parts))


def bare_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baskets() without brand and category_code, ids of products as numbers. No product is joined: only how often an id stands in the table of
    products counts, as a line occurs once for each, and ids that stand there once, which is all of them as a rule, aren't moved."""
    repeated = products(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lines = basket_lines(spark, sf_dir).join(X.small_side(repeated), "product_id", "left")
    once = F.expr("if(n is null, array(1), array_repeat(1, cast(n as int)))")
    return E.interactions(lines.select("*", F.explode(once)).drop("n", "col"), text_ids=("user_session",))
