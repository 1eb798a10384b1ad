"""Session metrics, behaviour segments, journeys and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.functions import expressions as X
from pathloom.model import SEGMENTS, UNCLASSIFIED, Segment

KEY = ("user_id", "user_session")

ACTIONS = {
    "power_user": ["Switch on top-tier membership perks", "Open sales to them before others", "Put their tickets first in support", "Show picks built on past orders", "Reward them for bringing friends"],
    "engaged_shopper": ["Show accessories for what they chose", "Double their loyalty points for a while", "Follow up by mail after the visit", "Point to neighbouring categories", "Ask them into the membership scheme"],
    "browser": ["Remind them of the open cart within the hour", "Give a small discount with an end date", "Put ratings beside the price", "Name the sum from which delivery is free", "Make safe payment visible"],
    "bouncer": ["Rework the entry page", "Look into where this traffic comes from", "Test another opening section", "Shorten the first load", "Offer a discount on leaving"],
}


def distinct(column: str, exact: bool) -> Column:
    """Exact counts for batch; streams only allow the estimate."""
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def session_metrics(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per session: times, counts by type, the sum of all prices, distinct products and categories, minutes, and conversions."""
    out = events.groupBy(*KEY).agg(
        F.min("event_timestamp").alias("session_start"),
        F.max("event_timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("total_events"),
        *[X.count_type(t).alias(f"{t}_count") for t in ("view", "cart", "purchase")],
        F.sum("price").alias("gross_price_sum"),
        distinct("product_id", exact).alias("unique_products"),
        distinct("category_name", exact).alias("unique_categories"),
    )
    return out.withColumns(
        {
            "session_duration_minutes": X.minutes_between("session_start", "session_end"),
            "converted_to_cart": F.col("cart_count") > 0,
            "converted_to_purchase": F.col("purchase_count") > 0,
        }
    )


def behaviour_columns(exact: bool = True) -> list[Column]:
    """The aggregates of a session's behaviour, for batches and streams."""
    bought = F.when(X.is_type("purchase"), F.col("price"))
    return [
        F.min("event_timestamp").alias("session_start"),
        F.max("event_timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("total_events"),
        *[X.count_type(t).alias(f"{t}_count") for t in ("view", "cart", "purchase")],
        X.count_type("remove_from_cart").alias("remove_cart_count"),
        distinct("product_id", exact).alias("unique_products"),
        distinct("category_code", exact).alias("unique_categories"),
        F.sum(bought).alias("total_amount"),
        F.avg(bought).alias("avg_purchase_price"),
        F.avg("price").alias("avg_product_price_viewed"),
    ]


def behaviour_metrics(events: DataFrame, exact: bool = True, minute: float = 60.0, stamp: bool = False) -> DataFrame:
    """Per session, with revenue of purchases only (null without any); a session of no length lasts 0.1.

    `minute` is the seconds in a unit of duration."""
    out = events.groupBy(*KEY).agg(*behaviour_columns(exact))
    length = X.minutes_between("session_start", "session_end") * (60.0 / minute)
    out = out.withColumn("session_duration_minutes", F.when(length == 0, 0.1).otherwise(length))
    return out.withColumn("processing_time", F.current_timestamp()) if stamp else out


def inside(value: str, bounds: tuple) -> Column:
    low, high = bounds
    tests = [F.col(value) >= low if low is not None else None, F.col(value) <= high if high is not None else None]
    out = F.lit(True)
    for t in tests:
        out = out if t is None else out & t
    return out


def fits(s: Segment) -> Column:
    minutes = inside("session_duration_minutes", s.minutes)
    if s.below_minutes is not None:
        minutes = F.col("session_duration_minutes") < s.below_minutes
    return inside("total_events", s.events) & minutes & inside("cart_count", s.carts) & inside("purchase_count", s.purchases)


def ladder(source: tuple[Segment, ...], test, value, default) -> Column:
    out = None
    for s in source:
        out = F.when(test(s), value(s)) if out is None else out.when(test(s), value(s))
    return out.otherwise(default)


def classify(sessions: DataFrame, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """behavior_segment, its score and color, and session rates. A null duration fits none of the segments."""
    named = lambda s: F.col("behavior_segment") == s.name
    out = sessions.withColumn("behavior_segment", ladder(segments, fits, lambda s: F.lit(s.name), UNCLASSIFIED.name))
    return out.withColumns(
        {
            "segment_score": ladder(segments, named, lambda s: F.lit(s.score), UNCLASSIFIED.score),
            "segment_color": ladder(segments, named, lambda s: F.lit(s.color), UNCLASSIFIED.color),
            "engagement_rate": F.try_divide(F.col("total_events"), F.col("session_duration_minutes")),
            "cart_conversion_rate": X.share("cart_count", "view_count", 100),
            "purchase_conversion_rate": X.share("purchase_count", "cart_count", 100),
            "overall_conversion_rate": X.share("purchase_count", "view_count", 100),
        }
    )


def recommend_actions(classified: DataFrame, segments: tuple[Segment, ...] = SEGMENTS, actions: dict[str, list[str]] = ACTIONS) -> DataFrame:
    """recommendations (array<string>) and action_priority by segment; an empty array and 5 for others."""
    named = lambda s: F.col("behavior_segment") == s.name
    lists = ladder(segments, named, lambda s: F.array(*[F.lit(a) for a in actions[s.name]]), F.array().cast("array<string>"))
    return classified.withColumns({"recommendations": lists, "action_priority": ladder(segments, named, lambda s: F.lit(s.priority), UNCLASSIFIED.priority)})


def segment_distribution(classified: DataFrame, duration: str = "5 minutes", exact: bool = True) -> DataFrame:
    """Per window of session starts and segment."""
    out = classified.groupBy(F.window("session_start", duration).alias("w"), "behavior_segment").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.avg("segment_score").alias("avg_score"),
        F.avg("total_events").alias("avg_events"),
        F.avg("session_duration_minutes").alias("avg_duration"),
        F.sum("total_amount").alias("total_revenue"),
        distinct("user_id", exact).alias("unique_users"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[1:])


def segment_funnel(classified: DataFrame, exact: bool = True) -> DataFrame:
    """Per segment: sums, rates in percent (0.0 without a denominator) and order value."""
    out = classified.groupBy("behavior_segment").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        distinct("user_id", exact).alias("unique_users"),
        *[F.sum(f"{t}_count").alias(f"total_{t}s") for t in ("view", "cart", "purchase")],
        F.avg("session_duration_minutes").alias("avg_session_duration"),
        F.sum("total_amount").alias("total_revenue"),
        F.avg("total_amount").alias("avg_revenue_per_session"),
    )
    return out.withColumns(
        {
            "view_to_cart_rate": X.share("total_carts", "total_views", 100),
            "cart_to_purchase_rate": X.share("total_purchases", "total_carts", 100),
            "overall_conversion_rate": X.share("total_purchases", "total_views", 100),
            "avg_order_value": F.when(F.col("total_purchases") > 0, F.col("total_revenue") / F.col("total_purchases")).otherwise(0.0),
        }
    )


def global_funnel(events: DataFrame, exact: bool = True) -> DataFrame:
    """One row: distinct sessions with each step, all events, and rates as fractions, null without a denominator."""
    having = lambda t: F.when(X.is_type(t), F.col("user_session"))
    count = F.count_distinct if exact else F.approx_count_distinct
    out = events.agg(*[count(having(t)).alias(f"sessions_with_{t}") for t in ("view", "cart", "purchase")], F.count(F.lit(1)).alias("total_events"))
    v, c, p = (F.col(f"sessions_with_{t}") for t in ("view", "cart", "purchase"))
    return out.withColumns({"view_to_cart_rate": F.try_divide(c, v), "cart_to_purchase_rate": F.try_divide(p, c), "overall_conversion_rate": F.try_divide(p, v)})


def session_steps(events: DataFrame) -> DataFrame:
    """Per session which of the steps it holds; one aggregate where three window passes would also do."""
    return events.groupBy("user_session").agg(*[F.coalesce(F.bool_or(X.is_type(t)), F.lit(False)).alias(f"has_{t}") for t in ("view", "cart", "purchase")])


def strict_funnel(steps: DataFrame) -> DataFrame:
    """One row: sessions, and those holding views, views and carts, and all three (as sets, not in order); one action for all."""
    v, vc, vcp = F.col("has_view"), F.col("has_view") & F.col("has_cart"), F.col("has_view") & F.col("has_cart") & F.col("has_purchase")
    return steps.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(v).alias("sessions_with_view"),
        F.count_if(vc).alias("sessions_view_and_cart"),
        F.count_if(vcp).alias("sessions_view_cart_and_purchase"),
    )


FUNNEL_TEXTS = {
    "total_sessions": "sessions analysed",
    "sessions_with_view": "sessions with a view",
    "sessions_view_and_cart": "sessions with a view and a cart",
    "sessions_view_cart_and_purchase": "sessions with a view, a cart and a purchase",
    "rate_view_to_cart_percent": "percent of viewing sessions that reach a cart",
    "rate_cart_to_purchase_percent": "percent of those that buy",
    "dropoff_at_view_percent": "percent of viewing sessions without a cart",
    "dropoff_at_cart_percent": "percent of carts without a purchase",
}


def funnel_metrics(counts: DataFrame, analysis_timestamp=None) -> DataFrame:
    """strict_funnel's row in long form, eight metrics; none for no sessions. The time of analysis is added where given."""
    to_cart = X.share("sessions_view_and_cart", "sessions_with_view", 100)
    to_buy = X.share("sessions_view_cart_and_purchase", "sessions_view_and_cart", 100)
    wide = counts.filter("total_sessions > 0").select(
        *[F.col(c).cast("double").alias(c) for c in list(FUNNEL_TEXTS)[:4]],
        F.round(to_cart, 2).alias("rate_view_to_cart_percent"),
        F.round(to_buy, 2).alias("rate_cart_to_purchase_percent"),
        F.round(100 - to_cart, 2).alias("dropoff_at_view_percent"),
        F.round(100 - to_buy, 2).alias("dropoff_at_cart_percent"),
    )
    long = wide.select(F.stack(F.lit(len(FUNNEL_TEXTS)), *[x for m, d in FUNNEL_TEXTS.items() for x in (F.lit(m), F.col(m), F.lit(d))]).alias("metric", "value", "description"))
    return long.withColumn("analysis_timestamp", F.lit(analysis_timestamp).cast("timestamp")) if analysis_timestamp is not None else long


def journey_paths(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Per session the event types in order of time, how many there are, and whether a purchase is among them."""
    order = F.array_sort(F.collect_list(F.struct("event_timestamp", tie, "event_type")))
    out = events.groupBy("user_session").agg(F.transform(order, lambda x: x["event_type"]).alias("journey_path"))
    return out.withColumns({"path_length": F.size("journey_path"), "contains_purchase": F.array_contains("journey_path", "purchase")})


def numbered_events(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """event_sequence: the place of each event in its session."""
    return events.withColumn("event_sequence", F.row_number().over(Window.partitionBy("user_session").orderBy("event_timestamp", tie)))


def revenue_by_segment(classified: DataFrame) -> DataFrame:
    amount = F.coalesce("total_amount", F.lit(0.0))
    return classified.groupBy("behavior_segment").agg(F.sum(amount).alias("total_revenue"), F.avg(amount).alias("avg_revenue"), F.count(F.lit(1)).alias("session_count"))


def segment_report(classified: DataFrame) -> DataFrame:
    """Sessions and mean score by segment, with a bar of one mark for every ten sessions."""
    out = classified.groupBy("behavior_segment").agg(F.count(F.lit(1)).alias("session_count"), F.avg("segment_score").alias("avg_score"))
    return out.withColumn("bar", F.expr("repeat('█', cast(floor(session_count / 10) as int))"))


def recent_sessions(classified: DataFrame, n: int = 10) -> DataFrame:
    return classified.orderBy(F.desc("session_start"), "user_id", "user_session").limit(n)


def segment_summary(classified: DataFrame) -> DataFrame:
    """A row for the whole and one for each segment, from one pass: scope, sessions, mean score."""
    out = classified.groupBy("behavior_segment").agg(F.count(F.lit(1)).alias("session_count"), F.sum("segment_score").alias("s"))
    scoped = out.select(F.explode(F.array(F.lit("all"), F.col("behavior_segment"))).alias("scope"), "session_count", "s")
    return scoped.groupBy("scope").agg(F.sum("session_count").alias("session_count"), F.try_divide(F.sum("s"), F.sum("session_count")).alias("avg_score"))
