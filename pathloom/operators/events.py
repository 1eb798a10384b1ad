"""Parsing, cleaning and enriching events. Every function serves batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import expressions as X
from pathloom.model import EVENT, REQUIRED, CooccurrenceSettings, FeatureSettings


def parse_events(raw: DataFrame, schema: T.StructType = EVENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The JSON in `value` as columns, with `keep` of raw, and event_timestamp. Fields of a wrong type are null."""
    parsed = raw.select(*keep, F.from_json(F.col("value").cast("string"), schema).alias("e")).select(*keep, "e.*")
    return parsed.withColumn("event_timestamp", X.parse_time("event_time")) if "event_time" in schema.fieldNames() else parsed


def split_valid(raw: DataFrame, schema: T.StructType = EVENT, required: tuple[str, ...] = REQUIRED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events with all required fields and a readable time, dead letters: value and what is missing)."""
    e = F.from_json(F.col("value").cast("string"), schema)
    parsed = raw.select(*keep, F.col("value").cast("string").alias("value"), e.alias("e"))
    needed = [F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in required]
    if "event_time" in schema.fieldNames():
        needed.append(F.when(F.col("e.event_time").isNotNull() & X.parse_time("e.event_time").isNull(), F.lit("event_time")))
    parsed = parsed.withColumn("missing", F.array_compact(F.array(*needed)))
    good = parsed.filter(F.size("missing") == 0).select(*keep, "e.*")
    if "event_time" in schema.fieldNames():
        good = good.withColumn("event_timestamp", X.parse_time("event_time"))
    return good, parsed.filter(F.size("missing") > 0).select(*keep, "value", "missing")


def stamp_processing(df: DataFrame) -> DataFrame:
    return df.withColumn("processing_time", F.current_timestamp())


def with_products(events: DataFrame, products: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Left join on product_id; where both sides have a column, the event's stays."""
    if products is None:
        return events
    taken = {c.lower() for c in events.columns} - {"product_id"}
    slim = products.select(*[c for c in products.columns if c.lower() not in taken])
    return events.join(X.small_side(slim, limit), "product_id", "left")


def with_users(events: DataFrame, users: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Left join on user_id; unchanged where there is no user table."""
    if users is None:
        return events
    taken = {c.lower() for c in events.columns} - {"user_id"}
    slim = users.select(*[c for c in users.columns if c.lower() not in taken])
    return events.join(X.small_side(slim, limit), "user_id", "left")


def enrich(events: DataFrame, products: DataFrame | None, users: DataFrame | None, watermark: str | None = None) -> DataFrame:
    """Products, then users; a stream's one watermark belongs here or in the aggregate, never in both."""
    out = with_users(with_products(events, products), users)
    return out.withWatermark("event_timestamp", watermark) if watermark and events.isStreaming else out


def derived_columns(events: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """price_category, event_hour and is_weekend, which the feature and statistics operators read."""
    return events.withColumns(
        {"price_category": X.price_category("price", s), "event_hour": F.hour("event_timestamp"), "is_weekend": X.is_weekend("event_timestamp")}
    )


def with_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("event_timestamp"))


def funnel_events(events: DataFrame) -> DataFrame:
    """What the funnel needs of views, carts and purchases inside a session."""
    wanted = "event_type in ('view', 'cart', 'purchase') and user_session is not null"
    return events.filter(wanted).select("user_session", "user_id", "event_type", "event_timestamp")


def usable_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_timestamp").isNotNull() & F.col("user_id").isNotNull())


def interactions(events: DataFrame, s: CooccurrenceSettings = CooccurrenceSettings(), text_ids: tuple[str, ...] = ("user_session", "product_id")) -> DataFrame:
    """Views and purchases with string ids (those named; others stay as they are), a readable time and a weight, from typed or all-string columns."""
    time = X.parse_time(F.col("event_time").cast("string")) if "event_time" in events.columns else F.col("event_timestamp").cast("timestamp")
    have = [c for c in ("brand", "category_code") if c in events.columns]
    out = events.select(
        *[X.text(c) if c in text_ids else c for c in ("user_session", "product_id")],
        F.lower(F.col("event_type").cast("string")).alias("event_type"),
        time.alias("event_ts"),
        F.expr("try_cast(price AS double)").alias("price"),
        *[X.text(c) for c in have],
    )
    complete = "user_session is not null and product_id is not null and event_ts is not null"
    weight = F.when(X.is_type("purchase"), s.purchase_weight).otherwise(s.view_weight)
    return out.filter(complete).filter("event_type in ('view', 'purchase')").withColumn("weight", weight)


def model_rows(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """brand, category_code, price and the label is_purchase, complete rows only; with key columns also row_key, their hash."""
    rows = events.select(
        *([F.xxhash64(*key).alias("row_key")] if key else []),
        X.text("brand"),
        X.text("category_code"),
        F.expr("try_cast(price AS double)").alias("price"),
        F.expr("int(lower(event_type) = 'purchase')").alias("is_purchase"),
    )
    return rows.dropna(subset=[*X.TRAITS, "is_purchase"])


def sample_rows(df: DataFrame, rows: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """At most `rows` rows; with a key always the same ones, those with the smallest hashes. The limit holds in each task
    before rows are moved."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), key)), key).limit(rows) if key else df.limit(rows)
