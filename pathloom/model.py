"""Schemas and settings of the event engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def schema(text: str) -> T.StructType:
    """A flat schema from `name type` pairs; Spark's own parser would need a running session."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (part.split() for part in text.split(","))])


EVENT = schema(
    "event_time string, event_type string, product_id long, category_id long, category_code string, brand string, price double, user_id long, user_session string"
)
REQUIRED = ("event_time", "event_type", "product_id", "user_id", "user_session")
PRODUCT = schema(
    "product_id long, product_name string, brand string, category_id long, category_name string, category_code string, subcategory string, "
    "original_price double, discount_percent int, final_price double, rating double, num_reviews int, in_stock boolean"
)
USER = schema(
    "user_id long, user_segment string, registration_date date, country string, city string, age_group string, gender string, preferred_language string"
)
CATEGORY = schema("category_id long, category_name string, parent_category string, level int, description string")
METRIC = schema("metric string, value double, description string, analysis_timestamp timestamp")
RECOMMENDATION = T.StructType(
    [
        T.StructField("product_id", TYPES["string"]),
        T.StructField("recs", T.ArrayType(schema("score double, product_id string, p_buy double, related_score double"))),
        T.StructField("updated_at", TYPES["string"]),
    ]
)


@dataclass(frozen=True)
class Segment:
    """Inclusive bounds of a behaviour segment; None is open. below_minutes is exclusive."""

    name: str
    score: int
    color: str
    priority: int
    events: tuple[int, int | None]
    minutes: tuple[float | None, float | None] = (None, None)
    below_minutes: float | None = None
    carts: tuple[int, int | None] = (0, None)
    purchases: tuple[int, int | None] = (0, None)


#: In order: the first that fits counts. This table is what the classifier reads.
SEGMENTS = (
    Segment("power_user", 100, "🔵", 1, (30, None), (30, None), purchases=(2, None)),
    Segment("engaged_shopper", 75, "🟢", 3, (10, 29), (10, 30), carts=(2, None), purchases=(1, None)),
    Segment("browser", 50, "🟡", 2, (3, 10), (1, 10), carts=(1, None), purchases=(0, 0)),
    Segment("bouncer", 25, "🔴", 4, (1, 2), below_minutes=1.0, carts=(0, 0), purchases=(0, 0)),
)
UNCLASSIFIED = Segment("unclassified", 0, "⚪", 5, (0, None))


@dataclass(frozen=True)
class WindowSettings:
    duration: str = "5 minutes"
    slide: str | None = None
    watermark: str = "10 minutes"


@dataclass(frozen=True)
class FeatureSettings:
    reference_date: str = "2019-11-01"
    churn_after_days: int = 7
    #: Upper price bounds of Budget, Mid-Range and Premium; these cut points are this engine's own.
    price_bands: tuple[float, float, float] = (50.0, 200.0, 500.0)


@dataclass(frozen=True)
class CooccurrenceSettings:
    events_per_session: int = 25
    items_per_session: int = 60
    per_item: int = 100
    view_weight: float = 1.0
    purchase_weight: float = 5.0


@dataclass(frozen=True)
class RankSettings:
    top_values: int = 200
    top_final: int = 20
    related_weight: float = 0.7
    buy_weight: float = 0.3


@dataclass(frozen=True)
class SessionSettings:
    """What a session of Spark for this engine is made of; master None leaves the launcher's."""

    app_name: str = "pathloom"
    master: str | None = None
    shuffle_partitions: int | None = None
    time_zone: str = "UTC"
    trigger: str = "10 seconds"
    #: Dimensions of at most so many estimated bytes are broadcast; the session carries the setting.
    broadcast_bytes: int = 64 << 20
    #: Where Collections of a session are, unless they are told otherwise.
    tables_root: str | None = None
    extra: tuple[tuple[str, str], ...] = ()


#: Result tables by role.
TABLES = {name: name for name in (
    "enriched_events", "windowed_metrics", "session_metrics", "user_behaviors", "journey_metrics", "user_features",
    "customer_segments", "churn_predictions", "time_series", "category_statistics", "recommendations", "product_catalog",
)}
