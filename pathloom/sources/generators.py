"""Seeded generators of dimensions and sessions. Everything is a function of the row's id and the seed, so it is the same however it is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.model import CATEGORY, PRODUCT
from pathloom.operators.recommend import first_seen


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def pick(u: Column, values: list, weights: list[float] | None = None) -> Column:
    weights = weights or [1 / len(values)] * len(values)
    out, edge = None, 0.0
    for value, weight in zip(values[:-1], weights):
        edge += weight
        out = F.when(u < edge, F.lit(value)) if out is None else out.when(u < edge, F.lit(value))
    return out.otherwise(F.lit(values[-1])) if out is not None else F.lit(values[0])


def user_dimension(events: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """A row for each user of the events, with weighted random demographics."""
    users = events.filter("user_id is not null").select("user_id").distinct()
    users = users.orderBy("user_id").limit(limit) if limit else users
    u = lambda k: uniform(seed + k, "user_id")
    country = pick(u(3), ["US", "UK", "DE", "FR", "VN"], [0.4, 0.2, 0.15, 0.1, 0.15])
    city = F.concat(country, F.lit(" city "), F.floor(u(4) * 5).cast("string"))
    return users.select(
        "user_id",
        pick(u(1), ["new", "regular", "vip"], [0.3, 0.5, 0.2]).alias("user_segment"),
        F.date_sub(F.lit("2019-10-01").cast("date"), F.floor(u(2) * 730).cast("int")).alias("registration_date"),
        country.alias("country"),
        city.alias("city"),
        pick(u(5), ["18-24", "25-34", "35-44", "45-54", "55+"], [0.2, 0.35, 0.25, 0.12, 0.08]).alias("age_group"),
        pick(u(6), ["F", "M", "Other"], [0.48, 0.48, 0.04]).alias("gender"),
        pick(u(7), ["en", "de", "fr", "vi"], [0.6, 0.15, 0.1, 0.15]).alias("preferred_language"),
    )


def numbered_users(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """The same for users 1 to n, where there are no events."""
    return user_dimension(spark.range(1, n + 1).withColumnRenamed("id", "user_id"), seed=seed)


def product_catalog(events: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    """A row for each product: its first event's category, brand and price, and seeded attributes."""
    have = {c: F.col(c) if c in events.columns else F.lit(None) for c in ("category_id", "category_code", "brand", "price")}
    first = first_seen(events.select("product_id", *order, have["category_id"].cast("long").alias("category_id"), have["category_code"].cast("string").alias("category_code"), have["brand"].cast("string").alias("brand"), have["price"].cast("double").alias("price")), "product_id", order)
    u = lambda k: uniform(seed + k, "product_id")
    parts = F.split("category_code", r"\.")
    dotted = F.coalesce(F.contains("category_code", F.lit(".")), F.lit(False))
    main = F.when(dotted, parts[0]).otherwise("uncategorized")
    out = first.withColumns(
        {
            "category_code": F.coalesce("category_code", F.lit("unknown")),
            "brand": F.coalesce("brand", F.lit("Generic")),
            "category_name": F.initcap(main),
            "subcategory": F.when(dotted, parts[1]).otherwise(""),
            "original_price": F.col("price"),
            "discount_percent": pick(u(3), list(range(0, 26, 5)), [n / 100 for n in (50, 20, 15, 10, 3, 2)]),
            "rating": F.round(3.0 + 2.0 * u(4), 1),
            "num_reviews": F.floor(u(5) * 1000).cast("int"),
            "in_stock": u(6) < 0.85,
        }
    )
    cut = F.round(F.col("original_price") * F.col("discount_percent") / 100, 2)
    name = F.concat_ws(" ", "brand", "category_name", F.lit("Model"), (F.floor(u(7) * 900) + 100).cast("string"))
    return out.withColumns({"product_name": name, "final_price": F.round(F.col("original_price") - cut, 2)}).select(*PRODUCT.fieldNames())


def minimal_catalog(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    u = uniform(seed, "product_id")
    return spark.range(1, n + 1).withColumnRenamed("id", "product_id").select(
        "product_id", F.concat(F.lit("Product "), "product_id").alias("product_name"), pick(u, ["Electronics", "Clothing", "Home", "Sports"]).alias("category_name"),
        F.lit("electronics.smartphone").alias("category_code"), F.lit("smartphone").alias("subcategory"),
    )


HIERARCHY = {
    (1, "Electronics", "devices and what belongs to them"): [("Smartphones", "telephones"), ("Laptops", "portable computers"), ("Audio", "sound")],
    (2, "Clothing", "things to wear"): [("Men", "for men"), ("Women", "for women"), ("Kids", "for children")],
    (3, "Home", "for the house"): [("Furniture", "tables, beds and chairs"), ("Kitchen", "for cooking")],
    (4, "Sports", "for exercise"): [("Fitness", "for training"), ("Outdoor", "for the open air")],
}


def category_hierarchy(spark: SparkSession) -> DataFrame:
    """Four categories and their ten subcategories; subcategories are numbered from a hundred times their parent."""
    rows = []
    for (number, name, text), below in HIERARCHY.items():
        rows.append((number, name, None, 1, text))
        rows += [(100 * number + k, child, name, 2, what) for k, (child, what) in enumerate(below, 1)]
    return spark.createDataFrame(rows, CATEGORY)


#: archetype: (sessions, least and most events, seconds between events, shares of view, cart, purchase)
ARCHETYPES = {
    "bouncer": (15, 1, 2, 10.0, (1.0, 0.0, 0.0)),
    "browser": (15, 4, 10, 48.0, (0.8, 0.2, 0.0)),
    "engaged_shopper": (10, 10, 30, 54.0, (0.6, 0.25, 0.15)),
    "power_user": (8, 30, 50, 72.0, (0.5, 0.3, 0.2)),
}


def sessions(spark: SparkSession, start: str = "2019-10-01 00:00:00", seed: int = 42, scale: int = 1) -> DataFrame:
    """Raw events of sessions of each archetype, times in the zoned clock form. The label is what was meant, not what a classifier must find."""
    out = None
    for n, (name, (count, low, high, gap, shares)) in enumerate(ARCHETYPES.items()):
        s = spark.range(count * scale).select((F.col("id") + n * 1_000_000).alias("user_id"))
        size = (low + F.floor(uniform(seed, "user_id") * (high - low + 1))).cast("int")
        e = s.withColumn("n", size).select("user_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        u = lambda k: uniform(seed + k, "user_id", "k")
        at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.pmod("user_id", F.lit(1000)) * 3600 + F.col("k") * gap)
        rows = e.select(
            F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
            F.when(F.col("k") == 0, "view").otherwise(pick(u(1), ["view", "cart", "purchase"], list(shares))).alias("event_type"),
            (1_001_000 + F.floor(u(2) * 200)).cast("long").alias("product_id"),
            F.lit(1).cast("long").alias("category_id"),
            pick(u(3), ["electronics.smartphone", "appliances.kitchen"]).alias("category_code"),
            pick(u(4), ["alpha", "beta", "gamma"]).alias("brand"),
            F.round(50 + 450 * u(5), 2).alias("price"),
            "user_id",
            F.concat(F.lit(f"{name}-"), F.col("user_id").cast("string")).alias("user_session"),
            F.lit(name).alias("archetype"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
