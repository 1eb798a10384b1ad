"""Item-to-item candidates from sessions, frequent values, and the final ranking."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from pathloom.functions import expressions as X
from pathloom.model import CooccurrenceSettings, RankSettings


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; the filter on row_number becomes a limit before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_session(interactions: DataFrame, s: CooccurrenceSettings = CooccurrenceSettings()) -> DataFrame:
    """The last events_per_session events of each session; ties by product, type and weight. Ids of products may be numbers, here and below: they
    move faster than text, and their order is that of text."""
    return top_per_group(X.spread(interactions, "user_session"), ["user_session"], [F.desc("event_ts"), X.in_text_order("product_id"), F.asc("event_type")], s.events_per_session)


def item_weights(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy(["user_session", "product_id"]).agg(F.expr("max(weight)").alias("w_item"))


def in_session() -> WindowSpec:
    """A session's items by id. What is made over them shares one sort."""
    return Window.partitionBy("user_session").orderBy(X.in_text_order("product_id"))


def whole_session() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def bounded_sessions(items: DataFrame, s: CooccurrenceSettings = CooccurrenceSettings()) -> DataFrame:
    """Items of sessions with at most items_per_session of them; a window over the same key needs no join."""
    return items.withColumn("n_items", F.count(F.lit(1)).over(whole_session())).filter(F.col("n_items") <= s.items_per_session)


def session_pairs(items: DataFrame, asked: str | None = None) -> DataFrame:
    """product_a < product_b in one session with their weights; with a column of flags, pairs with a flagged item only.

    Each item meets those that come after it in its session, so that sessions are moved and sorted once, without a join."""
    flags = [asked] if asked else []
    later = F.collect_list(F.struct("product_id", "w_item", *flags)).over(in_session().rowsBetween(1, Window.unboundedFollowing))
    met = items.select("user_session", F.col("product_id").alias("product_a"), F.col("w_item").alias("w_a"), *[F.col(c).alias("asked_a") for c in flags], later.alias("later"))
    pairs = met.select("*", F.explode("later").alias("b")).filter("product_a <> b.product_id")
    if asked:
        pairs = pairs.filter(f"asked_a or b.{asked}")
    return pairs.selectExpr("user_session", "product_a", "w_a", "b.product_id AS product_b", "b.w_item AS w_b")


def by_pair(pairs: DataFrame) -> GroupedData:
    return X.spread(pairs, "product_a", "product_b").groupBy("product_a", "product_b")


def pair_scores(items: DataFrame, asked: str | None = None) -> DataFrame:
    """The sum over sessions of both weights, for each pair."""
    return by_pair(session_pairs(items, asked)).agg(F.expr("sum(w_a + w_b)").alias("related_score"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions: one pass with two rows for each, rather than a union that reads twice."""
    sides = F.array(F.struct(F.col("product_a").alias("product_id"), F.col("product_b").alias("cand_product_id")), F.struct(F.col("product_b").alias("product_id"), F.col("product_a").alias("cand_product_id")))
    return pairs.select(F.explode(sides).alias("s"), "related_score").select("s.product_id", "s.cand_product_id", "related_score")


def partners(items: DataFrame) -> DataFrame:
    """Each item with all items of its session, itself too; those of sessions of one are left out."""
    met = F.collect_list(F.struct("product_id", "w_item")).over(whole_session())
    return items.withColumn("met", met).filter(F.size("met") > 1)


def partner_scores(lists: DataFrame) -> DataFrame:
    """both_ways(pair_scores()) from partners(): a product's lists are moved, not its pairs, and once, to where its partners are ranked."""
    moved = X.spread(lists.select("product_id", "w_item", "met"), "product_id")
    pairs = moved.select("product_id", "w_item", F.explode("met").alias("b")).filter("product_id <> b.product_id")
    pairs = pairs.selectExpr("product_id", "b.product_id AS cand_product_id", "w_item + b.w_item AS w")
    return pairs.groupBy("product_id", "cand_product_id").agg(F.sum("w").alias("related_score"))


def candidates(interactions: DataFrame, s: CooccurrenceSettings = CooccurrenceSettings(), wanted: DataFrame | None = None) -> DataFrame:
    """product_id, cand_product_id, related_score: the best per_item partners of each product, or of the wanted ones only."""
    items = bounded_sessions(item_weights(latest_per_session(interactions, s)), s)
    few = None if wanted is None else wanted.select("product_id").distinct()
    if few is not None and X.is_small(few):
        few = F.broadcast(few)  # only lists of wanted products are moved
    lists = partners(items)
    pairs = partner_scores(lists if few is None else lists.join(few, "product_id", "left_semi"))
    return top_per_group(pairs, ["product_id"], [F.desc("related_score"), X.in_text_order("cand_product_id")], s.per_item)


def product_features(interactions: DataFrame) -> DataFrame:
    """brand, category_code and price of each product from its latest complete event."""
    rows = interactions.dropna(subset=X.TRAITS)
    latest = F.max(F.struct("event_ts", *X.TRAITS)).alias("m")
    return rows.groupBy("product_id").agg(latest).select("product_id", *[f"m.{c}" for c in X.TRAITS])


def features_of_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """product_features() of lines joined with products, where only these have brand and category_code. All lines of a product meet
    the same rows of it, so that the best of each side make the best of all: lines are reduced before they meet any text."""
    latest = lines.filter("event_ts is not null and price is not null").groupBy("product_id").agg(F.max(F.struct("event_ts", "price")).alias("m"))
    traits = products.dropna(subset=X.TRAITS[:2]).groupBy("product_id").agg(F.max(F.struct(*X.TRAITS[:2])).alias("t"))
    return latest.join(traits, "product_id").select("product_id", "t.brand", "t.category_code", "m.price")


def frequent_values(df: DataFrame, column: str, k: int = 200) -> DataFrame:
    """The k most frequent values (ties by value): value, n."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def bucket_rare(df: DataFrame, column: str, vocabulary: DataFrame, other: str) -> DataFrame:
    """Values outside of the vocabulary, and nulls, become `other`; at most k rows are broadcast."""
    known = F.broadcast(vocabulary.select(F.col("value").alias("__value")))
    joined = df.join(known, F.col(column) == F.col("__value"), "left")
    return joined.withColumn(column, F.coalesce("__value", F.lit(other))).drop("__value")


def candidate_features(cands: DataFrame, features: DataFrame) -> DataFrame:
    """Candidates with complete features of the candidate; others are left out."""
    right = features.dropna(subset=X.TRAITS).withColumnRenamed("product_id", "cand_product_id")
    parts = X.parts_for(cands)
    if not parts:
        return cands.join(right, "cand_product_id")
    # a part of the features is small and has one row a product: the many candidates needn't be sorted by it
    left, right = (X.spread(side, "cand_product_id", parts=parts) for side in (cands, right))
    return left.join(right.hint("shuffle_hash"), "cand_product_id")


def probability_of_buying(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p_buy", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))


def final_scores(scored: DataFrame, s: RankSettings = RankSettings()) -> DataFrame:
    return scored.withColumn("score", s.related_weight * F.log1p("related_score") + s.buy_weight * F.col("p_buy"))


def top_recommendations(scored: DataFrame, s: RankSettings = RankSettings()) -> DataFrame:
    return top_per_group(X.spread(scored, "product_id"), ["product_id"], [F.desc("score"), X.in_text_order("cand_product_id")], s.top_final, "rank")


def recommendation_lists(ranked: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """One row a product: its recommendations as structs, best first; equal scores by the larger id."""
    entry = F.expr("named_struct('score', score, 'product_id', cand_product_id, 'p_buy', p_buy, 'related_score', related_score)")
    listed = F.collect_list(entry)
    out = ranked.groupBy("product_id").agg(F.sort_array(listed, asc=False).alias("recs"))
    stamp = F.current_timestamp() if updated_at is None else updated_at
    return out.withColumn("updated_at", F.date_format(stamp, X.WRITTEN))


def product_affinity(interactions: DataFrame, s: CooccurrenceSettings = CooccurrenceSettings()) -> DataFrame:
    """Scores of unordered pairs together with the sessions that hold both."""
    items = bounded_sessions(item_weights(latest_per_session(interactions, s)), s)
    return by_pair(session_pairs(items)).agg(F.count(F.lit(1)).alias("sessions"), F.expr("sum(w_a + w_b)").alias("related_score"))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first by order."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def stored_recommendations(recs: DataFrame, catalog: DataFrame, wanted: DataFrame, top_n: int) -> DataFrame:
    """The first top_n stored recommendations of each wanted product with catalogue columns."""
    asked = recs.join(X.small_side(wanted.select("product_id").distinct()), "product_id", "left_semi")
    flat = asked.select("product_id", F.posexplode(F.slice("recs", 1, top_n)).alias("rank", "r"))
    items = flat.select("product_id", "rank", F.col("r.product_id").alias("rec_product_id"), F.coalesce(F.round("r.score", 2), F.lit(0.8)).alias("confidence"))
    names = catalog.select(X.text("product_id", "rec_product_id"), "product_name", "category_name", "brand", "price")
    joined = items.join(names, "rec_product_id", "left")
    return joined.select(
        "product_id", "rec_product_id", F.coalesce("product_name", F.lit("Unknown")).alias("product_name"), F.coalesce("category_name", F.lit("")).alias("category_name"),
        F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("price", F.lit(0.0)).alias("price"), "confidence", F.lit("model").alias("source"), F.lit(0).alias("tier"), "rank",
    )


def heuristic_recommendations(catalog: DataFrame, wanted: DataFrame, top_n: int, seed: int | None = None) -> DataFrame:
    """For each wanted product: up to three of its category (0.85), two of its brand (0.70), then any (0.50), each product once.

    An unknown product gets any. `Any` goes by id, or by a seeded hash. The pick of each tier is
    made once for each category and brand that is asked for, so the work follows the catalogue, not wanted times catalogue."""
    items = catalog.select(X.text("product_id", "rec_product_id"), "product_name", "category_name", "brand", "price")
    order = F.xxhash64("rec_product_id", F.lit(seed)) if seed is not None else F.length("rec_product_id")
    own = wanted.select(X.text("product_id")).distinct()
    mine = own.join(items.select(F.col("rec_product_id").alias("product_id"), "category_name", "brand"), "product_id", "left")

    def tier(by: str, n: int, level: int, confidence: float) -> DataFrame:
        best = top_per_group(items.filter(F.col(by).isNotNull()), [by], [order, F.asc("rec_product_id")], n + 1, "place")
        found = mine.select("product_id", by).join(best, by).filter("product_id <> rec_product_id")
        ranked = top_per_group(found, ["product_id"], [F.asc("place")], n, "rank")
        return ranked.select("product_id", "rec_product_id", "product_name", "category_name", "brand", "price", F.lit(confidence).alias("confidence"), F.lit(level).alias("tier"), "rank")

    anyone = items.orderBy(order, "rec_product_id").limit(top_n + 6).withColumn("rank", F.row_number().over(Window.orderBy(order, "rec_product_id")))
    # a list of top_n + 6 rows
    rest = own.crossJoin(F.broadcast(anyone)).filter("product_id <> rec_product_id").select("product_id", "rec_product_id", "product_name", "category_name", "brand", "price", F.lit(0.5).alias("confidence"), F.lit(3).alias("tier"), "rank")
    out = tier("category_name", 3, 1, 0.85).unionByName(tier("brand", 2, 2, 0.70)).unionByName(rest)
    return first_tiers(out.withColumn("source", F.lit("heuristic")), top_n)


def first_tiers(recs: DataFrame, top_n: int) -> DataFrame:
    """Each recommended product once, in its best tier, and the first top_n of those."""
    once = top_per_group(recs, ["product_id", "rec_product_id"], [F.asc("tier"), F.asc("rank")], 1)
    return top_per_group(once, ["product_id"], [F.asc("tier"), F.asc("rank"), F.asc("rec_product_id")], top_n, "position").drop("rank")


def recommendations(recs: DataFrame, catalog: DataFrame, wanted: DataFrame, top_n: int = 5) -> DataFrame:
    """Stored ones first, filled up by the heuristic without repeating a product; a product without any gets all from the heuristic."""
    wanted = wanted.select(X.text("product_id"))
    stored = stored_recommendations(recs, catalog, wanted, top_n)
    fill = heuristic_recommendations(catalog, wanted, top_n).withColumnRenamed("position", "rank")
    return first_tiers(stored.unionByName(fill.select(*stored.columns)), top_n)


def random_products(catalog: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return catalog.orderBy(F.rand(seed)).limit(n).withColumn("confidence", F.lit(0.5))
