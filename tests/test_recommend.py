import datetime
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pathloom.model import CooccurrenceSettings
from pathloom.operators import events as E
from pathloom.operators import recommend as R
from pathloom.operators import serving as Q
from pathloom.plans import registry
from pathloom.sources import testdata as D

T0 = datetime.datetime(2024, 1, 1)


def clicks(spark, rows):
    return E.interactions(spark.createDataFrame([(s, p, t, str(T0 + datetime.timedelta(seconds=k)), "1.5", "b", "c.d") for k, (s, p, t) in enumerate(rows)], "user_session string, product_id string, event_type string, event_time string, price string, brand string, category_code string"))


def test_pairs_by_brute_force_and_symmetry(spark):
    rows = [(f"s{k % 4}", f"p{k * 7 % 9}", "Purchase" if k % 3 == 0 else "view") for k in range(40)] + [("s1", "p1", "cart"), (None, "p1", "view"), ("s1", None, "view")]
    w = {}
    for s, p, t in rows[:40]:
        w[s, p] = max(w.get((s, p), 0), 5.0 if t.lower() == "purchase" else 1.0)
    want = {}
    for s in {s for s, _ in w}:
        for a, b in combinations(sorted(p for x, p in w if x == s), 2):
            want[a, b] = want.get((a, b), 0) + w[s, a] + w[s, b]
    got = {(r.product_id, r.cand_product_id): r.related_score for r in R.candidates(clicks(spark, rows)).collect()}
    assert got == want | {(b, a): v for (a, b), v in want.items()}


def test_bounds_keep_the_latest_events_and_drop_large_sessions(spark):
    rows = [("a", f"p{k}", "view") for k in range(6)] + [("b", f"q{k}", "view") for k in range(2)]
    s = CooccurrenceSettings(events_per_session=3, items_per_session=2)
    latest = R.latest_per_session(clicks(spark, rows), s)
    assert {r.product_id for r in latest.collect()} == {"p3", "p4", "p5", "q0", "q1"}
    assert {r.product_id for r in R.bounded_sessions(R.item_weights(latest), s).collect()} == {"q0", "q1"}
    assert R.candidates(clicks(spark, rows), CooccurrenceSettings(per_item=1)).filter("product_id = 'p0'").first().cand_product_id == "p1"


def test_pairs_need_one_shuffle_of_sessions(spark):
    plan = R.pair_scores(R.bounded_sessions(R.item_weights(R.latest_per_session(clicks(spark, [("a", "p", "view")])))))
    plan.count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedExchange") >= 1 or text.count("hashpartitioning(user_session") <= 2


def test_ranking_ties_and_lists(spark):
    scored = R.final_scores(spark.createDataFrame([("a", f"c{k}", 0.0 if k else 1.0, 0.5) for k in range(4)], "product_id string, cand_product_id string, related_score double, p_buy double"))
    ranked = R.top_recommendations(scored)
    assert [r.cand_product_id for r in ranked.orderBy("rank").collect()] == ["c0", "c1", "c2", "c3"]
    recs = R.recommendation_lists(ranked, F.lit(T0)).first()
    assert [x.product_id for x in recs.recs] == ["c0", "c3", "c2", "c1"] and recs.updated_at == "2024-01-01T00:00:00"


def test_rare_values_and_vocabulary(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("z",), (None,)], "brand string")
    v = R.frequent_values(df, "brand", 2)
    assert [(r.value, r.n) for r in v.collect()] == [("x", 2), ("y", 1)]
    assert sorted(r.brand for r in R.bucket_rare(df, "brand", v, "OTHER").collect()) == ["OTHER", "OTHER", "x", "x", "y"]


def catalog(spark):
    rows = [(k, f"n{k}", "A" if k < 5 else "B", "x" if k % 2 else "y", float(k)) for k in range(1, 11)]
    return spark.createDataFrame(rows, "product_id long, product_name string, category_name string, brand string, price double")


def ids(df, product):
    return [r.rec_product_id for r in df.filter(F.col("product_id") == product).orderBy("position").collect()]


def test_cold_starts(spark):
    recs = spark.createDataFrame([("1", [(0.987, "9", 0.1, 1.0), (0.5, "77", 0.1, 1.0)])], "product_id string, recs array<struct<score: double, product_id: string, p_buy: double, related_score: double>>")
    wanted = spark.createDataFrame([("1",), ("2",), ("unknown",)], "product_id string")
    out = R.recommendations(recs, catalog(spark), wanted, 5)
    assert ids(out, "1") == ["9", "77", "2", "3", "4"]
    assert ids(out, "2") == ["1", "3", "4", "6", "5"]  # category, brand (4 is in both), then any
    assert ids(out, "unknown") == ["1", "2", "3", "4", "5"]
    first = out.filter("product_id = '1' and rec_product_id = '9'").first()
    assert (first.confidence, first.product_name, first.source) == (0.99, "n9", "model")
    assert out.filter("rec_product_id = '77'").first().product_name == "Unknown"


def test_small_catalogue_gives_what_there_is(spark):
    two = catalog(spark).limit(2)
    wanted = spark.createDataFrame([("1",)], "product_id string")
    assert len(ids(R.heuristic_recommendations(two, wanted, 5), "1")) == 1


def test_pages_and_single_products(spark):
    c = catalog(spark).withColumn("price", F.when(F.col("product_id") == 3, F.lit(float("nan"))).otherwise(F.col("price")))
    page = Q.product_page(c, 2, 3).orderBy("product_id").collect()
    assert [r.product_id for r in page] == [3, 4, 5] and page[0].price is None and page[0].total == 10
    assert Q.product(c, "4").count() == 1 and Q.product(c, "400").count() == 0


def test_churn_rate_of_nobody(spark):
    empty = spark.createDataFrame([], "user_id long, churn_prediction double, total_spent double")
    assert Q.churn_rate(empty).first().churn_rate == 0.0 and Q.at_risk(empty).count() == 0


@pytest.mark.parametrize("name", ["a17_item_weights", "j3_bounded_sessions", "a19_pair_scores", "u1_both_ways", "w2_candidates", "m_product_affinity", "j6_candidate_features", "m13_final_scores", "w3_top_recommendations", "a20_recommendation_lists", "q10_recommendations"])
def test_tasks_follow_the_input_and_rows_stay(spark, name):
    query, small = registry.queries()[name], "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    want = rows(query(spark, small))
    spark.conf.set("spark.pathloom.taskBytes", 8192)
    try:
        many = query(spark, small)
        plan = many._jdf.queryExecution().executedPlan().toString()
        # 15 parts or more of a lineitem of 116 kB, and no shuffle of sessions, pairs or candidates by the session's 4 partitions
        assert re.search(r"hashpartitioning\(user_session#\d+, [1-9]\d+\), REPARTITION_BY_NUM", plan)
        assert not re.search(r"hashpartitioning\((user_session|product_a|cand_product_id)[^)]*, 4\)", plan) and "SortMergeJoin [user_session" not in plan
        assert rows(many) == want
    finally:
        spark.conf.unset("spark.pathloom.taskBytes")


@pytest.mark.parametrize("name", ["a17_item_weights", "j3_bounded_sessions", "a19_pair_scores", "u1_both_ways", "m_product_affinity"])
def test_adaptive_execution_joins_no_tasks_of_large_sessions_again(spark, name):
    """With more partitions in the session than tasks by the input, their shuffles were left to adaptive execution, which made few of them."""
    query, small = registry.queries()[name], "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(query(spark, small))
    spark.conf.set("spark.pathloom.taskBytes", 8192)
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        many = query(spark, small)
        assert many.rdd.getNumPartitions() >= 15 and rows(many) == want
    finally:
        spark.conf.unset("spark.pathloom.taskBytes")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_only_pairs_with_a_wanted_product_are_made(spark):
    rows = clicks(spark, [(f"s{k % 5}", f"p{k * 7 % 9}", "view") for k in range(60)])
    wanted = spark.createDataFrame([("p3",), ("none",)], "product_id string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(R.candidates(rows, wanted=wanted)) == key(R.candidates(rows).filter("product_id = 'p3'"))
    items = R.item_weights(rows).withColumn("asked", F.col("product_id") == "p3")
    pairs = R.session_pairs(items, "asked").collect()
    assert pairs and all("p3" in (r.product_a, r.product_b) and r.product_a < r.product_b for r in pairs)


@pytest.mark.parametrize("name", ["w2_candidates", "j6_candidate_features", "m13_final_scores", "a20_recommendation_lists", "m12_purchase_propensity"])
def test_candidates_move_lists_once_and_ids_as_numbers(spark, name):
    """Pairs aren't moved by pair and again by product, and nothing is keyed by products' ids as text."""
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    kinds = {str(e.dataType()) for e in keys_of_shuffles(df._jdf.queryExecution().optimizedPlan()) if e.name() in ("product_id", "cand_product_id")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "product_a" not in plan and kinds == {"LongType"}, (plan, kinds)


def keys_of_shuffles(plan):
    """Attributes that windows and aggregates of a plan group by."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        keys = {"Window": "partitionSpec", "Aggregate": "groupingExpressions"}.get(node.nodeName())
        if keys:
            found = getattr(node, keys)()
            out += [found.apply(k) for k in range(found.size()) if hasattr(found.apply(k), "name")]
    return [e for e in out if e.getClass().getSimpleName() == "AttributeReference"]


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Lines of a product that isn't there, that stands there twice, that lacks a brand, with ties of time and without a price."""
    day = lambda k: T0 + datetime.timedelta(days=k)
    lines = [(o, p, flag, day(k % 3), price) for k, (o, p, flag, price) in enumerate([(1, 10, "R", 5.0), (1, 9, "N", None), (1, 10, "N", 7.0), (2, 9, "N", 2.0), (2, 9, "N", 3.0), (2, 77, "R", 1.0), (3, 11, "N", 4.0), (3, 10, "N", 9.0), (3, 9, "R", 8.0), (None, 9, "N", 1.0), (3, None, "N", 1.0)])]
    lines += [(4, p, "N", day(1), 6.0) for p in (9, 10, 11, 77)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_shipdate timestamp, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(9, "n", "B#1", "T1", 1.0), (9, "n", "B#2", "T0", 1.0), (9, "n", None, "T9", 1.0), (10, "n", "B#3", "T2", 1.0), (11, "n", None, "T3", 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_products_that_repeat_or_are_missing_count_as_in_the_join(spark, odd_tables):
    rows = lambda df: sorted(map(repr, df.collect()))
    columns = ["user_session", "product_id", "event_type", "event_ts", "price", "weight"]
    joined, bare = D.baskets(spark, odd_tables), R.X.with_text(D.bare_baskets(spark, odd_tables), "product_id")
    assert rows(bare.select(columns)) == rows(joined.select(columns)) and bare.count() > 15
    assert rows(registry.queries()["u3_product_features"](spark, odd_tables)) == rows(R.product_features(joined))
    assert rows(registry.queries()["w2_candidates"](spark, odd_tables)) == rows(R.candidates(joined))
    for few in (1, 2):  # bounds that bite; ties by the ids' text, where 10 comes before 9
        s = CooccurrenceSettings(events_per_session=few + 1, items_per_session=3, per_item=few)
        assert rows(R.X.with_text(R.candidates(D.bare_baskets(spark, odd_tables), s), "product_id", "cand_product_id")) == rows(R.candidates(joined, s))


def test_partner_scores_are_pair_scores_both_ways(spark):
    items = R.item_weights(clicks(spark, [(f"s{k % 7}", f"p{k * 11 % 13}", "purchase" if k % 3 else "view") for k in range(90)]))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(R.partner_scores(R.partners(items))) == key(R.both_ways(R.pair_scores(items)))
