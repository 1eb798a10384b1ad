"""The batch jobs over the test tables, and the service that reads what they wrote."""

import datetime
import json

import pytest

from pathloom import jobs
from pathloom.model import FeatureSettings
from pathloom.serving_app import App
from pathloom.sources import testdata as D
from pathloom.sources.readers import Collections

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    tables = Collections(str(root))
    events = D.enriched(spark, DATA)
    for day in (1, 2):
        jobs.journey(events, tables, datetime.datetime(2024, 2, day), str(root / "layout") if day == 1 else None)
    assert jobs.analytics(events, tables, "2024-01-29 12:00:00", FeatureSettings("2024-01-31", 1), trees=3, depth=3) == {}
    jobs.recommender(events, tables)
    tables.write(events, "enriched_events")
    tables.write(D.products(spark, DATA).withColumn("price", D.F.col("original_price")), "product_catalog")
    return App(spark, tables)


def test_answers(app):
    status, body = app.answer("/api/overview")
    assert status == 200 and body["overview"] == {"events": 10_000, "users": 150, "products": 2000, "segments": 150} and len(body["funnel"]) == 8
    assert {m["analysis_timestamp"][:10] for m in app.answer("/api/funnel")[1]["metrics"]} == {"2024-02-02"}
    segments = app.answer("/api/segments")[1]
    assert sum(s["user_count"] for s in segments["segments"]) == 150 and len(segments["top_users"]) == 20
    churn = app.answer("/api/churn")[1]
    assert churn["stats"]["total_users"] == 150 and len(churn["high_risk_users"]) <= 50
    assert len(app.answer("/api/trends")[1]["trends"]) == 100
    user = app.answer("/api/user/3")[1]
    assert user["features"]["user_id"] == 3 and user["segment"] and user["churn"]
    assert app.answer("/api/user/999999")[1]["features"] is None
    assert app.answer("/product/7")[1]["product"]["product_id"] == 7
    page = app.answer("/api/products", {"skip": "20", "limit": "5"})[1]
    assert [p["product_id"] for p in page["products"]] == [20, 21, 22, 23, 24] and page["total"] == 2000
    recs = app.answer("/api/recommend", {"product_id": "7"})[1]["recommendations"]
    assert len(recs) == 5 and len({r["rec_product_id"] for r in recs}) == 5


def test_errors(app):
    assert app.answer("/api/recommend")[0] == 400 and app.answer("/api/user/x")[0] == 400 and app.answer("/api/products", {"skip": "-1"})[0] == 400
    assert app.answer("/product/none")[0] == 404 and app.answer("/nothing")[0] == 404
    said = []
    body = app({"PATH_INFO": "/api/recommend", "QUERY_STRING": ""}, lambda s, h: said.append(s))
    assert said == ["400 Bad Request"] and json.loads(body[0])["success"] is False


def test_bounds_of_requests(app):
    for name, query in [("/api/products", {"limit": "100000"}), ("/api/products", {"limit": "x"}), ("/api/recommend", {"product_id": "7", "top_n": "0"}), ("/api/recommend", {"product_id": "7", "top_n": "many"}), ("/api/recommend", {"product_id": "7", "top_n": "100000"})]:
        assert app.answer(name, query)[0] == 400, query
    assert len(app.answer("/api/recommend", {"product_id": "7", "top_n": "3"})[1]["recommendations"]) == 3


def test_commands(spark, tmp_path, monkeypatch):
    from pathloom import __main__ as M

    monkeypatch.setenv("PATHLOOM_ROOT", str(tmp_path / "tables"))
    monkeypatch.setenv("PATHLOOM_CHECKPOINTS", str(tmp_path / "ck"))
    text = json.dumps({"event_time": "2024-01-01 12:00:00 UTC", "event_type": "view", "product_id": 1, "price": 2.0, "user_id": 1, "user_session": "s"})
    spark.createDataFrame([(text, datetime.datetime(2024, 1, 1))], "value string, timestamp timestamp").write.parquet(str(tmp_path / "in"))
    assert M.main(["stream", "--folder", str(tmp_path / "in"), "--once"], spark) == 0
    assert M.main(["journey", "--layout", str(tmp_path / "layout")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "tables/journey_metrics")).count() == 8 and spark.read.parquet(str(tmp_path / "layout")).count() == 1
    with pytest.raises(SystemExit):
        M.main(["no such job"], spark)
