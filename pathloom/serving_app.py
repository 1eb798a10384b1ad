"""The read queries as a JSON service: a WSGI application over Collections, with nothing but the standard library."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators import recommend as R
from pathloom.operators import serving as Q
from pathloom.sources.readers import Collections


#: The most rows of a page and the most recommendations that one request can ask for.
MOST_ROWS, MOST_RECOMMENDATIONS = 200, 50


class BadRequest(Exception):
    pass


class NotFound(Exception):
    pass


def rows(df: DataFrame) -> list[dict]:
    """Result rows as JSON values; the queries above them limit how many there are."""
    return [json.loads(x) for x in df.toJSON().collect()]


def number(query: dict, name: str, default: int, least: int, most: int) -> int:
    try:
        n = int(query.get(name, default))
    except ValueError:
        raise BadRequest(f"{name} is a number") from None
    if not least <= n <= most:
        raise BadRequest(f"{name} is from {least} to {most}")
    return n


class App:
    """Routes to queries. Each answers with `success`, or with an error and status 400, 404 or 500."""

    def __init__(self, spark: SparkSession, tables: Collections):
        self.spark, self.tables = spark, tables
        self.routes: dict[str, Callable] = {
            "overview": self.overview, "funnel": self.funnel, "segments": self.segments, "churn": self.churn, "trends": self.trends,
            "user": self.user, "product": self.product, "products": self.products, "recommend": self.recommend,
        }

    def table(self, name: str) -> DataFrame:
        return self.tables.read(self.spark, name)

    def overview(self, path, query):
        names = {"events": "enriched_events", "users": "user_features", "products": "product_catalog", "segments": "customer_segments"}
        counts = {r.table_name: r.row_count for r in Q.overview({n: self.table(t) for n, t in names.items()}).collect()}
        return {"overview": counts, "funnel": rows(Q.latest_metrics(self.table("journey_metrics")))}

    def funnel(self, path, query):
        return {"metrics": rows(Q.latest_metrics(self.table("journey_metrics")))}

    def segments(self, path, query):
        t = self.table("customer_segments")
        return {"segments": rows(Q.segment_overview(t)), "top_users": rows(Q.top_spenders(t))}

    def churn(self, path, query):
        t = self.table("churn_predictions")
        return {"stats": rows(Q.churn_rate(t))[0], "high_risk_users": rows(Q.at_risk(t))}

    def trends(self, path, query):
        return {"trends": rows(Q.recent_trends(self.table("time_series")))}

    def user(self, path, query):
        try:
            user = int(path[0])
        except (IndexError, ValueError):
            raise BadRequest("a user is a number") from None
        found = {}
        for name, t in (("features", "user_features"), ("segment", "customer_segments"), ("churn", "churn_predictions")):
            one = rows(self.table(t).filter(f"user_id = {user}").limit(1))
            found[name] = one[0] if one else None
        return {"user_id": user} | found

    def product(self, path, query):
        found = rows(Q.product(self.table("product_catalog"), path[0] if path else "").limit(1))
        if not found:
            raise NotFound("no such product")
        return {"product": found[0]}

    def products(self, path, query):
        skip, limit = number(query, "skip", 0, 0, 1 << 31), number(query, "limit", 20, 0, MOST_ROWS)
        catalog = self.table("product_catalog")
        page = rows(Q.product_page(catalog, skip, limit))
        for p in page:
            p.pop("total")
        return {"products": page, "total": catalog.count()}

    def recommend(self, path, query):
        wanted = query.get("product_id") or (path[0] if path else None)
        if not wanted:
            raise BadRequest("product_id is missing")
        asked = self.spark.createDataFrame([(str(wanted),)], "product_id string")
        out = R.recommendations(self.table("recommendations"), self.table("product_catalog"), asked, number(query, "top_n", 5, 1, MOST_RECOMMENDATIONS))
        return {"product_id": str(wanted), "recommendations": rows(out.orderBy("position"))}

    def answer(self, path: str, query: dict | None = None) -> tuple[int, dict]:
        parts = [p for p in path.split("/") if p and p != "api"]
        try:
            if not parts or parts[0] not in self.routes:
                raise NotFound("no such query")
            return 200, {"success": True} | self.routes[parts[0]](parts[1:], query or {})
        except BadRequest as error:
            return 400, {"success": False, "error": str(error)}
        except NotFound as error:
            return 404, {"success": False, "error": str(error)}
        except Exception as error:  # noqa: BLE001
            return 500, {"success": False, "error": str(error).splitlines()[0]}

    def __call__(self, environ, start_response):
        query = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        status, body = self.answer(environ.get("PATH_INFO", "/"), query)
        text = {200: "200 OK", 400: "400 Bad Request", 404: "404 Not Found", 500: "500 Internal Server Error"}[status]
        start_response(text, [("Content-Type", "application/json; charset=utf-8")])
        return [json.dumps(body, ensure_ascii=False).encode()]


def serve(spark: SparkSession, tables: Collections, host: str = "127.0.0.1", port: int = 8080) -> None:
    from wsgiref.simple_server import make_server

    make_server(host, port, App(spark, tables)).serve_forever()
