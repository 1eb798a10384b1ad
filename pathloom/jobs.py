"""The batch jobs end to end, over Collections: what a scheduler would call."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.model import CooccurrenceSettings, FeatureSettings, RankSettings
from pathloom.operators import events as E
from pathloom.operators import learning as L
from pathloom.operators import metrics as M
from pathloom.operators import recommend as R
from pathloom.operators import sessions as S
from pathloom.sources import sinks
from pathloom.sources.readers import Collections


def journey(events: DataFrame, tables: Collections, at: datetime.datetime | None = None, layout: str | None = None) -> DataFrame:
    """Appends a run of funnel metrics; with a layout folder, also the events by date and type."""
    wanted = E.funnel_events(events)
    if layout:
        sinks.partitioned(E.with_date(wanted), layout)
    counts = S.strict_funnel(S.session_steps(wanted))
    made = S.funnel_metrics(counts, at or datetime.datetime.now())
    tables.write(made, "journey_metrics", "append")
    return made


def analytics(events: DataFrame, tables: Collections, cutoff: str, settings: FeatureSettings = FeatureSettings(), trees: int = 100, depth: int = 10) -> dict[str, Exception]:
    """User features, segments, churn, trends and category statistics; returns the tables that failed."""
    ready = E.derived_columns(E.usable_events(events)).persist()
    try:
        features = M.user_features(ready, settings).persist()
        segments = L.segment_customers(features).rows.select(*L.SEGMENT_COLUMNS)
        churn = L.predict_churn(L.churn_rows(ready, cutoff, settings), trees=trees, depth=depth).predictions
        made = {"user_features": features, "customer_segments": segments, "churn_predictions": churn, "time_series": M.daily_trends(M.daily_metrics(ready)), "category_statistics": M.category_statistics(ready)}
        failed = tables.write_all(made)
        features.unpersist()
        return failed
    finally:
        ready.unpersist()


def recommender(events: DataFrame, tables: Collections, co: CooccurrenceSettings = CooccurrenceSettings(), rank: RankSettings = RankSettings(), model_path: str | None = None, key: list[str] | None = None, sample: int | None = None) -> L.Propensity:
    """Candidates, the purchase model, and the ranked lists by product, replaced by key.

    The model's test rows are told by `key` (by default the columns that name an event). `sample` bounds the model's rows."""
    key = key or [c for c in ("event_id", "user_id", "user_session", "product_id", "event_timestamp", "event_type") if c in events.columns]
    used = E.interactions(events, co)
    tables.write(R.candidates(used, co), "candidates", "overwrite")
    tables.write(R.product_features(used), "product_features", "overwrite")
    rows = E.model_rows(events, key)
    model = L.train_propensity(E.sample_rows(rows, sample, key="row_key") if sample else rows, rank.top_values)
    if model_path:
        model.save(model_path)
    spark: SparkSession = events.sparkSession
    features = R.candidate_features(tables.read(spark, "candidates"), tables.read(spark, "product_features"))
    ranked = R.top_recommendations(R.final_scores(model.score(features), rank), rank)
    lists = R.recommendation_lists(ranked, F.current_timestamp())
    sinks.upsert(lists, f"{tables.root}/recommendations", ["product_id"])
    return model
