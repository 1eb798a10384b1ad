"""python -m pathloom JOB: what a scheduler calls. Folders and servers come from the environment (see pathloom.settings)."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pathloom import jobs, serving_app
from pathloom.functions import expressions as X
from pathloom.model import EVENT
from pathloom.session import create_batch_session, create_streaming_session, settings_from_environment
from pathloom.settings import Deployment
from pathloom.sources import readers, replay
from pathloom.sources.readers import Collections
from pathloom.streaming import pipeline


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    what = out.add_subparsers(dest="job", required=True)
    one = what.add_parser("journey", help="append a run of funnel metrics")
    one.add_argument("--layout", help="also write the events there, by date and type")
    one = what.add_parser("analytics", help="user features, segments, churn, trends and category statistics")
    one.add_argument("--cutoff", required=True, help="churn features are from before it, the label from after")
    one = what.add_parser("recommender", help="candidates, purchase model and ranked lists")
    one.add_argument("--model", help="folder to save the model in")
    one.add_argument("--sample", type=int, help="at most so many rows for the model")
    one = what.add_parser("stream", help="the streaming pipeline over the Kafka topic or a folder of messages")
    one.add_argument("--folder", help="Parquet files of messages (value, timestamp) instead of Kafka")
    one.add_argument("--once", action="store_true", help="work on what is there and end")
    one = what.add_parser("replay", help="send recorded events of a CSV file to Kafka at a steady pace")
    one.add_argument("file")
    what.add_parser("serve", help="the JSON service over the result tables")
    return out


def main(args: list[str] | None = None, spark=None) -> int:
    given, place = parser().parse_args(args), Deployment.from_environment()
    settings = replace(settings_from_environment(), tables_root=place.root)
    spark = spark or (create_streaming_session if given.job == "stream" else create_batch_session)(settings)
    tables = Collections.of_session(spark, place.root, place.format)
    if given.job == "journey":
        jobs.journey(tables.read(spark, "enriched_events"), tables, layout=given.layout)
    elif given.job == "analytics":
        failed = jobs.analytics(tables.read(spark, "enriched_events"), tables, given.cutoff)
        for name, error in failed.items():
            print(f"{name}: {error}", file=sys.stderr)
        return int(bool(failed))
    elif given.job == "recommender":
        jobs.recommender(tables.read(spark, "enriched_events"), tables, model_path=given.model, sample=given.sample)
    elif given.job == "stream":
        source = readers.file_stream(spark, given.folder, readers.MESSAGE) if given.folder else readers.Kafka(place.servers, place.topic).read_stream(spark)
        products = f"{place.data}/products.csv"
        running = pipeline.run(
            spark, source, pipeline.StreamSettings(place.checkpoints, place.root, place.trigger, given.once),
            readers.product_dimension(spark, products) if readers.exists(spark, products) else None, readers.user_dimension(spark, f"{place.data}/users.csv"),
        )
        if given.once:
            for q in running:
                q.awaitTermination()
        else:
            pipeline.monitor(running)
    elif given.job == "replay":
        topic = readers.Kafka(place.servers, place.topic)
        events = readers.csv(spark, given.file, EVENT)
        n = replay.replay(events.withColumn("at", X.parse_time("event_time")), lambda df: topic.write_batch(df.drop("at"), "user_id"), ["at"], place.chunk_rows, place.pause_seconds, place.retries)
        print(f"{n} events sent")
    else:
        serving_app.serve(spark, tables, place.host, place.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
