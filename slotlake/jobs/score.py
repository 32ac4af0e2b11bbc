"""Score payload files: ``score.py BUNDLE REQUESTS OUTPUT``, a folder of feature rows with ``--stream``, or raw
bookings with ``--lake LAKE``, the output of ``etl.py`` that holds restaurants, members and venue statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from slotlake.operators.popularity import VenueStatistics
from slotlake.plans import scoring
from slotlake.plans.etl import features_from_raw
from slotlake.schema import BOOKINGS
from slotlake.session import clear_workspace, get_spark
from slotlake.sources.delimited import read_raw, write_table
from slotlake.sources.payload import read_payload_files
from slotlake.streaming import scorer


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("bundle")
    args.add_argument("requests")
    args.add_argument("output")
    args.add_argument("--stream", action="store_true")
    args.add_argument("--key", default="booking_id")
    args.add_argument("--lake")
    args.add_argument("--encoding", default="UTF-8")
    options = args.parse_args(argv)
    spark = get_spark("slotlake-score")
    bundle = scoring.load_bundle(spark, options.bundle)
    if options.stream:
        schema = spark.read.parquet(options.requests).schema
        stream = scorer.read_stream(spark, options.requests, schema)
        scorer.start_scoring(stream, lambda df: scoring.score_rows(df, bundle, [options.key], stage=False),
                             options.output, f"{options.output}-checkpoint").awaitTermination()
        return
    if options.lake:
        raw = read_raw(spark, options.requests, BOOKINGS, encoding=options.encoding, rejects=f"{options.output}-rejects")
        statistics = VenueStatistics.load(spark, f"{options.lake}/venue_statistics")
        dimensions = [spark.read.parquet(f"{options.lake}/silver/{name}") for name in ("restaurants", "members")]
        features = features_from_raw(raw, *dimensions, fitted=statistics, keep=[options.key])
        write_table(scoring.run_inference(features, bundle, [options.key]), options.output)
        return
    documents, rejected = scoring.score_payloads(read_payload_files(spark, options.requests), bundle)
    documents.write.mode("overwrite").json(f"{options.output}/predictions")
    rejected.write.mode("overwrite").json(f"{options.output}/rejected")


if __name__ == "__main__":
    main()
    clear_workspace(SparkSession.active())
