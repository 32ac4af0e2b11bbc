"""Raw text tables to the feature table: ``etl.py RAW_DIR OUTPUT_DIR``.

``RAW_DIR`` holds ``train.csv``, ``restaurant_revised.csv`` and ``member.csv``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from slotlake.operators import cleaning
from slotlake.operators.popularity import fit_venue_statistics
from slotlake.plans.etl import build_features
from slotlake.schema import BOOKINGS, MEMBERS, RESTAURANTS
from slotlake.session import clear_workspace, get_spark
from slotlake.sources.delimited import read_raw, write_table


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("raw")
    args.add_argument("output")
    args.add_argument("--encoding", default="UTF-16")
    args.add_argument("--bookings", default="train.csv")
    options = args.parse_args(argv)
    spark = get_spark("slotlake-etl")
    read = lambda name, schema: read_raw(spark, f"{options.raw}/{name}", schema, encoding=options.encoding,
                                         rejects=f"{options.output}/rejects/{name}")
    silver = {
        "bookings": cleaning.clean_bookings(read(options.bookings, BOOKINGS)),
        "restaurants": cleaning.clean_restaurants(read("restaurant_revised.csv", RESTAURANTS)),
        "members": cleaning.clean_members(read("member.csv", MEMBERS)),
    }
    for name, df in silver.items():
        write_table(df, f"{options.output}/silver/{name}")
    stored = {name: spark.read.parquet(f"{options.output}/silver/{name}") for name in silver}
    statistics = fit_venue_statistics(stored["bookings"], areas=stored["restaurants"])
    statistics.save(f"{options.output}/venue_statistics")
    features = build_features(stored["bookings"], stored["restaurants"], stored["members"],
                              fitted=statistics, keep=["booking_id"])
    write_table(features, f"{options.output}/features_ready")


if __name__ == "__main__":
    main()
    clear_workspace(SparkSession.active())
