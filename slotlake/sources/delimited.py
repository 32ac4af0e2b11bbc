"""Delimited text with a declared schema."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake.session import freeze

CORRUPT = "_corrupt_record"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t",
                   encoding: str = "UTF-8") -> DataFrame:
    """All lines, with the text of a malformed one in ``_corrupt_record``.

    ``UTF-16`` with a byte-order mark can only be read file by file. ``UTF-16LE`` and
    ``UTF-16BE`` files are split like any other text; transcode large raw files once.
    """
    reader = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True).option("sep", sep).option("encoding", encoding)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
    )
    name = encoding.upper()
    if name == "UTF-16":
        reader = reader.option("multiLine", True)
    elif name.startswith(("UTF-16", "UTF-32")):
        reader = reader.option("lineSep", "\n")
    return reader.csv(path)


def split_bad_lines(df: DataFrame, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the text of lines with too many fields.

    A line with too few fields is kept with nulls at its end, as is a value of the wrong type.
    The parsed lines are first written as Parquet, so the text is decoded once, and both results
    read files that can be split and pruned.
    """
    df = freeze(df, "parsed")
    width = len(df.columns) - 1
    too_long = F.coalesce(
        F.size(F.split(F.col(CORRUPT), f"\\Q{sep}\\E", -1)) > width, F.lit(False))
    return df.filter(~too_long).drop(CORRUPT), df.filter(too_long).select(CORRUPT)


def read_raw(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t",
             encoding: str = "UTF-16", rejects: str | None = None) -> DataFrame:
    """A raw table without its malformed lines, which are written to ``rejects`` and reported by number."""
    good, bad = split_bad_lines(read_delimited(spark, path, schema, sep, encoding), sep)
    if rejects is not None:
        write_table(bad.withColumn("source", F.lit(path)), rejects)
        if n := spark.read.parquet(rejects).count():
            warnings.warn(f"{n} malformed lines of {path} are in {rejects}", stacklevel=2)
    return good


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("encoding", encoding).csv(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
