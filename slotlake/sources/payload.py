"""Scoring payloads: JSON documents with ``columns``, ``index`` and ``data``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake import constants as K

PAYLOAD = (
    "input_data struct<columns: array<string>, index: array<bigint>, data: array<array<string>>>"
)


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, payload``: one document per file."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("payload"))


def _named_columns(columns: Column, names: Sequence[str]) -> Column:
    """Column names; integers are positions in the list of known names."""
    positional = F.element_at(columns, 1).rlike("^[0-9]+$")
    known = F.lit(list(names))
    looked_up = F.transform(columns, lambda c: F.get(known, c.try_cast("int")))
    return F.when(positional, looked_up).otherwise(columns)


def parse_payloads(df: DataFrame, payload: str = "payload",
                   names: Sequence[str] = K.PAYLOAD_COLUMNS) -> DataFrame:
    """Add ``columns``, ``index``, ``data`` and ``problem``, null where the document is sound.

    Exploding an array of one keeps the optimizer from parsing once more for every use.
    """
    parsed = df.select(*df.columns, F.explode(F.array(F.from_json(payload, PAYLOAD))).alias("_doc")).select(
        *df.columns, F.col("_doc.input_data").alias("_doc")).select(
        *df.columns,
        _named_columns(F.col("_doc.columns"), names).alias("columns"),
        F.col("_doc.index").alias("index"), F.col("_doc.data").alias("data"))
    width = F.size("columns")
    problem = (
        F.when(F.col("columns").isNull() | F.col("data").isNull(), "unreadable")
        .when(F.exists("columns", lambda c: c.isNull()), "column position")
        .when(F.col("index").isNotNull() & (F.size("index") != F.size("data")), "index length")
        .when(~F.forall("data", lambda row: F.coalesce(F.size(row) == width, F.lit(False))), "row width")
    )
    return parsed.withColumn("problem", problem)


def split_payloads(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    parsed = parse_payloads(df, payload)
    return parsed.filter("problem is null"), parsed.filter("problem is not null")


def payload_rows(valid: DataFrame, schema: T.StructType, request: str = "request_id") -> DataFrame:
    """One typed row per data row, with its position and label; absent columns are null."""
    rows = valid.select(request, "columns", "index", F.posexplode("data").alias("position", "cells"))
    label = F.coalesce(F.get("index", F.col("position")), F.col("position").cast("bigint"))
    cells = [
        F.get("cells", F.array_position("columns", F.lit(f.name)).cast("int") - 1)
        .try_cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return rows.select(request, "position", label.alias("row_label"), *cells)


def json_literal(column: Column) -> Column:
    """JSON text of one value, ``null`` for a missing one."""
    text = F.to_json(F.array(column))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def json_array(columns: Sequence[str]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[json_literal(F.col(c)) for c in columns]), F.lit("]"))


def emit_payloads(df: DataFrame, columns: Sequence[str] = K.PREDICTION_COLUMNS,
                  request: str = "request_id", position: str = "position", label: str = "row_label",
                  block: str = "predictions", requests: DataFrame | None = None) -> DataFrame:
    """One document per request, with ``columns``, ``index`` and ``data`` in the order of the request.

    A request is one cell of a table, so its answer is bounded by it. ``requests`` names all
    requests to answer; one without rows gets a document without rows.
    """
    entry = F.struct(F.col(position).alias("p"), F.col(label).alias("i"), json_array(columns).alias("r"))
    names = F.concat(F.lit("["), F.lit(",".join(f'"{c}"' for c in columns)), F.lit("]"))
    answers = df.groupBy(request).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    if requests is not None:
        answers = requests.select(request).join(answers, request, "left").withColumn(
            "_rows", F.coalesce("_rows", F.array().cast(answers.schema["_rows"].dataType)))
    body = F.concat(
        F.lit(f'{{"{block}":{{"columns":'), names,
        F.lit(',"index":['), F.array_join(F.transform("_rows", lambda x: x["i"].cast("string")), ","),
        F.lit('],"data":['), F.array_join(F.transform("_rows", lambda x: x["r"]), ","), F.lit("]}}"))
    return answers.select(request, body.alias("document"))


def validate_records(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns and ``problem``, which names the columns that are missing or of a wrong type."""
    typed = {
        f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType) for f in schema}
    wrong = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in typed.items()]))
    kept = [c for c in df.columns if c not in typed]
    return df.select(*kept, *[c.alias(n) for n, c in typed.items()],
                     F.when(F.size(wrong) > 0, F.array_join(wrong, ",")).alias("problem"))
