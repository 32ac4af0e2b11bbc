"""Model bundles and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.config import MEAL_BANDS, ROUTING_COLUMN, Band
from slotlake.functions.temporal import slot_time_range
from slotlake.operators import routing
from slotlake.operators.cleaning import apply_fill_values, fit_fill_values, numeric_columns
from slotlake.plans.training import BandModel, SlotModel
from slotlake.schema import BOOKING_RECORD
from slotlake.session import freeze, new_path
from slotlake.sources import payload as payloads


@dataclass
class Bundle:
    """One model per band and what is needed to use them."""

    models: dict[str, SlotModel]
    bands: list[Band]
    manifest: dict


# --- persistence ------------------------------------------------------------------------------------

def save_bundle(models: Sequence[BandModel], path: str, target: str, leakage: Sequence[str]) -> dict:
    """A folder per band and, written last, the manifest that makes the bundle complete."""
    manifest = {
        "target": target,
        "leakage": list(leakage),
        "non_feature_cols": list(K.NON_FEATURE_COLUMNS),
        "categorical_cols": list(K.CATEGORICAL_COLUMNS),
        "routing_column": ROUTING_COLUMN,
        "subsets": {},
    }
    for m in models:
        m.model.pipeline.write().overwrite().save(f"{path}/{m.band.name}")
        manifest["subsets"][m.band.name] = {
            "display_name": m.band.label or m.band.name,
            "hour_min": m.band.first, "hour_max": m.band.last,
            "n_classes": len(m.model.labels), "labels": m.model.labels,
            "numeric": m.model.numeric, "categorical": m.model.categorical,
        }
        manifest["feature_columns"] = m.model.features
    spark = SparkSession.active()
    # the JSON suffix of the written file is what find_bundle looks for
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "manifest STRING").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/routing")
    return manifest


def find_bundle(spark: SparkSession, root: str) -> str:
    """Folder of the bundle, at ``root`` or anywhere below it."""
    found = (
        spark.read.schema("manifest STRING").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root)
        .filter("manifest is not null").select("_metadata.file_path").orderBy("file_path").first()
    )
    if found is None:
        raise FileNotFoundError(f"no bundle manifest under {root}")
    return found["file_path"].rsplit("/routing/", 1)[0]


def load_bundle(spark: SparkSession, root: str) -> Bundle:
    path = find_bundle(spark, root)
    row = spark.read.schema("manifest STRING").json(f"{path}/routing").first()
    manifest = json.loads(row["manifest"])
    models, bands = {}, []
    for name, s in manifest["subsets"].items():
        models[name] = SlotModel(PipelineModel.load(f"{path}/{name}"), s["labels"], s["numeric"], s["categorical"])
        bands.append(Band(name, s["hour_min"], s["hour_max"], s["display_name"]))
    return Bundle(models, bands, manifest)


def manifest_table(spark: SparkSession, manifest: Mapping) -> DataFrame:
    rows = [(n, s["hour_min"], s["hour_max"], s["n_classes"], len(manifest["feature_columns"]))
            for n, s in manifest["subsets"].items()]
    return spark.createDataFrame(rows, "subset STRING, hour_min INT, hour_max INT, n_classes INT, n_features INT")


def bundle_of(models: Sequence[BandModel]) -> Bundle:
    """Freshly trained models as a bundle, without a round trip through files."""
    return Bundle({m.band.name: m.model for m in models}, [m.band for m in models], {})


# --- scoring ------------------------------------------------------------------------------------------

def score_band(rows: DataFrame, model: SlotModel, keys: Sequence[str], band: str) -> DataFrame:
    """Slot, time range, band and confidence of rows that belong to one band."""
    scored = model.predict(rows, "reservation_half_hour", "_confidence")
    slot = F.col("reservation_half_hour").cast("int")
    return scored.select(
        *keys, slot.alias("reservation_half_hour"), slot_time_range(slot).alias("time_range"),
        F.lit(band).alias("subset"), F.round("_confidence", 6).alias("probability"))


def _without_prediction(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(
        *keys, F.lit(None).cast("int").alias("reservation_half_hour"),
        F.lit(None).cast("string").alias("time_range"), "subset",
        F.lit(None).cast("double").alias("probability"))


def score_rows(df: DataFrame, bundle: Bundle, keys: Sequence[str], stage: bool = True) -> DataFrame:
    """Predictions for every row: nulls with ``_unmatched`` outside the bands, and nulls with
    the band's name where the bundle has no model for it.

    Each band is one branch of the plan. A batch is first written once, partitioned by band, so
    that a branch reads its own rows only; ``stage=False`` keeps a stream in one plan.
    """
    used = {c for m in bundle.models.values() for c in m.features} | {ROUTING_COLUMN}
    if ROUTING_COLUMN not in df.columns:
        raise ValueError(f"rows need {ROUTING_COLUMN!r} to be routed to a meal band")
    pruned = df.select(*keys, *[c for c in df.columns if c in used and c not in keys])
    routed = routing.route(pruned, bundle.bands)
    if stage:
        path = new_path(df.sparkSession, "routed")
        routed.write.partitionBy("subset").parquet(path)
        routed = df.sparkSession.read.schema(routed.schema).parquet(path)
    known = [b.name for b in bundle.bands if b.name in bundle.models]
    parts = [
        score_band(routed.filter(F.col("subset") == name).drop(ROUTING_COLUMN), bundle.models[name], keys, name)
        for name in known
    ]
    parts.append(_without_prediction(routed.filter(~F.col("subset").isin(known)), keys))
    return reduce(DataFrame.unionByName, parts)


def run_inference(df: DataFrame, bundle: Bundle, keys: Sequence[str],
                  fill: Mapping[str, float] | None = None) -> DataFrame:
    """Fill numbers with the batch median, or with ``fill`` kept from training, then score."""
    numeric = [c for c in numeric_columns(df) if c not in keys and c != ROUTING_COLUMN]
    values = fill if fill is not None else fit_fill_values(df, "median", numeric)
    return score_rows(apply_fill_values(df, values), bundle, keys)


def score_payloads(requests: DataFrame, bundle: Bundle) -> tuple[DataFrame, DataFrame]:
    """Response documents for sound requests, and rejected requests with their problem."""
    parsed = payloads.parse_payloads(requests)
    has_route = F.array_contains("columns", F.lit(ROUTING_COLUMN))
    checked = parsed.withColumn("problem", F.coalesce(
        "problem", F.when(~F.coalesce(has_route, F.lit(False)), "no routing column")))
    # parsed once; answers and rejections read what was written
    checked = freeze(checked.select("request_id", "columns", "index", "data", "problem"), "requests")
    sound = checked.filter("problem is null")
    scored = score_rows(payloads.payload_rows(sound, BOOKING_RECORD), bundle, ["request_id", "position", "row_label"])
    return payloads.emit_payloads(scored, requests=sound), checked.filter("problem is not null").select("request_id", "problem")


def score_most_frequent(df: DataFrame, baseline: DataFrame, keys: Sequence[str],
                        bands: Sequence[Band] = MEAL_BANDS) -> DataFrame:
    """The same contract with the most-frequent-slot model: one plan, no branches."""
    routed = routing.apply_most_frequent(routing.route(df, bands), baseline)
    slot = F.col("baseline").cast("int")
    return routed.select(*keys, slot.alias("reservation_half_hour"), slot_time_range(slot).alias("time_range"),
                         "subset")
