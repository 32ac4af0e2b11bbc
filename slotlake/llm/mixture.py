"""Mixing sources to target weights by pivotal rounding in a distributed reduction tree.

Every text of a source has the same wanted number of copies, target / source size, between 0 and
2. Its whole part is taken at once; the fraction is rounded by the pivotal method: two texts with
fractions meet, chance moves mass from one to the other until one of them is integral, and the
other goes on to meet the next. Expected values stay, and the sum of the fractions stays exactly.

The texts of a source are dealt to leaves of texts of nearly the same size, so that moving a copy
from one text to another hardly moves words. A leaf is walked in order of size with one open text
at a time, so a leaf of any length needs constant memory; it ends with one open text at most. The
open texts of up to 16 leaves meet in the next level, and so on up to one per source, whose
fraction is rounded by chance. Chance is a hash of the ids that meet, so reruns agree.

Null text: size 0. Texts of size 0 are never taken. A null source is a source of its own, the last
in order. Repeated rows draw for themselves. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlake.llm.common import WORD, freeze

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Texts in a leaf, about; leaves whose open texts meet in one node of the tree.
LEAF_ROWS, FAN_IN = 4096, 16
#: Size classes for each doubling of the size.
CLASSES = 4
CLOSE = 1e-9
#: Places in the row of an open text: id, mark of the text, size, whole copies, fraction, copies.
WHOLE, FRACTION, COPIES = 3, 4, 5

_STATE = "source string, leaf long, doc_id long, mark long, size long, whole int, fraction double, copies int"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``: words that the mix takes of each source.

    The weights repeat over the sources in order of code point, null last. ``share`` of all words
    is dealt by weight; no source gets over ``most`` times its own words, and what it cannot take
    is dealt again among the others. One row per source is ranked and summed; scalars come back.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    table = freeze(sources.withColumn("weight", weight), "source_weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * float(most) < F.lit(level) * F.col("weight")
        n, taken, rest = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size")).otherwise(0)),
                                   F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not total or n == capped or not rest:
            break
        level, capped = (share * total - most * taken) / rest, n
    return table.withColumn("target", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("weight"))).drop("weight")


def _chance(*parts) -> float:
    """Between 0 and 1, the same for the same parts."""
    return xxhash.xxh64_intdigest(repr(parts).encode()) / 2.0**64


def _meet(a: list, b: list) -> tuple[list, list]:
    """Two open texts ``[id, mark, size, whole, fraction, copies]``: one is decided, the other may stay open."""
    p, q = a[FRACTION], b[FRACTION]
    chance = _chance(a[:3], b[:3], round(p, 6))
    if p + q < 1:  # one gets all the mass, the other is left out
        left, done = (b, a) if chance * (p + q) < q else (a, b)
        left[FRACTION], done[FRACTION], done[COPIES] = p + q, 0.0, done[WHOLE]
    else:  # one is filled up, the other keeps the rest
        done, left = (a, b) if chance * (2 - p - q) < 1 - q else (b, a)
        left[FRACTION], done[FRACTION], done[COPIES] = p + q - 1, 1.0, done[WHOLE] + 1
    if _integral(left):
        left[COPIES] = left[WHOLE] + round(left[FRACTION])
    return done, left


def _integral(row: list) -> bool:
    return row[FRACTION] < CLOSE or row[FRACTION] > 1 - CLOSE


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of source, leaf and size; ``copies`` is set for all but one at most of each leaf."""
    open_row, at = None, None
    for batch in batches:
        out = []
        for source, leaf, doc, mark, size, whole, fraction, _ in zip(*[batch[c].tolist() for c in batch.columns]):
            source, doc = (None if pd.isna(source) else source), (None if pd.isna(doc) else int(doc))
            if open_row is not None and at != (source, leaf):
                out.append((*at, *open_row))
                open_row = None
            at = (source, leaf)
            row = [doc, mark, size, whole, fraction, None]
            if not size or _integral(row):
                row[COPIES] = whole + round(fraction) if size else 0
                out.append((*at, *row))
            elif open_row is None:
                open_row = row
            else:
                done, left = _meet(open_row, row)
                out.append((*at, *done))
                open_row = left
                if left[COPIES] is not None:
                    out.append((*at, *left))
                    open_row = None
        yield _frame(out)
    if open_row is not None:
        yield _frame([(*at, *open_row)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["source", "leaf", "doc_id", "mark", "size", "whole", "fraction", "copies"])
    return out.astype({"doc_id": "Int64", "copies": "Int32"})


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``mark`` (a hash of the text) and ``size``, its number of words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(text_col).alias("mark"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
         leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and copies."""
    sized = freeze(sizes(docs, id_col, text_col, source_col), "text_sizes")
    goals = freeze(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    # classes of nearly equal size, each with as many leaves as its rows need, numbered in order of size
    size_class = F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("long")
    classed = sized.withColumn("class", size_class)
    counts = classed.groupBy("source", "class").agg(F.ceil(F.count("*") / leaf_rows).alias("leaves"))
    before = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    plan = freeze(counts.withColumn("first", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
                  .join(goals, counts["source"].eqNullSafe(goals["source"])).drop(goals["source"]), "leaves")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaf = F.col("first") + F.pmod(F.xxhash64("doc_id", "mark"), F.col("leaves"))
    named = F.broadcast(plan) if plan.count() <= 100_000 else plan
    dealt = (classed.alias("d").join(named.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))
                                     & (F.col("d.class") == F.col("p.class")))
             .select("d.source", leaf.alias("leaf"), "doc_id", "mark", "size", F.floor(wanted).cast("int").alias("whole"),
                     (wanted - F.floor(wanted)).alias("fraction"), F.lit(None).cast("int").alias("copies")))
    leaves = plan.agg(F.max(F.col("first") + F.col("leaves"))).first()[0] or 1
    done, level = [], dealt
    for _ in range(1 + math.ceil(math.log(leaves, FAN_IN)) if leaves > 1 else 1):
        walked = freeze(level.repartition("source", "leaf")
                        .sortWithinPartitions("source", "leaf", "size", "doc_id", "mark").mapInPandas(_walk, _STATE), "walked")
        done.append(walked.where("copies is not null"))
        level = walked.where("copies is null").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
    # one open text of a source at most: a plain draw
    last = (F.pmod(F.xxhash64("source", "doc_id", "mark"), F.lit(1 << 40)) / float(1 << 40) < F.col("fraction")).cast("int")
    rows = level.withColumn("copies", F.col("whole") + last)
    for part in done:
        rows = rows.unionByName(part)
    return (rows.alias("r").join(F.broadcast(goals).alias("g") if goals.count() <= 100_000 else goals.alias("g"),
                                 F.col("r.source").eqNullSafe(F.col("g.source")))
            .select("doc_id", "r.source", "mark", "size", "source_size", "target", "copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as drawn. Repeated rows of one id, source and text give as
    many rows as they drew together."""
    key = ["doc_id", "source", "mark"]
    drawn = freeze(draw(docs, id_col, text_col, source_col, **how).groupBy(*key)
                   .agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("n > 0"), "drawn")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.col(source_col).cast("string").alias("src"), F.xxhash64(text_col).alias("hash"))
    joined = keyed.join(drawn, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source"))
                        & (F.col("hash") == F.col("mark")))
    once = joined.where("m = 1").select("row", "n")
    again = (joined.where("m > 1").groupBy(*key).agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row"),
                                                     F.first("n").alias("n")).select("row", "n"))
    return once.unionByName(again).select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
