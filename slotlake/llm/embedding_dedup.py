"""Near duplicates of embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors are scaled to length one, so a cosine of ``threshold`` is a distance of sqrt(2 - 2 threshold). A
hash is a projection on a normal direction, shifted and cut into steps of ``STEP``; a table's key is
``k`` of them, and ``t`` tables are used. ``k`` grows with the logarithm of the number of vectors, so that a
bucket holds about ``BUCKET`` strangers at any size, and ``t`` follows from it so that a pair right at the
threshold meets in some table with probability ``RECALL``; nearer pairs meet more surely. Everything that
meets is compared by its cosine in double precision, so nothing below the threshold is linked.

Equal vectors are one class and are compared once. A bucket of more than ``BLOCK`` classes is cut into
blocks and each pair of blocks is compared by a task of its own, so that one bucket with a third of all
vectors is shared out. A pair that meets in several tables is counted in the first of them only. Pairs
are never written: a block gives its classes' numbers of links and a spanning forest of its links.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Repeated
rows, with the same id or not, are vectors of their own. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, map_batches
from slotlake.llm.components import components

THRESHOLD, RECALL = 0.9, 0.997
STEP, BUCKET, BLOCK = 2.0, 64, 1024


def meeting(distance: float, step: float = STEP) -> float:
    """The probability that one hash of two vectors so far apart is equal."""
    t = step / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Hashes of a key, and tables."""
    k = max(4, math.ceil(math.log(max(vectors, 2) / BUCKET) / -math.log(meeting(math.sqrt(2.0)))))
    near = meeting(math.sqrt(2 - 2 * threshold)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def table_keys(unit: np.ndarray, k: int, tables: int, seed: int = 7) -> np.ndarray:
    """Keys of unit vectors, one row each, one column per table."""
    draw = np.random.default_rng(seed)
    direction = draw.standard_normal((unit.shape[1], k * tables))
    shift = draw.uniform(0, STEP, k * tables)
    cells = np.floor((unit @ direction + shift) / STEP).astype(np.int64).reshape(len(unit), tables, k)
    key = np.zeros((len(unit), tables), np.uint64)
    for i in range(k):
        key = (key ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _hash(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """``class``, ``vector`` -> ``class``, ``keys`` and ``vector``, both as bytes."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("vector")
        keys: list = [None] * batch.num_rows
        raw = [np.frombuffer(v.as_buffer(), np.float64) for v in column]
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(raw):
            by_width.setdefault(len(v), []).append(i)
        for width, rows in by_width.items():
            x = np.array([raw[i] for i in rows])
            found = table_keys(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables, seed=width)
            for i, row in zip(rows, found):
                keys[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(keys, pa.binary()), column], ["class", "keys", "vector"])

    return map_batches(classes, run, "class long, keys binary, vector binary")


def _compare(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket and pair of blocks: for each class its links counted here, or an edge of the forest."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        names = batch[["g", "key", "low", "high"]].to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        if not len(cuts):
            held = batch
            continue
        held = batch.iloc[cuts[-1]:]
        yield _groups(batch, [0, *cuts], threshold)
    if held is not None and len(held):
        yield _groups(held, [0, len(held)], threshold)


def _groups(batch: pd.DataFrame, cuts: list[int], threshold: float) -> pd.DataFrame:
    ids, weight = batch["class"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
    g, low, high, block = (batch[c].to_numpy(np.int64) for c in ("g", "low", "high", "block"))
    vectors, keys = batch["vector"].tolist(), batch["keys"].tolist()
    node, links, other = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < 2:
            continue
        widths: dict[int, list[int]] = {}
        for i in range(a, b):
            widths.setdefault(len(vectors[i]), []).append(i)
        for rows in widths.values():
            at = np.array(rows)
            x = np.array([np.frombuffer(vectors[i], np.float64) for i in rows])
            length = np.linalg.norm(x, axis=1)
            near = (x @ x.T) / np.outer(length, length) >= threshold
            if low[a] != high[a]:  # pairs inside one block belong to the task of that block
                near &= block[at][:, None] != block[at][None, :]
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            if g[a]:
                mine = np.array([np.frombuffer(keys[i], np.int64)[:g[a]] for i in rows])
                i, j = np.nonzero(near)
                for s in range(0, len(i), 1 << 18):
                    p, q = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
                    near[p, q] = ~(mine[p] == mine[q]).any(axis=1)
            count = near @ weight[at]
            root = _forest(near)
            for r in np.flatnonzero(count):
                node.append(ids[at[r]])
                links.append(int(count[r]))
                other.append(ids[at[root[r]]])
    return pd.DataFrame({"class": np.array(node, np.int64), "links": np.array(links, np.int64), "other": np.array(other, np.int64)})


def _forest(near: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    n = len(near)
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            front = np.zeros(n, np.bool_)
            front[s] = True
            while front.any():
                root[front] = s
                front = near[front].any(axis=0) & (root < 0)
    return root


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
         recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for v in batch.column("v").to_pylist():
            x = np.array(v, np.float64) if v else np.zeros(0)  # a null component becomes nan
            length = np.linalg.norm(x) if len(x) else 0.0
            out.append(x.tobytes() if np.isfinite(length) and length > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vector"])

    packed = freeze(map_batches(rows, pack, "vec_id long, vector binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    sound = packed.where("vector is not null")
    classes = freeze(sound.groupBy("vector").agg(F.min("row").alias("class"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")), "classes")
    k, tables = plan(classes.count(), threshold, recall)
    hashed = freeze(_hash(classes.select("class", "vector"), k, tables).join(classes.select("class", "n"), "class"), "hashed")
    width = 8
    key = lambda i: F.conv(F.hex(F.substring("keys", i * width + 1, F.lit(width))), 16, -10).cast("long")
    at = hashed.select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), key)).alias("g", "key"))
    sizes = at.groupBy("g", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = at.join(freeze(sizes, "buckets"), ["g", "key"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("class", "g", "key", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    full = met.join(hashed, "class")
    found = freeze(full.repartition("g", "key", "low", "high").sortWithinPartitions("g", "key", "low", "high", "class")
                   .mapInPandas(lambda it: _compare(it, threshold), "class long, links long, other long"), "found")
    counts = freeze(found.groupBy("class").agg(F.sum("links").alias("links")), "counts")
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "class"})
    named = (classes.drop("vector").join(counts, "class", "left").join(roots, "class", "left")
             .withColumn("component", F.coalesce("component", "class"))
             .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
    first = freeze(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "first_ids")
    named = freeze(named.join(first, "component").select(F.col("class"), "links", "component_id"), "named")
    of_class = freeze(classes.select("class", "vector").join(named, "class").drop("class"), "of_class")
    joined = packed.join(of_class, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
