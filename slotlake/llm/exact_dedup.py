"""Exact duplicates of whole texts by two passes over a Bloom filter.

The first pass counts, for every text, the cells its hash falls on; cells hit twice become the
bits of a filter. The second pass asks the filter: a text with a cell that was hit once is alone
in the corpus and passes straight through. Only texts whose cells were all hit twice, those with
a copy and a few others, are shuffled and compared by their SHA-256.

The filter is broadcast. It has at most ``filter_bits`` bits; a corpus that needs more is split
by hash into slices, each with a filter of its own, so the broadcast never grows beyond that.

Nulls count as empty texts, and an empty text is a text like any other. Among equal texts the row
with the largest id stays, a null id being the smallest. Repeated rows of one id and text are
copies of each other: the report gives both the same line, ``drop_duplicates`` leaves one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, hex_of, keyed_text

#: Bits of one filter at most: 128 MB to each executor.
FILTER_BITS = 1 << 30
#: Cells for each text, and how many of them its hash falls on.
CELLS_PER_ROW, PROBES = 8, 2


def _cells(rows: int, filter_bits: int) -> tuple[int, int]:
    """Cells of one filter, and the number of slices."""
    wanted = max(1 << 15, CELLS_PER_ROW * rows)
    if wanted <= filter_bits:
        return 1 << math.ceil(math.log2(wanted)), 1
    return filter_bits, math.ceil(wanted / filter_bits)


def _position(hashed: Column, probe: int, cells: int) -> Column:
    """Cell of a hash, counted from 1 as the bitmap functions do."""
    return F.pmod(F.xxhash64(hashed, F.lit(probe)), F.lit(cells)) + 1


def _hit(hashes: DataFrame, cells: int) -> DataFrame:
    return hashes.select(F.explode(F.array(*[_position(F.col("h"), i, cells) for i in range(PROBES)])).alias("cell"))


def _bitmaps(cells: DataFrame) -> DataFrame:
    """Bitmaps of cells, 32,768 of them a row."""
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def repeated_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """First pass. The cells that were hit more than once.

    A cell that a third of all rows hit is counted where the rows are before it is shuffled.
    """
    return _bitmaps(_hit(hashes, cells).groupBy("cell").count().where("count > 1"))


def member_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """The cells that were hit at all."""
    return _bitmaps(_hit(hashes, cells))


def mark_suspects(rows: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """Second pass. Adds ``suspect``: whether every cell of the row's hash ``h`` was hit twice."""
    bitmaps = F.broadcast(bitmaps)
    suspect = F.lit(True)
    for i in range(PROBES):
        cell = _position(F.col("h"), i, cells)
        rows = rows.join(bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}")),
                         F.bitmap_bucket_number(cell) == F.col(f"_bucket{i}"), "left")
        at = F.bitmap_bit_position(cell)
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        suspect = suspect & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("suspect", suspect).drop(*[f"_{n}{i}" for n in ("bucket", "bits") for i in range(PROBES)])


def _hash(digest: str) -> Column:
    return F.xxhash64(digest)


def _marked(rows: DataFrame, hashes: DataFrame, filter_bits: int, first_pass=repeated_cells) -> DataFrame:
    """``rows`` with ``suspect``; ``hashes`` is the column ``h`` that the first pass reads."""
    cells, slices = _cells(hashes.count(), filter_bits)
    parts = []
    for s in range(slices):
        mine = F.pmod(F.col("h"), F.lit(slices)) == s if slices > 1 else F.lit(True)
        bitmaps = freeze(first_pass(hashes.where(mine), cells), "cells")
        parts.append(mark_suspects(rows.where(mine), bitmaps, cells))
    return reduce(DataFrame.unionByName, parts)


def mark_repeated(rows: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``suspect``: true for every row whose hash ``h`` other rows have, and for a few others."""
    return _marked(rows, rows.select("h"), filter_bits)


def mark_members(rows: DataFrame, keys: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``suspect``: true for every row whose hash ``h`` is one of ``keys``, and for a few others."""
    return _marked(rows, keys, filter_bits, member_cells)


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256."""
    keys = freeze(keyed_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
                  .withColumn("h", _hash("digest")), "text_digests")
    marked = _marked(keys, keys.select("h"), filter_bits)
    alone = marked.where(~F.col("suspect")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    suspects = marked.where("suspect")
    # written, so that the join below sees two plain shuffles and can split a digest that many rows share
    groups = freeze(suspects.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
                    "text_groups")
    joined = suspects.join(groups, "digest")
    return alone.unionByName(joined).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        hex_of(F.col("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; texts without a possible copy are not shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), digest.alias("digest")).withColumn("h", _hash("digest"))
    marked = _marked(rows, freeze(rows.select("h"), "text_hashes"), filter_bits)
    alone = marked.where(~F.col("suspect")).select("row")
    order = F.struct("id", F.xxhash64(F.to_json("row")))
    best = marked.where("suspect").groupBy("digest").agg(F.max_by("row", order).alias("row")).select("row")
    return alone.unionByName(best).select("row.*")
