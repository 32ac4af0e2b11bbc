"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.session import freeze, new_path

__all__ = ["freeze", "new_path", "map_batches", "keyed_text", "words_of", "WORD"]

#: A word is what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the whole text, under fixed names; a null text is an empty one.

    Other columns of ``docs``, whatever their names, are left behind.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` splits at ASCII white space and nowhere else."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Stream Arrow batches through ``fn``; one batch may give any number of batches."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))
