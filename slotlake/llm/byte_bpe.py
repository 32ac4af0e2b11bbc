"""Byte-level BPE by a rank file: whole texts to ids and ids back to bytes.

The tiktoken library encodes. Long texts are first cut at safe boundaries, places where no match of
the split pattern can begin before and end after: where white space follows something else. The
pattern never looks back, and a match that holds anything but white space can have one space only at
its start, so the parts give the ids that the whole gives. A run of white space longer than
``LONG_RUN`` is a match of its own by the pattern's rules and skips the regular expression, whose
stack it would exhaust.

A null text is an empty one and has no ids. Rows are mapped one by one: repeated rows give repeated
results, no rows give none. Other columns are left behind unless named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import keyed_text, map_batches

#: Characters of a part of a long text, about; white space in a row that is taken out of the pattern's hands.
PART, LONG_RUN = 1 << 16, 1 << 12
#: Ids in a batch that goes back to Spark, about.
BATCH_IDS = 1 << 21

_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Read once in each Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text cut at safe boundaries into parts of about ``size`` characters, or one part if it has none."""
    start = 0
    while len(text) - start > size and (cut := _BOUNDARY.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text):
        at = 0
        for run in _RUN.finditer(part):
            # the last character of a run goes with what follows, unless the text ends there
            ids += enc.encode_ordinary(part[at:run.start()])
            at = run.end() if run.end() == len(part) else run.end() - 1
            ids += enc._core_bpe.encode_single_piece(part[run.start():at].encode())
        ids += enc.encode_ordinary(part[at:])
    return ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, and the columns of ``keep`` as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c) for c in keep]) if keep else keyed_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        first, found, n = 0, [], 0
        for i, text in enumerate(batch.column("text")):
            found.append(np.array(encode_text(enc, text.as_py()), np.int32))
            n += len(found[-1])
            if n >= BATCH_IDS or i == batch.num_rows - 1:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                kept = batch.slice(first, len(found)).drop_columns("text")
                yield pa.RecordBatch.from_arrays([*kept.columns, ids], [*kept.schema.names, "ids"])
                first, found, n = i + 1, [], 0

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_batches(rows, run, f"{kept}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; null ids give no bytes."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        column, out, first, n = batch.column("ids"), [], 0, 0
        for i in range(batch.num_rows):
            ids = column[i].values
            out.append(enc.decode_bytes(ids.to_numpy().tolist()) if ids is not None else b"")
            n += len(out[-1])
            if n >= 4 * BATCH_IDS or i == batch.num_rows - 1:
                part = batch.slice(first, len(out))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])
                out, first, n = [], i + 1, 0

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, run, f"{kept}, decoded binary")
