"""Sentence pieces and their places: whole texts to ids, the source bytes behind every id, ids to text.

A model carries a compiled character map, a double-array trie from source strings to replacements.
``Normaliser`` walks a text, replaces the longest prefix that the map holds at each place and records
for every byte of the normal form where in the source it came from. The sentencepiece library gives the ids;
the lengths of their pieces, laid along the normal form, are projected through that record to
``bounds``: piece ``i`` stands for the source bytes ``bounds[i]`` up to ``bounds[i + 1]``. Piece lengths that
do not add up to the normal form are an error, never a guess.

Long texts are cut before a space that follows something else, if no piece of the model reaches over such
a place and the model changes nothing but spaces; the parts then give the ids of the whole. The pieces
of a text that hold one byte of an unknown character each stand for that byte.

A null text is an empty one: no ids, ``bounds`` [0]. Rows are mapped one by one, so repeated rows give
repeated results and no rows none. Other columns of ``docs`` are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as formats

from slotlake.llm.common import keyed_text, map_batches

#: Bytes of a part of a long text, about; ids in a batch that goes back to Spark, about.
PART, BATCH_IDS = 1 << 16, 1 << 20
#: What a space is in the normal form.
MARK = "▁".encode()

_CUT = re.compile(rb"(?<! )(?<!%b) (?=.)" % MARK, re.DOTALL)


class CharMap:
    """The compiled map: the units of its trie, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size:]
        # bytes that are a source string, and pairs of bytes that begin one
        self.single, self.pair = np.zeros(256, bool), np.zeros((256, 256), bool)
        for first in range(256) if blob else ():
            if (node := self._step(self._children(0), first)) is not None:
                self.single[first] = self._ends(node)
                for second in range(256):
                    self.pair[first, second] = self._step(self._children(node), second) is not None

    def _children(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << (8 if unit & 0x200 else 0)

    def _step(self, children: int, byte: int) -> int | None:
        node = children ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def _ends(self, node: int) -> bool:
        return bool(self.units[node] & 0x100)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """End of the longest source string that starts at ``at``, and what replaces it."""
        found, node = None, 0
        for end in range(at, len(data)):
            node = self._step(self._children(node), data[end])
            if node is None:
                break
            if self._ends(node):
                found = end + 1, self.units[self._children(node)] & 0x7FFFFFFF
        return found and (found[0], self.replacements[found[1]:self.replacements.index(b"\0", found[1])])

    def places(self, data: bytes) -> list[int]:
        """Where a source string may start; two bytes are looked at."""
        if not self.units or not data:
            return []
        b = np.frombuffer(data, np.uint8)
        may = self.single[b]
        may[:-1] |= self.pair[b[:-1], b[1:]]
        return np.flatnonzero(may).tolist()


class Normaliser:
    """Normal form of a text, and the source position of each of its bytes and of its end."""

    def __init__(self, spec: formats.NormalizerSpec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK if spec.escape_whitespaces else b" "

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text with source strings replaced, and where each byte came from."""
        out, origin, at = [], [], 0
        for place in self.map.places(data):
            if place < at or (found := self.map.longest(data, place)) is None:
                continue
            end, new = found
            out += [data[at:place], new]
            origin += [np.arange(at, place), np.full(len(new), place)]
            at = end
        return b"".join([*out, data[at:]]), np.concatenate([*origin, np.arange(at, len(data))])

    def __call__(self, data: bytes, first: bool = True) -> tuple[bytes, np.ndarray]:
        """``first`` says that the text starts here; a later part of it has no space put in front."""
        mapped, origin = self._mapped(data)
        blank = np.frombuffer(mapped, np.uint8) == 32
        length = np.where(blank, len(self.space), 1)
        if self.squeeze:
            words = np.flatnonzero(~blank)
            if not len(words):
                return b"", np.array([0])
            length[1:][blank[1:] & blank[:-1]] = 0
            length[:words[0]] = 0
            kept = length > 0
            mapped, origin, length = bytes(np.frombuffer(mapped, np.uint8)[kept]), origin[kept], length[kept]
        normal, starts = mapped.replace(b" ", self.space), np.repeat(origin, length)
        if self.dummy and first and mapped:
            normal, starts = self.space + normal, np.concatenate([np.full(len(self.space), starts[0]), starts])
        starts, end = np.append(starts, len(data)), len(normal)
        while self.squeeze and normal.endswith(self.space, 0, end):
            end -= len(self.space)
        return normal[:end], starts[:end + 1]


class Pieces:
    """A model of the sentencepiece library with its normaliser and the lengths of its pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            spec = formats.ModelProto.FromString(file.read())
        kinds = formats.ModelProto.SentencePiece
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with white space as a suffix or with pieces of the user are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.normalise = Normaliser(spec.normalizer_spec)
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.unknown = spec.trainer_spec.unk_id
        names = [p.piece for p in spec.pieces]
        self.cuts = (not self.normalise.map.units and not self.normalise.squeeze and self.normalise.space == MARK
                     and MARK.decode() in names and not any(MARK.decode() in n.lstrip(MARK.decode()) for n in names))

    def parts(self, data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        """The text from cut to cut with the place of each part; all but the first start with a space."""
        at = 0
        while self.cuts and len(data) - at > size and (cut := _CUT.search(data, at + size)):
            yield at, data[at:cut.start()]
            at = cut.start()
        yield at, data[at:]

    def encode(self, text: str, size: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole text and its bounds."""
        all_ids, bounds, end = [], [], 0
        for at, part in self.parts(text.encode(), size):
            # the library puts a space in front of what it is given, if the model wants one
            given = part[1:] if at and self.normalise.dummy else part
            ids = np.array(self.library.encode(given.decode()), np.int32)
            lengths = self.lengths[ids]
            if self.unknown in ids:
                lengths = np.array([len(p.piece.encode()) for p in self.library.encode(given.decode(), return_type="proto").pieces])
            _, starts = self.normalise(part, first=not at)
            ends = np.cumsum(lengths)
            if len(ids) and ends[-1] != len(starts) - 1:
                raise ValueError(f"pieces cover {ends[-1]} bytes of a normal form of {len(starts) - 1}")
            all_ids.append(ids)
            bounds.append(at + starts[ends - lengths])
            end = at + starts[-1]
        return np.concatenate(all_ids), np.append(np.concatenate(bounds), end).astype(np.int32)


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """Read once in each Python worker."""
    return Pieces(path)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int32()))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``bounds`` of every row."""
    rows = keyed_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces, found, first, n = model(model_path), [], 0, 0
        for i, text in enumerate(batch.column("text")):
            found.append(pieces.encode(text.as_py()))
            n += len(found[-1][0])
            if n >= BATCH_IDS or i == batch.num_rows - 1:
                ids, bounds = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(found)), _lists(ids), _lists(bounds)], ["doc_id", "ids", "bounds"])
                found, first, n = [], i + 1, 0

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, bounds array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded``, the text that the library makes of ``ids``; null ids give an empty one."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        library, out, first, n = model(model_path).library, [], 0, 0
        for i, ids in enumerate(batch.column("ids")):
            out.append(library.decode(ids.values.to_numpy().tolist()) if ids.is_valid and len(ids) else "")
            n += len(out[-1])
            if n >= 4 * BATCH_IDS or i == batch.num_rows - 1:
                part = batch.slice(first, len(out))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])
                out, first, n = [], i + 1, 0

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, run, f"{kept}, decoded string")


def places(encoded: DataFrame) -> DataFrame:
    """One row for each piece: ``doc_id``, ``place`` (from 0), ``id``, ``begin`` and ``end`` in source bytes."""
    at = lambda i: F.get("bounds", i)
    return encoded.select("doc_id", "bounds", F.posexplode("ids").alias("place", "id")).select(
        "doc_id", "place", "id", at(F.col("place")).alias("begin"), at(F.col("place") + 1).alias("end"))


def covered(bounds: Column) -> Column:
    """Source bytes between the first and the last bound."""
    return (F.element_at(bounds, -1) - F.element_at(bounds, 1)).cast("long")
