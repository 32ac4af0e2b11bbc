"""Repeated passages: every word in a window that an earlier document has, too, is removed.

Windows of ``words`` words are compared by level-wise doubling. The lengths of the levels are halves of one
another, such as 13, 25 and 50. At the first level not every window counts but one in each stretch of a
full window, picked by its hash and so alike wherever the stretch occurs; windows that occur once at a
level are dropped, and those left are extended to about twice their length, to the right or, close to the
end of the stretch, to the left. A full window is looked at only if the pick inside it was repeated at all
levels before; what occurs once before was dropped by a filter that errs on the side of keeping.

What is left is judged exactly. A *block* is the run of full windows that share a pick. Blocks that an earlier
document has, word for word, are removed as one. From the first document of each block and from the blocks
that no earlier document has, the full windows go on one by one; one whose first document is an earlier one
is removed. A later copy of a block need not go on: the first document has all its windows.

Windows are compared by 64-bit hashes. Documents are ordered by id; a null id comes last, and rows of one id
are one document that repeats nothing of its own. Null and empty texts have no words. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, keyed_text, map_batches, words_of
from slotlake.llm.exact_dedup import mark_members, mark_repeated

WORDS, FIRST_LEVEL = 50, 16
_BASE, _POSITION_BITS = 0x9E3779B97F4A7C13, 28
_LAST = (1 << 63) - 1


def levels(words: int = WORDS) -> list[int]:
    """Lengths from the shortest, at most ``FIRST_LEVEL`` words, to ``words``."""
    out = [words]
    while out[0] > FIRST_LEVEL:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Hashes:
    """Hashes of all windows of a document from one prefix sum of its words' hashes."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        word = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        power = np.full(self.n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:-1], dtype=np.uint64)])
        back = np.full(self.n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the windows that begin at ``start``, as signed numbers."""
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def picks(found: Hashes, words: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """The pick of every full window: distinct places, and for each the first full window that has it."""
    h = found.at(np.arange(found.n - short + 1), short).view(np.uint64)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, done = words - short + 1, 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    place = (best & low).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first


def _scan(words: int):
    """Per document its words, the digest of them, and its picks with the hashes of the levels and the block."""
    short, middle = levels(words)[0], levels(words)[1:-1]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = []
            for text in part.column("text"):
                found = words_of(text.as_py())
                row = {"n_words": len(found), "digest": hashlib.sha256(b" ".join(found)).digest(), "picks": None}
                if len(found) >= words:
                    h = Hashes(found)
                    pick, first = picks(h, words, short)
                    last = np.append(first[1:] - 1, h.n - words)
                    fields = {"first": first, "last": last, "base": h.at(pick, short), "block": h.at(first, last - first + words) ^ (pick - first)}
                    for k, length in enumerate(middle):  # to the right where the last window reaches so far, to the left for the first ones
                        right, left = last >= pick + length - words, first < pick + length - words
                        fields[f"right{k}"] = np.where(right, h.at(np.where(right, pick, 0), length), 0)
                        fields[f"left{k}"] = np.where(left, h.at(np.where(left, pick + short - length, 0), length), 0)
                    row["picks"] = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in fields.values()], list(fields))
                rows.append(row)
            kind = _picks(middle)
            lists = [r["picks"] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
            full = [x for x in lists if x is not None]
            flat = pa.concat_arrays(full) if full else pa.array([], pa.struct([(n, pa.int64()) for n in kind]))
            yield pa.RecordBatch.from_arrays(
                [*part.drop_columns("text").columns, pa.array([r["n_words"] for r in rows], pa.int64()),
                 pa.array([r["digest"] for r in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["doc_id", "rank", "mark", "n_words", "digest", "picks"])

    return run


def _picks(middle: list[int]) -> list[str]:
    return ["first", "last", "base", "block", *[f"{side}{k}" for k in range(len(middle)) for side in ("right", "left")]]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbours; ``starts`` ascend."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def _with_text(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the documents that ``keys`` (rank, mark, ...) names; the others are not shuffled."""
    keys = freeze(keys, "named")
    named = mark_members(rows.withColumn("h", F.xxhash64("rank", "mark")), keys.select(F.xxhash64("rank", "mark").alias("h")))
    return named.where("suspect").select("rank", "mark", "text").join(keys, ["rank", "mark"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and ``removed``, an array of
    (first, end) places of the removed words, end exclusive and in order."""
    rows = keyed_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"),
        F.xxhash64("text").alias("mark"), "text")
    middle = levels(words)[1:-1]
    fields = _picks(middle)
    kind = ",".join(f"{n}:bigint" for n in fields)
    scanned = freeze(map_batches(rows, _scan(words), f"doc_id long, rank long, mark long, n_words long, digest binary, picks array<struct<{kind}>>"), "passages")

    # levels: drop what occurs once, extend the rest
    left = scanned.select("rank", "mark", F.explode("picks").alias("p")).select("rank", "mark", "p.*")
    left = freeze(mark_repeated(left.withColumn("h", F.col("base"))).where("suspect").drop("h", "suspect", "base"), "level")
    for k in range(len(middle)):
        sides = F.array(F.col(f"right{k}"), F.col(f"left{k}"))
        each = left.withColumn("h", F.explode(F.filter(sides, lambda h: h != 0))).drop(f"right{k}", f"left{k}")
        left = freeze(mark_repeated(each).where("suspect").drop("h", "suspect").distinct(), "level")

    # blocks: removed at once where an earlier document has the block
    blocks = freeze(left.groupBy("block").agg(F.min("rank").alias("earliest")), "blocks")
    judged = freeze(left.join(blocks, "block").select("rank", "mark", "first", "last", (F.col("rank") > F.col("earliest")).alias("later")), "judged")
    spans = F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans")

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            found = Hashes(words_of(batch.column("text")[i].as_py()))
            start = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in batch.column("spans")[i].as_py()])
            for at in range(0, len(start), 1 << 18):
                part = start[at:at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in ("rank", "mark")]
                    + [pa.array(part.astype(np.int32)), pa.array(found.at(part, words))], ["rank", "mark", "start", "h"])

    asked = _with_text(rows, judged.where("not later").groupBy("rank", "mark").agg(spans))
    single = freeze(map_batches(asked.select("rank", "mark", "text", "spans"), windows, "rank long, mark long, start int, h long"), "windows")
    earliest = single.groupBy("h").agg(F.min("rank").alias("earliest"), F.max("rank").alias("latest")).where("earliest < latest")
    again = single.join(freeze(earliest.drop("latest"), "repeated"), "h").where("rank > earliest")
    gone = (again.select("rank", "mark", F.col("start").cast("long").alias("first"), F.col("start").cast("long").alias("last"))
            .unionByName(judged.where("later").drop("later")))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for i in range(batch.num_rows):
            found = words_of(batch.column("text")[i].as_py())
            gone = np.zeros(len(found) + 1, np.int64)
            for s in batch.column("spans")[i].as_py():
                gone[s["first"]] += 1
                gone[s["last"] + words] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            first, last = _runs(np.flatnonzero(gone))
            kept = hashlib.sha256(b" ".join([w for w, g in zip(found, gone.tolist()) if not g])).digest()
            out.append((int(gone.sum()), kept, [{"first": int(a), "end": int(b) + 1} for a, b in zip(first, last)]))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("mark"), pa.array([o[0] for o in out], pa.int64()),
                                          pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], span)],
                                         ["rank", "mark", "n_removed", "kept", "removed"])

    asked = _with_text(rows, gone.groupBy("rank", "mark").agg(spans))
    cuts = map_batches(asked.select("rank", "mark", "text", "spans"), cut,
                       "rank long, mark long, n_removed long, kept binary, removed array<struct<first:bigint,end:bigint>>")
    cuts = freeze(cuts.dropDuplicates(["rank", "mark"]), "cuts")  # repeated rows were cut alike
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return scanned.drop("picks").join(cuts, ["rank", "mark"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"), F.coalesce("removed", none).alias("removed"))
