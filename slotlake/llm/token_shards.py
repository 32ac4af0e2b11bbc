"""Token ids in compressed binary shards, one grammar per shard.

Texts are encoded by a word-end BPE of the tokenizers library, each text is closed by an end id, and
the ids are written in ascending order of the text's id. A shard holds the ids of consecutive texts
as a Re-Pair grammar: frequent pairs of ids are replaced by nonterminals, round by round. The shard
stores the rules, how many ids each rule expands to, the compressed sequence and where each text
begins in it, so that one text is decoded without the ones before it.

A shard is one row of a Parquet table, so Spark's writers commit it and a lost executor leaves no
half-written one. Columns: ``part`` and ``first_id`` (ids of the part before the shard), ``docs``
(ids of the texts), ``sizes`` (ids of each text), ``ends`` (where each text ends in the sequence), ``left``
and ``right`` (the rules), ``lengths`` (ids each rule expands to), ``sequence``, ``vocabulary`` (the first
nonterminal) and ``n_ids``; numbers are little-endian, 32 bits.

A null text is an empty one: it has the end id alone. Rows without id come last. Repeated rows are
written as often as they come; rows of equal id are ordered by their ids' checksum. No rows: no shards.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotlake.llm.common import keyed_text, map_batches

END = 1
#: Ids of a shard, about: a shard is closed after the text that fills it.
SHARD_IDS = 1 << 18
#: Rounds of replacement at most, and the count from which a pair is frequent.
ROUNDS, FREQUENT = 8, 4
#: Letters whose normal form is their lower case, and marks that the tokenizer parts from letters before them.
LETTERS = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(192, 256)]) if c not in "×÷")
MARKS = ".,;:!?*#&%$"
#: Pieces of words whose ids a worker remembers.
MEMORY = 800_000
#: Texts that are encoded at once.
SLICE = 2000

_SHARD = ("part int, first_id long, n_ids long, vocabulary int, docs binary, sizes binary, ends binary, left binary, right binary, "
          "lengths binary, sequence binary, null_docs binary")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, bytes]:
    return {"": b""}


@lru_cache(maxsize=2)
def _letters(path: str) -> dict[int, str]:
    """What the merges see in place of the letters beyond ASCII."""
    shown = tokenizer(path).pre_tokenizer.pre_tokenize_str
    return {ord(c): shown(c)[0][0] for c in LETTERS if not c.isascii()}


def _learn(path: str, known: dict[str, bytes], words: list[str]) -> None:
    """Add the ids of new words. Words of ``LETTERS``, which come in lower case, go to the merges as they are; the other words,
    also those that hold an added token, are encoded many at a time and told apart by their places."""
    merges, letters = tokenizer(path).model.tokenize, _letters(path)
    others = []
    for word in words:
        if word.isascii() and word.isalpha():
            known[word] = array("i", [t.id for t in merges(word)]).tobytes()
        elif word.strip(LETTERS):
            others.append(word)
        else:
            known[word] = array("i", [t.id for t in merges(word.translate(letters))]).tobytes()
    for at in range(0, len(others), 8192):
        part = others[at:at + 8192]
        encoded = tokenizer(path).encode(" ".join(part), add_special_tokens=False)
        ends = np.cumsum([len(word) + 1 for word in part])
        place = np.searchsorted(ends, [a for a, _ in encoded.offsets], "right")
        cuts = np.searchsorted(place, np.arange(len(part) + 1))
        ids = np.array(encoded.ids, np.int32)
        known.update((word, ids[a:b].tobytes()) for word, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()))


def _cut(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """The two pieces of each word. Of ``LETTERS`` with ``MARKS`` behind them, or none, they are the letters in lower case,
    their normal form, and the marks: the tokenizer parts them there. Any other word is one piece, as it is."""
    marks = pc.utf8_ltrim(words, characters=LETTERS)
    simple = pc.and_(pc.equal(pc.utf8_rtrim(marks, characters=MARKS), ""), pc.not_equal(marks, words))
    core = pc.if_else(simple, pc.utf8_lower(pc.utf8_rtrim(words, characters=MARKS)), words)
    return core.dictionary_encode(), pc.if_else(simple, marks, "").dictionary_encode()


def _copied(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``starts`` and have ``sizes``, one behind the other."""
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(starts, sizes) + step]


def encode_column(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with the end id behind it, and where each begins and the last ends.

    The tokenizer drops white space and merges nothing across it, and its normal form composes nothing
    with it, so the ids of a text are those of its words in a row. Every different piece of a word is looked up once;
    pieces seen before come from memory.
    """
    known = _memory(path)
    if len(known) > MEMORY:
        known.clear()
        known[""] = b""
    words = pc.ascii_split_whitespace(texts)
    coded = words.values.dictionary_encode()
    cores, marks = _cut(coded.dictionary)
    pieces = [x for d in (cores, marks) for x in d.dictionary.to_numpy(zero_copy_only=False).tolist()]
    parts = list(map(known.get, pieces))
    new = [i for i, p in enumerate(parts) if p is None]
    _learn(path, known, list(dict.fromkeys(pieces[i] for i in new)))
    for i in new:
        parts[i] = known[pieces[i]]
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    pair = np.stack([cores.indices.to_numpy(), marks.indices.to_numpy() + len(cores.dictionary)], 1).ravel()
    flat = _copied(np.frombuffer(b"".join(parts), np.int32), (np.cumsum(sizes) - sizes)[pair], sizes[pair])
    sizes = sizes[pair].reshape(-1, 2).sum(axis=1)
    which = coded.indices.to_numpy()
    each = sizes[which]
    ids = _copied(flat, (np.cumsum(sizes) - sizes)[which], each)
    cuts = np.concatenate([[0], np.cumsum(each)])[words.offsets.to_numpy()]
    offsets = cuts + np.arange(len(cuts))
    out = np.empty(len(ids) + len(texts), np.int32)
    is_end = np.zeros(len(out), np.bool_)
    is_end[offsets[1:] - 1] = True
    out[is_end], out[~is_end] = END, ids
    return out, offsets


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    ids, offsets = encode_column(path, pa.array(texts, pa.string()))
    return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
    """Re-Pair: rules' left and right sides, the sequence, and where each text ends in it. ``sizes``
    are the ids of each text, one or more; no rule reaches from one text into the next.

    A round counts all pairs and replaces every frequent one, where pairs overlap the first of them.
    Rule ``k`` has the number ``vocabulary + k``; its sides are smaller.
    """
    seq, lefts, rights, following = ids.astype(np.int64), [], [], vocabulary
    last = np.zeros(len(seq), np.bool_)
    last[np.cumsum(sizes) - 1] = True
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        pair = (seq[:-1] << 32) | seq[1:]
        # buckets first: only pairs in buckets that are hit often are sorted
        bucket = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)
        often = np.flatnonzero(~last[:-1] & (np.bincount(bucket, minlength=1 << 19)[bucket] >= FREQUENT))
        if not len(often):
            break
        values, place, count = np.unique(pair[often], return_inverse=True, return_counts=True)
        frequent = count >= FREQUENT
        if not frequent.any():
            break
        hits = frequent[place]
        at, rule = often[hits], (np.cumsum(frequent) - 1)[place[hits]]
        # in a row of overlapping pairs every second is replaced
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[chosen], rule[chosen]
        seq[at] = following + rule
        last[at] = last[at + 1]
        seq, last = np.delete(seq, at + 1), np.delete(last, at + 1)
        lefts.append(values[frequent] >> 32)
        rights.append(values[frequent] & 0xFFFFFFFF)
        following += int(frequent.sum())
    join = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
    return join(lefts), join(rights), seq.astype(np.int32), (np.flatnonzero(last) + 1).astype(np.int32)


def rule_lengths(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out = np.ones(len(left), np.int64)
    for side in (left, right):
        if len(side) and side.max() >= vocabulary + len(left):
            raise ValueError("a rule names a later rule")
    done = 0
    while done < len(left):  # rules up to the next one that needs a rule not yet known
        ready = np.maximum(left[done:], right[done:]) < vocabulary + done
        n = len(ready) if ready.all() else int(np.argmin(ready))
        if not n:
            raise ValueError("a rule names itself or a later rule")
        part = slice(done, done + n)
        out[part] = sum(np.where(side[part] >= vocabulary, out[np.maximum(side[part] - vocabulary, 0)], 1)
                        for side in (left, right))
        done += n
    return out


def _unfold(seq: np.ndarray, left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """All rules replaced by their sides until only ids are left."""
    while (rule := seq >= vocabulary).any():
        at = np.cumsum(1 + rule) - 1  # last place of each symbol in the longer sequence
        out = np.empty(len(seq) + int(rule.sum()), np.int32)
        out[at[~rule]] = seq[~rule]
        k = seq[rule] - vocabulary
        out[at[rule] - 1], out[at[rule]] = left[k], right[k]
        seq = out
    return seq


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a sequence: every rule is unfolded once, then each use of it is copied by its length."""
    rule = seq >= vocabulary
    k = seq[rule] - vocabulary
    used, which = np.unique(k, return_inverse=True)
    flat = _unfold((used + vocabulary).astype(np.int32), left, right, vocabulary)
    size = np.ones(len(seq), np.int64)
    size[rule] = lengths[k]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    out[ends[~rule] - 1] = seq[~rule]
    n, begin = size[rule], ends[rule] - size[rule]
    source = (np.cumsum(lengths[used]) - lengths[used])[which]
    out[_copied(np.arange(len(out)), begin, n)] = _copied(flat, source, n)
    return out


def shard(part: int, first_id: int, docs: list[int | None], ids: list[np.ndarray], vocabulary: int) -> dict:
    whole = np.concatenate(ids)
    sizes = np.array([len(x) for x in ids], np.int32)
    left, right, seq, ends = compress(whole, sizes, vocabulary)
    return {"part": part, "first_id": first_id, "n_ids": len(whole), "vocabulary": vocabulary,
            "docs": np.array([d or 0 for d in docs], np.int64).tobytes(),
            "sizes": sizes.tobytes(), "ends": ends.tobytes(),
            "left": left.tobytes(), "right": right.tobytes(),
            "lengths": rule_lengths(left, right, vocabulary).astype(np.int32).tobytes(), "sequence": seq.tobytes(),
            "null_docs": np.array([d is None for d in docs], np.bool_).tobytes()}


def _bounds(docs: DataFrame, id_col: str, parts: int) -> np.ndarray:
    """Ids that cut the texts into parts of about equal number, from a sketch of the ids alone. The sketch rounds them;
    as whole numbers they still cut exactly, only elsewhere."""
    at = [i / parts for i in range(1, parts)]
    found = docs.select(F.col(id_col).cast("double").alias("id")).stat.approxQuantile("id", at, 0.1 / parts) if at else []
    return np.array([min(int(b), np.iinfo(np.int64).max) for b in found], np.int64)


def parts_of(docs: pa.Array, checks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The parts of texts; parts ascend with (id, checksum). An id that fills several parts, or a null one, is
    spread over them by checksum."""
    none, ids = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
    low = np.where(none, len(bounds) + 1, np.searchsorted(bounds, ids, "left"))
    high = np.where(none, 2 * len(bounds) + 1, np.searchsorted(bounds, ids, "right"))
    return low + ((high - low + (high > low)) * checks >> 32)


def write(docs: DataFrame, tokens: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their shards to ``path``.

    Texts are encoded where they are read; their ids, two bytes each where the vocabulary allows, are shuffled once.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, id_col, parts)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary = tokenizer(tokens).get_vocab_size()
        narrow = np.uint16 if vocabulary <= 1 << 16 else np.int32
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            docs_ = part.column("doc_id")
            ids, offsets = encode_column(tokens, part.column("text"))
            packed = [ids[a:b].astype(narrow).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            checks = np.array([zlib.crc32(x) for x in packed], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts_of(docs_, checks, bounds), pa.int32()), docs_, pa.array(checks), pa.array(packed, pa.binary())],
                ["part", "doc_id", "check", "packed"])

    def shards(batches):
        vocabulary = tokenizer(tokens).get_vocab_size()
        narrow = np.uint16 if vocabulary <= 1 << 16 else np.int32
        at, first, docs_, ids, n = None, 0, [], [], 0
        for batch in batches:
            for part, doc, blob in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("packed")):
                if docs_ and (part != at or n >= SHARD_IDS):
                    yield _row(shard(at, first, docs_, ids, vocabulary))
                    first, docs_, ids, n = first + n, [], [], 0
                if part != at:
                    at, first = part, 0
                docs_.append(doc)
                ids.append(np.frombuffer(blob.as_buffer(), narrow).astype(np.int32))
                n += len(ids[-1])
        if docs_:
            yield _row(shard(at, first, docs_, ids, vocabulary))

    rows = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = map_batches(rows, pack, "part int, doc_id long, check long, packed binary").repartition(parts, "part")
    ordered = packed.sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "check")
    ordered.mapInArrow(shards, _SHARD).write.option("compression", "zstd").parquet(path)


def _row(fields: dict) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "first_id": pa.int64(), "n_ids": pa.int64(), "vocabulary": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in fields.items()], list(fields))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every text of the shards: ``doc_id``, ``start`` (ids before it), ``ids`` (little-endian, 32 bits)."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            yield texts_of(row)

    texts = map_batches(shards.drop("n_ids", "ends"), run, "part int, doc_id long, place long, ids binary")
    return texts.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("place")).alias("start"), "ids")


def texts_of(row: dict) -> pa.RecordBatch:
    left, right = np.frombuffer(row["left"], np.int32), np.frombuffer(row["right"], np.int32)
    lengths = np.frombuffer(row["lengths"], np.int32)
    ids = expand(np.frombuffer(row["sequence"], np.int32), left, right, lengths, row["vocabulary"])
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
    starts = np.concatenate([[0], ends[:-1]])
    docs = np.frombuffer(row["docs"], np.int64)
    raw = ids.tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(docs, mask=np.frombuffer(row["null_docs"], np.bool_)),
         pa.array(row["first_id"] + starts), pa.array([raw[4 * a:4 * b] for a, b in zip(starts, ends)], pa.binary())],
        ["part", "doc_id", "place", "ids"])


def text_at(row: dict, k: int) -> np.ndarray:
    """The ids of the ``k``-th text of a shard, without expanding the others."""
    ends = np.frombuffer(row["ends"], np.int32)
    seq = np.frombuffer(row["sequence"], np.int32)[ends[k - 1] if k else 0:ends[k]]
    parts = [np.frombuffer(row[c], np.int32) for c in ("left", "right", "lengths")]
    return expand(seq, *parts, row["vocabulary"])


def id_at(row: dict, place: int) -> int:
    """The id at a place of a shard: the sequence is searched by expansion lengths, then one rule is followed down."""
    seq, lengths = np.frombuffer(row["sequence"], np.int32), np.frombuffer(row["lengths"], np.int32)
    left, right = np.frombuffer(row["left"], np.int32), np.frombuffer(row["right"], np.int32)
    long = lambda s: lengths[s - row["vocabulary"]] if s >= row["vocabulary"] else 1
    spans = np.where(seq >= row["vocabulary"], lengths[np.maximum(seq - row["vocabulary"], 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(spans)
    k = int(np.searchsorted(ends, place, "right"))
    symbol, place = int(seq[k]), place - int(ends[k] - spans[k])
    while symbol >= row["vocabulary"]:
        a, b = int(left[symbol - row["vocabulary"]]), int(right[symbol - row["vocabulary"]])
        symbol, place = (a, place) if place < long(a) else (b, place - long(a))
    return symbol
