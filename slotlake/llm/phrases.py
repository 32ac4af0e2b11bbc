"""Phrases of words that keep company, by stripes: per language, with exact counts.

A stripe belongs to a prefix of words and counts the words that come next. A task counts the stripes of its
texts, they are shuffled by prefix (and a part of the next words, so that a frequent prefix is shared out) and merged
element by element. All that is asked for comes from merged stripes: the counters are the counts of the
extensions, their sum is the count of the prefix (the end of a piece is an entry, too), and the largest counter at a
phrase, as a head or as a tail, says whether a longer phrase swallows it. Only frequent entries are kept
one by one; the rest of a stripe becomes one sum.

A longer prefix is looked at only where it and the words one further on were frequent: a phrase is never more
frequent than its parts. Tasks know the frequent phrases from a filter of at most 2^``MOST_BITS`` bits (32 MB); beyond
some 10^7 frequent phrases it lets more through, and what it lets through in error is counted, found rare
and left out, so results never depend on it.

A null text is empty, a null language is ``und``. Equal rows count each. No rows give no phrases. Other columns are left behind.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze

#: Bits of the filter, in powers of two. Parts of a stripe. Texts turned into numbers at once, in bytes; words counted at once.
MOST_BITS, PARTS, TEXTS, WORDS = 28, 16, 1 << 22, 1 << 22
#: A to Z in lower case, tabs to spaces, all ends of pieces to one; the end of a piece as a word that UTF-8 cannot hold.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
END = b"\xff"

_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split(text: bytes) -> list[bytes]:
    """Words, and ``END`` between pieces."""
    return text.translate(LETTERS).replace(b"\n", b" %b " % END).split()


class Numbered:
    """Words as numbers, with their hashes; number 0 is the end of a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.numbers([END])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))

    def names(self) -> pa.Array:
        return pa.array([b"", *list(self.number)[1:]], pa.binary()).cast(pa.string())


def texts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Numbered, dict[str, np.ndarray]]]:
    """Numbered words of all texts of a task, some ``WORDS`` at a time; every text ends with the end of a piece."""
    known, done, waiting, n = Numbered(), defaultdict(list), defaultdict(list), 0

    def settle(lang):
        nonlocal n
        done[lang].append(known.numbers(split(b"\n".join([*waiting.pop(lang), b""]))))
        n += len(done[lang][-1])

    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            waiting[lang].append(text.as_py().encode())
            size[lang] += len(waiting[lang][-1])
            if size[lang] >= TEXTS:
                settle(lang)
                size[lang] = 0
            if n >= WORDS:
                yield known, {k: np.concatenate(v) for k, v in done.items()}
                known, n = Numbered(), 0
                done.clear()
    for lang in list(waiting):
        settle(lang)
    if n:
        yield known, {k: np.concatenate(v) for k, v in done.items()}


class Filter:
    """A set of phrases that may hold more than was put in."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    @staticmethod
    def start(lang: str) -> np.uint64:
        return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))

    @staticmethod
    def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - bits)

    @staticmethod
    def hashes(start: np.uint64, words: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(words[0]), start, np.uint64)
        for w in words:
            out = out * _FACTOR + w
        return out

    def __contains__(self, _):
        raise TypeError("ask for arrays with may_hold")

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slots = self.slots(hashes, self.bits)
        return (self.cells[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, grams: DataFrame) -> Filter:
        """From a written table of ``lang``, ``phrase``. The driver gets cells of 64 bits that are set, never phrases."""
        bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, grams.count())))))

        def run(batches):
            for batch in batches:
                hashes = [cls.hashes(cls.start(lang), [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")])
                          for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
                if hashes:
                    slots = cls.slots(np.concatenate(hashes), bits)
                    bit = np.left_shift(np.uint64(1), slots & np.uint64(63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["cell", "bit"])

        found = grams.select("lang", "phrase").mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        cells = np.zeros(1 << (bits - 6), np.uint64)
        cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(bits, cells)


def count_stripes(ids: np.ndarray, known: Numbered, lang: str, hashes: np.ndarray, names: pa.Array, size: int,
                  frequent: Filter | None) -> pa.RecordBatch | None:
    """Stripes of all prefixes of ``size`` words: what comes next, and how often.

    For single words the end of a piece counts as a next word, with an empty name.
    """
    ok = np.ones(max(0, len(ids) - size), bool)
    for j in range(size + (frequent is not None)):
        ok &= ids[j:j + len(ok)] != 0
    at = np.flatnonzero(ok)
    if frequent is not None and len(at):
        start = Filter.start(lang)
        for shift in (0, 1):
            at = at[frequent.may_hold(Filter.hashes(start, [hashes[ids[at + shift + j]] for j in range(size)]))]
    if not len(at):
        return None
    many = len(known.number)
    prefix, first = ids[at], at
    for j in range(1, size):
        _, first, prefix = np.unique(prefix * many + ids[at + j], return_index=True, return_inverse=True)
        first = at[first]
    pairs, n = np.unique(prefix * many + ids[at + size], return_counts=True)
    prefix, word = pairs // many, pairs % many
    part = (hashes[word] % np.uint64(PARTS)).astype(np.int64)
    order = np.lexsort((part, prefix))
    prefix, word, part, n = prefix[order], word[order], part[order], n[order]
    begins = np.flatnonzero(np.diff(prefix * PARTS + part, prepend=-1))
    offsets = pa.array(np.append(begins, len(word)).astype(np.int32))
    heads = prefix[begins]
    if size == 1:
        texts = names.take(pa.array(heads))
    else:
        texts = pc.binary_join_element_wise(*[names.take(pa.array(ids[first[heads] + j])) for j in range(size)], " ")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(heads), pa.string()), texts, pa.array(part[begins], pa.int32()),
         pa.ListArray.from_arrays(offsets, names.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))],
        ["lang", "prefix", "part", "next", "n"])


def stripes(texts: DataFrame, size: int, frequent: Filter | None = None) -> DataFrame:
    """``lang``, ``prefix``, ``part``, ``next``, ``n``: merged stripes of prefixes of ``size`` words, one row an entry."""
    def run(batches):
        for known, by_lang in texts_by_language(batches):
            hashes, names = known.hashes(), known.names()
            for lang, ids in by_lang.items():
                found = count_stripes(ids, known, lang, hashes, names, size, frequent)
                # some thousand stripes at a time
                for i in range(0, found.num_rows if found else 0, 4096):
                    yield found.slice(i, 4096)

    counted = texts.mapInArrow(run, "lang string, prefix string, part int, next array<string>, n array<long>")
    # equal prefixes meet once; the element-wise sums need no further exchange
    met = counted.repartition("lang", "prefix", "part")
    entries = met.select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "n")))
    return entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("n"))


def _grams(entries: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words with their heads and tails, all words but the last or the first."""
    phrase = F.concat_ws(" ", "prefix", "next")
    return entries.select("lang", phrase.alias("phrase"), F.lit(size).alias("size"), F.col("prefix").alias("head"),
                          F.expr("substring(concat_ws(' ', prefix, next), instr(prefix || ' ', ' ') + 1)").alias("tail"), F.col("n").alias("a"))


def count(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text",
          lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of a corpus: ``lang``, ``n`` of all words; ``lang``, ``phrase``, ``f`` of frequent phrases of one word and
    more; and those of two and more with ``size``, ``head``, ``tail``, ``a``."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    often = (F.col("n") >= least) & (F.col("next") != "")
    pairs = stripes(texts, 1).groupBy("lang", "prefix", "part", F.when(often, F.col("next")).alias("next")).agg(F.sum("n").alias("n"))
    pairs = freeze(pairs, "stripes")
    words = freeze(pairs.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    totals = freeze(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    grams = freeze(_grams(pairs.where("next IS NOT NULL"), 2), "grams")
    levels, size = [grams], 2
    while size < longest and not grams.isEmpty():
        merged = stripes(texts, size, Filter.of(grams)).where(F.col("n") >= least)
        size += 1
        grams = freeze(_grams(merged, size), "grams")
        levels.append(grams)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    counts = words.where(F.col("f") >= least).unionByName(phrases.where(F.col("size") < longest).select("lang", "phrase", F.col("a").alias("f")))
    return totals, counts, phrases


def unswallowed(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer phrase is as frequent as. One word more decides: counts never rise with length."""
    longer = phrases.where("size > 2")
    swallow = longer.select("lang", F.col("head").alias("phrase"), "a").unionByName(longer.select("lang", F.col("tail").alias("phrase"), "a"))
    most = swallow.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 100 * a").drop("most")


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` at the cut where the score is least."""
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
                             "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = "CAST({} AS DECIMAL(38, 0))".format
    score = F.expr(f"CAST(({exact(1000)} * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')}) AS BIGINT)")
    best = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def first_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` first rows of each language with their ``rank``; first of many shares, then of fewer, then of all."""
    order = "ORDER BY score DESC, a DESC, phrase"
    for shares in (4096, 32):
        rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {shares}) {order})"))
        rows = rows.where(F.col("rank") <= limit).drop("rank")
    return rows.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, limit: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of each language."""
    totals, counts, phrases = count(docs, longest, least, text_col, lang_col)
    best = scored(freeze(unswallowed(phrases), "phrases"), counts, totals)
    return first_of_each(best, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
