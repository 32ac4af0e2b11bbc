"""Near duplicates by SimHash, compared over tables of distances to reference fingerprints.

A fingerprint has 64 bits: a bit is set if over half of the text's word shingles have it in their XXH64.
Texts with the same fingerprint are one class; classes are compared, copies are not.

Two fingerprints that differ in ``d`` bits have distances to any reference that differ by ``d`` at most.
The references come in two kinds. *Cell references* differ from zero in the bits of one cell; the
distances to them and to zero fix how many bits of the cell a fingerprint has. Cells are grouped in
bands: with ``d`` differing bits and ``d + k`` bands, some ``k`` bands agree in all coordinates, so classes that
share the coordinates of ``k`` bands are the candidates and no link is missed. *Check references* are
scattered; a pair whose distances to any of them differ by more than ``d`` is discarded, and what survives
is compared bit by bit.

A bucket of many classes that agree on ``k`` bands would give all its pairs. Beyond ``CROWD`` classes its
members are linked over midpoints instead: fingerprints differ in two bits or fewer exactly if they share
a fingerprint that differs from each in one bit or none, so each member is listed under its 65 midpoints
and linked to the smallest listed there. That is linear in the members and just as exact.

``similar``, ``similar_by_leaders`` and ``keep_one_similar`` compare five-word shingles by exact Jaccard similarity:
that is what the pipeline's stage takes as near copies, far wider than two bits. ``similar`` takes the fingerprints of these
shingles through the same tables first, the sets decide, and what two bits do not reach is found by parts of the sets. It loses no link.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows share a
class. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, keyed_text, map_batches, words_of
from slotlake.llm.components import components
from slotlake.llm.exact_dedup import mark_members

SEED, BITS = 42, 64
#: Differing bits of a link.
DISTANCE = 2
#: Bits of a cell, check references, and classes of a bucket that are still compared pair by pair.
CELL_BITS, CHECKS, CROWD = 2, 16, 32
#: Near copies by similarity: words of a shingle, the least Jaccard similarity as a fraction, and the bits in
#: which fingerprints of texts and their leaders may differ. At 0.8 they differ in 10 on average, by 3:
#: by the binomial a link is lost with a chance of 3 * 10^-6, between sets of 4 and 5 shingles, where votes tie, 10^-4.
WORDS, PART, WHOLE, REACH = 5, 4, 5, 24
#: Bands and hash functions of a band: 0.8 meets in one of 16 bands with probability 0.998, 0.6 with 0.73. Shingles
#: whose minima are taken together, about. Leaders of a bucket and comparisons of a text, round by round; links that
#: a name of a group reaches over.
BANDS, HASHES, BLOCK, DRAWS, HOPS = 16, 5, 1 << 19, (1, 4, 4), 3
#: Texts that the order of shingles is drawn from, and shingles in it.
ORDER_ROWS, COMMON = 4000, 100_000
#: Parts of a set at least, longs of its parities, and texts of a part that all its others are compared with first.
LEAST_PARTS, PARITIES, FIRST = 16, 16, 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; a shorter text is one run, no words are none."""
    words = words_of(text)
    words = b" ".join(words).lower().split(b" ") if words else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) > shingle:
        pieces = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    else:
        pieces = [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in pieces], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return _majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp``, the 64 bits as a signed number.
    ``bytes.lower`` lowers A-Z and nothing else."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"),
                                          pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return map_batches(rows, run, "doc_id long, mark long, fp long")


def check_references(n: int = CHECKS) -> list[int]:
    """Scattered fingerprints, the same in every run."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode()) - (1 << 63) for i in range(n)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _bands(rows: int, distance: int) -> list[tuple[int, ...]]:
    """Groups of cells that make a bucket key: fine enough for ``rows`` classes, about 1.4 bits a cell."""
    cells = BITS // CELL_BITS
    bands = distance + 1
    while bands < 8 and 1.4 * cells * (bands - distance) / bands < math.log2(max(rows, 2)) + 2:
        bands += 1
    parts = [tuple(range(b, cells, bands)) for b in range(bands)]
    return [sum(group, ()) for group in combinations(parts, bands - distance)]


def pivot_table(classes: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """One row per class and group of bands: ``key`` holds the coordinates of the group's cells.

    A coordinate is (|x| + |cell| - distance(x, cell reference)) / 2, the set bits of x in the cell.
    """
    zero = F.bit_count("fp")
    mask = (1 << CELL_BITS) - 1
    coordinates = [((zero + CELL_BITS - F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(mask << (CELL_BITS * c))).cast("long")))) / 2)
                   .cast("int") for c in range(BITS // CELL_BITS)]
    table = classes.withColumns({f"_c{i}": c for i, c in enumerate(coordinates)})

    def key(g: int, group: tuple[int, ...]) -> Column:
        out = F.lit(g).cast("long")
        for c in group:
            out = out * (CELL_BITS + 1) + F.col(f"_c{c}")
        return out

    keys = F.array(*[key(g, group) for g, group in enumerate(groups)])
    return table.select("fp", F.posexplode(keys).alias("g", "key"))


def pairs(buckets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between classes of a bucket, a < b: pivots discard, the bits decide.

    ``buckets`` has a row per bucket with its classes, ``CROWD`` at most.
    """
    left = F.explode("members").alias("a")
    rows = buckets.select("members", left).select("a", F.explode(F.filter("members", lambda m: m > F.col("a"))).alias("b"))
    near = F.lit(True)
    for p in check_references():
        apart = F.bit_count(F.col("a").bitwiseXOR(F.lit(p))) - F.bit_count(F.col("b").bitwiseXOR(F.lit(p)))
        near = near & (F.abs(apart) <= distance)
    return rows.where(near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def midpoint_links(crowd: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly what a distance of two bits connects, over shared midpoints."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    listed = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    least = listed.groupBy("mid").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return least.select(F.explode("fps").alias("a"), "b").where("a <> b").distinct()  # 65 members of a midpoint at most


def near_classes(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints; connected as all links of ``distance`` bits or fewer are."""
    if distance != DISTANCE:
        raise ValueError("midpoints stand for two differing bits")
    groups = _bands(classes.count(), distance)
    table = pivot_table(classes, groups)
    sizes = table.groupBy("g", "key").agg(F.count("*").alias("n")).where("n > 1")
    kept = freeze(table.join(freeze(sizes, "pivot_buckets"), ["g", "key"]), "pivot_rows")
    small = (kept.where(F.col("n") <= CROWD).groupBy("g", "key").agg(F.collect_list("fp").alias("members")).select("members"))
    crowd = kept.where(F.col("n") > CROWD).select("fp").distinct()
    return pairs(small, distance).unionByName(midpoint_links(crowd))


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, fp, ``root``, the fingerprint that stands for its component,
    and component_id, the smallest id reachable by links."""
    prints = freeze(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = freeze(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    links = near_classes(classes.select("fp"))
    linked = components(links).withColumnsRenamed({"node": "fp", "component": "root"})
    ids = classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = freeze(ids.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = freeze(ids.join(roots, "root").select("fp", "root", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, fp and component_id, the smallest id reachable by links."""
    return rooted(docs, id_col, text_col, shingle).drop("root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each component: the one whose id names it."""
    return one_of_each(docs, rooted(docs, id_col, text_col, shingle), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each ``root`` of ``found`` (doc_id, mark, root): the smallest id, and where no
    row has an id the smallest mark. Of repeated rows with that id and text one stays, by a hash of their contents."""
    texts = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rows"))
    chosen = freeze(texts.groupBy("root").agg(first.alias("m")).select("m.doc_id", "m.mark", "m.rows"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    kept = keyed.join(chosen, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("mark")))
    once = kept.where("rows = 1").select("row")
    again = kept.where("rows > 1").groupBy("doc_id", "mark").agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return once.unionByName(again).select("row.*")


# Near copies by similarity: word shingles, Jaccard

def _roles(n: int) -> list[tuple[int, int]]:
    """The levels at which a set of ``n`` shingles meets its partners, and in how many shingles it may differ from them.

    A level has the pairs whose smaller set has ``2 ** level`` shingles or more, and fewer than twice that. Sets of
    ``a`` and ``b`` shingles have the similarity if they differ in ``(a + b) * (WHOLE - PART) / (WHOLE + PART)`` or fewer.
    """
    level = n.bit_length() - 1
    roles = [(level, (n + n * WHOLE // PART) * (WHOLE - PART) // (WHOLE + PART))]
    below = (1 << level) - 1
    if below and below * WHOLE >= n * PART:
        roles.append((level - 1, (n + below) * (WHOLE - PART) // (WHOLE + PART)))
    return roles


def _parts(level: int) -> int:
    """Parts of a level: more than any two of its sets may differ in, and few enough to hold several shingles each."""
    return max((2 << level) // 3 + 1, LEAST_PARTS)


def part_keys(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Hashes of the parts under which a set of shingles meets all sets of the similarity.

    Shingles are dealt over the parts of a level by hash. Sets that differ in ``d`` shingles differ in ``d`` parts at most,
    so in any order of all parts by their contents, the first ``d + 1`` of either set hold one that both have.
    The order puts parts first that hold a rare shingle, then large ones; empty ones are last.
    """
    n, out = len(found), []
    value = found * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    for level, apart in _roles(n) if n else []:
        parts = _parts(level)
        part = (value % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        content, where = np.add.reduceat(value[order], starts), part[starts]
        size, rarest = np.diff(starts, append=n), np.minimum.reduceat(often[order], starts)
        if len(starts) <= apart:
            empty = np.setdiff1d(np.arange(parts), where)
            content, where = np.append(content, np.zeros(len(empty), np.uint64)), np.append(where, empty)
            size = np.append(size, np.zeros(len(empty), np.int64))
            rarest = np.append(rarest, np.full(len(empty), np.iinfo(np.int64).max))
        name = (content ^ (where * 64 + level + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
        name ^= name >> np.uint64(29)
        out.append(name[np.lexsort((name, -size, rarest))[:apart + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parities(found: np.ndarray) -> np.ndarray:
    """``64 * PARITIES`` bits: whether an odd number of the shingles fall there. Two sets differ in as many shingles, at
    least, as bits differ."""
    value = found * np.uint64(0xD6E8FEB86659FD93)
    bits = np.bincount((value >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(bits.astype(np.bool_), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, common: dict[int, int], id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """``doc_id``, ``mark``, ``key`` (a hash of the set of shingles), ``n`` shingles, ``fp``, ``parts`` (``part_keys``) and ``odd``
    (``parities``). How often ``common`` has a shingle says how rare it is. A text without words has no parts; such
    texts share their key."""
    names = np.array(sorted(common), np.int64)
    times = np.array([common[k] for k in names.tolist()], np.int64)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, sizes, prints, parts, odd = [], [], [], [], []
        for text in batch.column("text"):
            found = np.unique(shingle_hashes(text.as_py(), shingle))
            signed, n = found.view(np.int64), len(found)
            often = np.zeros(n, np.int64)
            if len(names) and n:
                at = np.minimum(np.searchsorted(names, signed), len(names) - 1)
                often = np.where(names[at] == signed, times[at], 0)
            keys.append(_signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)))
            sizes.append(n)
            prints.append(_signed(_majority(found)))
            parts.append(part_keys(found, often).view(np.int64))
            odd.append(parities(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(prints, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
            ["doc_id", "mark", "key", "n", "fp", "parts", "odd"])

    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return map_batches(rows, run, "doc_id long, mark long, key long, n long, fp long, parts array<long>, odd array<long>")


def common_shingles(docs: DataFrame, text_col: str = "text", shingle: int = WORDS) -> dict[int, int]:
    """Shingles that several of about ``ORDER_ROWS`` texts have, the ``COMMON`` most frequent. They only decide the
    order of the parts, which changes the work and never the links."""
    every = max(1, docs.count() // ORDER_ROWS)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), shingle)).view(np.int64))], ["h"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = map_batches(texts, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return {r.h: r.n for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()}


def _may_link(a: str, b: str, distance: int) -> Column:
    """Sizes that allow the similarity, and fingerprints in reach."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((F.least(na, nb) * WHOLE >= F.greatest(na, nb) * PART)
            & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance))


def _may_be_similar(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and no more differing parities than it allows."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(PARITIES)), F.lit(0))
    return (F.least(na, nb) * WHOLE >= F.greatest(na, nb) * PART) & (differ * (WHOLE + PART) <= (na + nb) * (WHOLE - PART))


def sets_of(wanted: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """``key`` and ``shingles`` of the keys in ``wanted``. Only texts with these keys are read for their sets, found
    through a Bloom filter of their marks."""
    marks = freeze(rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("mark").alias("h")), "pair_marks")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in batch.column("text"):
            found = np.unique(shingle_hashes(text.as_py(), shingle))
            yield pa.RecordBatch.from_arrays([pa.array([_signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))], pa.int64()),
                                              pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["key", "shingles"])

    sets = map_batches(mark_members(texts, marks.select("h")).where("suspect").select("text"), run, "key long, shingles array<long>")
    return freeze(sets.dropDuplicates(["key"]), "shingle_sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets of shingles have the similarity."""
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_a")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("_b")), "b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    # shared / (|a| + |b| - shared) >= PART / WHOLE
    return freeze(both.where(shared * (PART + WHOLE) >= (F.size("_a") + F.size("_b")) * PART).select("a", "b"), "similar")


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def print_pairs(sized: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are equal or linked by ``near_classes``, over the least key of each fingerprint,
    where sizes and parities allow the similarity. ``sized`` has a row per set."""
    classes = freeze(sized.where("n > 0").groupBy("fp").agg(F.min("key").alias("first")), "classes")
    equal = sized.join(classes, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    of = lambda name: classes.select(F.col("fp").alias(f"_{name}"), F.col("first").alias(name))
    linked = near_classes(classes.select("fp")).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    linked = linked.join(of("a"), "_a").join(of("b"), "_b").select("a", "b")
    found = freeze(equal.unionByName(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print_pairs")
    row = lambda name: sized.select(F.col("key").alias(name), F.struct("n", "odd").alias(f"_{name}"))
    return found.join(row("a"), "a").join(row("b"), "b").where(_may_be_similar("_a", "_b")).select("a", "b")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark and ``root``, the same for texts that links connect. A link is a Jaccard
    similarity of word shingles of ``PART / WHOLE`` or more.

    Exact: sets of the similarity share a part (``part_keys``), sizes and parities discard only what is less similar, and the
    sets decide. Texts whose fingerprints are within ``DISTANCE`` bits (``print_pairs``) are compared first, and all texts of
    a part with a few of them, so that large groups grow
    together in linear work; then every pair of a part whose texts are in different groups. Only texts that are in no
    group, though they share parts with many others, cost the square of their number, and that in parities alone.
    """
    rows = freeze(shingle_sets(docs, common_shingles(docs, text_col, shingle), id_col, text_col, shingle), "parts")
    sized = freeze(rows.select("key", "n", "fp", "odd").distinct(), "parities")
    shared = rows.select(F.explode("parts").alias("h"), "key").groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    shared = freeze(shared.where("lo <> hi").select("h"), "shared")
    posted = mark_members(rows.select(F.explode("parts").alias("h"), "key"), shared).where("suspect").drop("suspect").distinct()
    posted = freeze(posted.join(shared, "h", "left_semi"), "postings")
    drawn = F.array(*[F.min_by("key", F.xxhash64("key", F.lit(d))) for d in range(FIRST)])
    drawn = freeze(posted.groupBy("h").agg(drawn.alias("ys")).select("h", F.explode(F.array_distinct("ys")).alias("key")), "drawn")
    # parities, by far the longest column, are joined where they are compared: in order of their key, so that the next shuffle packs equal ones
    side = lambda t, name, *more: t.select("h", F.struct("key", "n", "odd", *more).alias(name))
    pair = [F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")]
    first = side(posted.join(sized, "key"), "x").join(side(drawn.join(sized, "key"), "y"), "h").where("x.key <> y.key").where(_may_be_similar("x", "y"))
    first = freeze(first.select(*pair).unionByName(print_pairs(sized)).distinct(), "candidates")
    links = verified(first, sets_of(_keys(first), docs, rows, text_col, shingle))
    group = freeze(components(links).withColumnsRenamed({"node": "key", "component": "root"}), "groups")
    placed = freeze(posted.join(group, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    open_ = freeze(placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"), "open")
    left = freeze(placed.join(open_, "h", "left_semi").join(sized, "key"), "open_postings")
    rest = side(left, "x", "root").join(side(left, "y", "root"), "h").where("x.root < y.root").where(_may_be_similar("x", "y"))
    rest = freeze(rest.select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "candidates")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, sets_of(_keys(rest), docs, rows, text_col, shingle)))
        group = freeze(components(links).withColumnsRenamed({"node": "key", "component": "root"}), "groups")
    return rows.join(group, "key", "left").select("doc_id", "mark", F.coalesce("root", "key").alias("root"))


# Near copies by leaders: bands of minima, one comparison a text and round

def _minima(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a set, ``BANDS * HASHES`` columns: the least value of each hash function over the set's shingles."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(1 << 62, size=BANDS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(offsets) - 1, len(factors)), np.uint64)
    mixed = flat ^ (flat >> np.uint64(31))
    for i, factor in enumerate(factors):
        value = mixed * factor
        out[:, i] = np.minimum.reduceat(value ^ (value >> np.uint64(32)), offsets[:-1])
    return out


def banded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """``doc_id``, ``mark``, ``key`` (a hash of the set of shingles), ``n``, ``fp`` and ``bands``: a hash of ``HASHES`` minima
    for each of ``BANDS`` bands. Two sets of similarity ``s`` agree in a band with probability ``s ** HASHES``. A text
    without words has no band; such texts share their key."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, sets, n = 0, [], 0
        for i, text in enumerate(batch.column("text")):
            sets.append(np.unique(shingle_hashes(text.as_py(), shingle)))
            n += len(sets[-1])
            if n < BLOCK and i < batch.num_rows - 1:
                continue
            full = [j for j, found in enumerate(sets) if len(found)]
            bands = [[] for _ in sets]
            if full:
                flat = np.concatenate([sets[j] for j in full])
                least = _minima(flat, np.cumsum([0, *[len(sets[j]) for j in full]])).reshape(len(full), BANDS, HASHES)
                for j, rows in zip(full, least):
                    bands[j] = [_signed(xxhash.xxh64_intdigest(row.tobytes(), b)) for b, row in enumerate(rows)]
            part = batch.slice(at, len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets], pa.int64()),
                 pa.array([len(x) for x in sets], pa.int64()), pa.array([_signed(_majority(x)) for x in sets], pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "n", "fp", "bands"])
            at, sets, n = i + 1, [], 0

    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return map_batches(rows, run, "doc_id long, mark long, key long, n long, fp long, bands array<long>")


def _names(links: DataFrame, hops: int = HOPS) -> DataFrame:
    """``key`` and ``root``, the least key within ``hops`` links. Texts of one name are connected; connected texts mostly
    have one name, which saves comparisons and decides nothing."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    name = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    for _ in range(hops - 1):
        # written, so that a text with very many links meets a plain shuffle that can be split
        name = freeze(name, "names")
        name = both.join(name, F.col("b") == F.col("key")).groupBy(F.col("a").alias("key")).agg(F.least(F.min("root"), F.first("a")).alias("root"))
    return freeze(name, "names")


def _leaders(posted: DataFrame, turn: int, draws: int) -> DataFrame:
    """``h`` and ``y``, up to ``draws`` texts of each bucket: by turns the least by a hash of the text, the same in all of its
    buckets, and one of a group drawn by a hash, so that small groups are drawn as often as large ones."""
    y = F.struct("key", "n", "fp", "root")
    drawn = []
    for d in range(draws):
        salt = F.lit(turn * 1000 + d)
        by_text = F.xxhash64("key", salt)
        drawn.append(F.min_by(y, F.struct(F.xxhash64("root", "h", salt), by_text) if d % 2 else by_text))
    return posted.groupBy("h").agg(F.array(*drawn).alias("ys")).select("h", F.explode(F.array_distinct("ys")).alias("y"))


def similar_by_leaders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, distance: int = REACH,
                       draws: tuple[int, ...] = DRAWS) -> DataFrame:
    """As ``similar`` but for lost links, in work that is linear in the rows however large a group of like texts is.

    Texts that agree in a band are in one bucket. A round draws leaders of every open bucket, as many as ``draws`` says
    for it, and each text is compared exactly with as many of the leaders it meets, those it shares most buckets with and
    is not yet grouped with. Buckets of one group are closed. No pair is compared twice. After the last round, or one
    that has nothing left to compare, links make the groups: a text joins a group by any of its members, so what is
    lost are texts whose only partners were never drawn.
    """
    rows = freeze(banded(docs, id_col, text_col, shingle), "bands")
    posted = rows.select(F.explode("bands").alias("h"), "key", "n", "fp").distinct()
    sizes = freeze(posted.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "buckets")
    posted = freeze(posted.join(sizes, "h", "left_semi").withColumn("root", F.col("key")), "postings")
    sets = sets_of(posted.select("key").distinct(), docs, rows, text_col, shingle)
    links = compared = None
    for turn, width in enumerate(draws):
        if links is not None:
            placed = posted.drop("root").join(_names(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
            open_ = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
            posted = freeze(placed.join(freeze(open_, "open"), "h", "left_semi"), "open_postings")
        x = posted.select("h", F.struct("key", "n", "fp", "root").alias("x"))
        met = x.join(freeze(_leaders(posted, turn, width), "leaders"), "h").where("x.root <> y.root").where(_may_link("x", "y", distance))
        met = met.groupBy(F.col("x.key").alias("x"), F.col("y.key").alias("y")).agg(F.count("*").alias("shared"))
        met = met.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
        if compared is not None:
            met = met.join(compared, ["a", "b"], "left_anti")
        # a text meets at most BANDS * width leaders
        order = F.struct((-F.col("shared")).alias("less"), F.xxhash64("x", "y").alias("tie"), "a", "b")
        best = met.groupBy("x").agg(F.slice(F.array_sort(F.collect_list(order)), 1, width).alias("best"))
        pairs = freeze(best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct(), "candidates")
        if pairs.isEmpty():
            break
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = verified(pairs, sets)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("doc_id", "mark", F.col("key").alias("root"))
    group = freeze(components(links).withColumnsRenamed({"node": "key", "component": "root"}), "groups")
    return rows.join(group, "key", "left").select("doc_id", "mark", F.coalesce("root", "key").alias("root"))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, exact: bool = True) -> DataFrame:
    """The rows of ``docs``, one of each group of like texts: by ``similar``, or without ``exact`` by leaders, which lose links."""
    return one_of_each(docs, (similar if exact else similar_by_leaders)(docs, id_col, text_col, shingle), id_col, text_col)
