"""Exact ranks and quantiles that never put one column, group or key into one task.

Spark's own exact percentile keeps every distinct value of a column in one buffer, and a
window without partitions, or one by a frequent label, sorts in one task. The operators here
give the same numbers from bounded pieces:

* ``order_statistics`` narrows a value range with mergeable sketches, proves by counting that
  the wanted rank lies inside it, and sorts only what is left;
* ``rank_in_group`` ranks inside small hash ranges and adds the sizes of the ranges before;
* ``sorted_codes`` numbers distinct text labels, dealt by range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlake.session import freeze

SETTLE_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """Closed value range that is known to hold the ranks ``first`` to ``last``."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int      # values < low
    at_low: int     # values = low
    inside: int     # low < values < high
    at_high: int    # values = high
    margin: float = 2.0

    def value_at(self, rank: int):
        if self.low == self.high or rank < self.below + self.at_low:
            return self.low
        if rank >= self.below + self.at_low + self.inside:
            return self.high
        return None

    @property
    def known(self) -> bool:
        return self.value_at(self.first) is not None and self.value_at(self.last) is not None


def _ends(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple]:
    """Count, minimum and maximum of the non-null values of each column, in one pass."""
    aggregates = []
    for name, column in columns.items():
        aggregates += [F.count(column).alias(f"n:{name}"), F.min(column).alias(f"lo:{name}"),
                       F.max(column).alias(f"hi:{name}")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"n:{c}"], row[f"lo:{c}"], row[f"hi:{c}"]) for c in columns}


def _count_parts(df: DataFrame, columns: Mapping[str, Column], brackets: Sequence[_Bracket]):
    """Exact position of each bracket in its column, all brackets in one pass."""
    aggregates = []
    for i, b in enumerate(brackets):
        c = columns[b.column]
        aggregates += [
            F.count_if(c < F.lit(b.low)).alias(f"below{i}"),
            F.count_if(c == F.lit(b.low)).alias(f"low{i}"),
            F.count_if((c > F.lit(b.low)) & (c < F.lit(b.high))).alias(f"inside{i}"),
            F.count_if((c == F.lit(b.high)) & (c > F.lit(b.low))).alias(f"high{i}"),
        ]
    row = df.agg(*aggregates).first()
    for i, b in enumerate(brackets):
        b.below, b.at_low = row[f"below{i}"], row[f"low{i}"]
        b.inside, b.at_high = row[f"inside{i}"], row[f"high{i}"]


def _sketch(df: DataFrame, columns: Mapping[str, Column], brackets: Sequence[_Bracket],
            accuracy: int) -> list[_Bracket]:
    """Narrower candidates for each bracket from one pass of approximate percentiles.

    Brackets over the same value range share one sketch.
    """
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.column, b.low, b.high), []).append(b)
    aggregates, reach = [], {}
    for i, ((name, low, high), members) in enumerate(shared.items()):
        c = columns[name]
        inner = F.when((c > F.lit(low)) & (c < F.lit(high)), c)
        asked: list[float] = []
        for b in members:
            start = b.below + b.at_low
            lower = (b.first - start) / b.inside - b.margin / accuracy
            upper = (b.last + 1 - start) / b.inside + b.margin / accuracy
            reach[id(b)] = (i, len(asked), lower <= 0.0, upper >= 1.0)
            asked += [min(max(lower, 0.0), 1.0), min(max(upper, 0.0), 1.0)]
        aggregates += [F.min(inner).alias(f"min{i}"), F.max(inner).alias(f"max{i}"),
                       F.percentile_approx(inner, asked, accuracy).alias(f"q{i}")]
    row = df.agg(*aggregates).first()
    out = []
    for b in brackets:
        i, at, from_start, to_end = reach[id(b)]
        low = row[f"min{i}"] if from_start else row[f"q{i}"][at]
        high = row[f"max{i}"] if to_end else row[f"q{i}"][at + 1]
        if b.first < b.below + b.at_low:
            low = b.low
        if b.last >= b.below + b.at_low + b.inside:
            high = b.high
        out.append(_Bracket(b.column, b.first, b.last, low, high, 0, 0, 0, 0, b.margin))
    return out


def _settle(df: DataFrame, columns: Mapping[str, Column], brackets: Sequence[_Bracket]) -> list[tuple]:
    """Read the ranks off the sorted distinct values of brackets that are known to be small.

    Ranks that share a value range share its rows, so a column enters once however many of its
    quantiles are asked for.
    """
    ranges = list(dict.fromkeys((b.column, b.low, b.high) for b in brackets))
    entries = [
        F.when(columns[c].between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("id"), columns[c].alias("v")))
        for i, (c, low, high) in enumerate(ranges)
    ]
    ranked = (
        df.select(F.explode(F.array(*entries)).alias("e")).filter("e is not null")
        .groupBy("e.id", "e.v").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(
            Window.partitionBy("id").orderBy("v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    wanted = []
    for i, b in enumerate(brackets):
        mine = F.col("id") == ranges.index((b.column, b.low, b.high))
        for name, rank in (("first", b.first), ("last", b.last)):
            wanted.append(F.min(F.when(mine & (F.col("upto") > rank - b.below), F.col("v"))).alias(f"{name}{i}"))
    row = ranked.agg(*wanted).first()
    return [(row[f"first{i}"], row[f"last{i}"]) for i in range(len(brackets))]


def order_statistics(df: DataFrame, columns: Mapping[str, Column],
                     pairs: Mapping[str, Sequence[tuple[int, int]]],
                     ends: Mapping[str, tuple] | None = None,
                     settle_rows: int = SETTLE_ROWS,
                     accuracy: int = SKETCH_ACCURACY) -> dict[str, list[tuple]]:
    """Values at the 0-based rank pairs ``(k, k or k + 1)`` of each column, exactly.

    Only a handful of numbers per pair reaches the driver. A round cuts the undecided rows to
    about ``4 / accuracy`` of them, so even 10^12 rows settle in two rounds; values that fill
    a large share of the rows end up as the edge of a bracket, where counting decides.
    """
    ends = ends if ends is not None else _ends(df, columns)
    order, brackets = [], []
    for name, wanted in pairs.items():
        n, low, high = ends[name]
        for first, last in wanted:
            order.append((name, len(brackets)))
            # edges count as inside until a pass has told them apart
            brackets.append(_Bracket(name, first, last, low, high, 0, 0, n, 0))

    while True:
        wide = [i for i, b in enumerate(brackets) if not b.known and b.inside > settle_rows]
        if not wide:
            break
        unseen = [brackets[i] for i in wide if brackets[i].at_low == 0]
        if unseen:
            _count_parts(df, columns, unseen)
            continue
        candidates = _sketch(df, columns, [brackets[i] for i in wide], accuracy)
        _count_parts(df, columns, candidates)
        for i, new in zip(wide, candidates):
            holds = (new.below <= new.first
                     and new.last < new.below + new.at_low + new.inside + new.at_high)
            if holds:
                brackets[i] = new
            else:
                brackets[i].margin *= 4

    open_ids = [i for i, b in enumerate(brackets) if not b.known]
    settled = _settle(df, columns, [brackets[i] for i in open_ids]) if open_ids else []
    values = {i: (b.value_at(b.first), b.value_at(b.last)) for i, b in enumerate(brackets) if b.known}
    values.update({i: settled[j] for j, i in enumerate(open_ids)})
    out: dict[str, list[tuple]] = {name: [] for name in pairs}
    for name, i in order:
        out[name].append(values[i])
    return out


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
              probabilities: Sequence[float], **options) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, nulls left out."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    ends = _ends(df, columns)
    pairs, spots = {}, {}
    for name, (n, _, _) in ends.items():
        if n == 0:
            continue
        spots[name] = [p * (n - 1) for p in probabilities]
        pairs[name] = [(int(s), min(int(s) + 1, n - 1)) for s in spots[name]]
    found = order_statistics(df, columns, pairs, ends, **options) if pairs else {}
    out: dict[str, list[float | None]] = {}
    for name in columns:
        if name not in found:
            out[name] = [None] * len(probabilities)
            continue
        out[name] = [
            float(low) + (float(high) - float(low)) * (spot - int(spot))
            for spot, (low, high) in zip(spots[name], found[name])
        ]
    return out


def rank_in_group(df: DataFrame, group: Sequence[str], key: str, rank: str = "rank",
                  digits: int = 3) -> DataFrame:
    """0-based rank of each row inside its group, ordered by the md5 of a unique key.

    A group is cut into ``16 ** digits`` ranges of that hash. Ranking happens inside one range,
    so a group with a third of all rows still spreads over thousands of tasks.
    """
    hashed = df.withColumns({"_hash": F.md5(F.col(key).cast("string"))})
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, digits))
    part = [*group, "_range"]
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one number per group and range; written out, so that its true size decides the join
    offsets = freeze(
        hashed.groupBy(*part).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(part)], "_offset"),
        "rank-offsets")
    inner = Window.partitionBy(*part).orderBy("_hash", key)
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(part)]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    return (
        hashed.withColumn("_row", F.row_number().over(inner) - 1)
        .join(offsets, condition)
        .withColumn(rank, F.col("_row") + F.col("_offset"))
        .drop("_hash", "_range", "_row", "_offset", *[f"_o{i}" for i in range(len(part))])
    )


def sorted_codes(labels: DataFrame, pieces: int | None = None) -> DataFrame:
    """Add ``code``: the 0-based place of ``label`` among the sorted labels of its ``column``.

    ``labels`` holds distinct ``(column, label)`` rows. They are dealt by range and written once, each with its
    partition as its piece; places inside a piece and the sizes of the pieces before it give the code. The driver sees no
    label. The number of pieces is that of shuffle partitions unless given.
    """
    dealt = labels.repartitionByRange(pieces, "column", "label") if pieces else labels.repartitionByRange("column", "label")
    by_range = dealt.withColumn("_piece", F.spark_partition_id())
    placed = freeze(by_range, "label-pieces")
    earlier = Window.partitionBy("column").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # one number per column and piece; written out, so that its true size decides the join
    offsets = freeze(
        placed.groupBy("column", "_piece").agg(F.count("*").alias("_n"))
        .select("column", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")), "label-offsets")
    inside = Window.partitionBy("column", "_piece").orderBy("label")
    return placed.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["column", "_piece"]).select(
        *labels.columns, (F.col("_row") + F.col("_offset")).cast("int").alias("code"))
