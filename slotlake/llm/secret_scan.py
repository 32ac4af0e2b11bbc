"""Secrets in whole texts, with multipart credentials linked by an interval join. DataFrame functions only.

Base spans are matches of three patterns. A credential often comes in parts, none of which says much
alone: an identifier, a secret, an endpoint. Weak candidates of each role are found by further patterns,
and one is reported only when parts of complementary roles stand within ``SCOPE`` characters of it in the
same text: an identifier or an endpoint near a secret, a secret near an identifier or an endpoint. The
interval join is a range window over the parts of a text in order of place, so the parts met are counted
and never paired. Base spans take part as identifiers (access) and secrets (assign, hex), and stay
whatever is near; a weak span that overlaps one is not reported again.

Places come from cutting the text at the matches: the pieces between and the matches add up.

A null text is an empty one. Every row is scanned by itself: repeated rows repeat, with or without id.
No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, keyed_text

SCOPE = 400
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "id", "key", "endpoint")

# fixed values: the base patterns. Runs of one class have no shorter match that would hold, so the
# least lengths of access and hex are part of their patterns; assign matches are judged after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "id": r"""(?i)\b(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""",
    "key": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z/+]*[0-9])(?=[0-9a-z/+]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""(?i)\b(https?|ftp|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""",
}
#: Characters of the value from which a span of an assign match is reported, and from which it is a weak key.
LEAST_VALUE, WEAK_VALUE = 8, 4
#: What a kind is a part of.
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}


def _lengths(text: Column, kind: str) -> Column:
    """For texts with a match: pieces before each match and matches, as lengths in code points; the value's for assign."""
    pattern = PATTERNS[kind]
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length) if kind == "assign" else found
    return F.when(F.regexp_like(text, F.lit(pattern)), F.arrays_zip(pieces.alias("gap"), found.alias("size"), value.alias("value")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id`` and for each kind the lengths of gaps and matches; one pass over the texts."""
    rows = keyed_text(docs, id_col, text_col)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[_lengths(F.col("text"), k).alias(k) for k in KINDS])


def parts(found: DataFrame) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end`` (code points) and ``base`` of every part of every text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in KINDS])
    each = (found.where(F.coalesce(*[F.size(k) for k in KINDS]) > 0)
            .select("row", F.explode(kinds).alias("k")).where("k.spans is not null")
            .select("row", "k.kind", F.posexplode("k.spans").alias("at", "s")))
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("s.gap") + F.coalesce("s.size", F.lit(0))).over(upto)
    placed = each.select("row", "kind", "s.size", "s.value", end.alias("end")).where("size is not null")
    weak = (F.col("kind") == "assign") & (F.col("value") < LEAST_VALUE)
    return (placed.where(~weak | (F.col("value") >= WEAK_VALUE))
            .select("row", F.when(weak, "key").otherwise(F.col("kind")).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")
            .withColumn("base", F.col("kind").isin(*BASE_KINDS)))


def linked(spans: DataFrame) -> DataFrame:
    """The base spans, and the weak ones that parts of complementary roles stand near."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    spans = spans.withColumn("role", role)
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    count = {r: F.sum((F.col("role") == r).cast("int")).over(near) for r in ("id", "secret", "endpoint")}
    fits = (F.when(F.col("role") == "secret", (count["id"] > 0) | (count["endpoint"] > 0)).otherwise(count["secret"] > 0))
    place = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    covered = (F.coalesce(before, F.lit(-1)) > F.col("start")) | F.coalesce(after < F.col("end"), F.lit(False))
    marked = spans.withColumns({"fits": fits, "covered": covered})
    return marked.where("base or (fits and not covered)").select("row", "kind", "start", "end", "base")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (start, order of the kind, end, kind,
    base) in order of start, then kind; empty where nothing was found."""
    found = freeze(matches(docs, id_col, text_col), "secret_matches")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = linked(parts(found)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string,base:boolean>>")
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
