"""One query per corpus operator, over its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.llm import (
    byte_bpe, embedding_dedup, exact_dedup, mixture, phrases, pii, secret_scan, sentence_pieces, simhash,
    spelling, substring_dedup, token_shards, toxicity,
)
from slotlake.llm.common import hex_of, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(documents(spark, sf_dir))


ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.draw(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_shards")
    token_shards.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    texts = token_shards.read(spark, path)
    return texts.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


def _spans(spans: str = "spans"):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    found = found.withColumn("based", F.filter("spans", lambda s: s["base"]))
    of = lambda kind: F.size(F.filter("based", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(_spans("based"), 256).alias("base_sha256"), _spans().alias("spans"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(toxicity.training_set(docs, labels.where(~held_out)))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("removed")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_report(secret_scan.scan(documents(spark, sf_dir)), secret_scan.BASE_KINDS)


@query
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _span_report(pii.find(docs, pii.fit(docs)), pii.BASE_KINDS)


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.decode(sentence_pieces.encode(documents(spark, sf_dir), model), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), sentence_pieces.covered(F.col("bounds")).alias("covered_bytes"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir), noise=199))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


ORACLES["op13_phrases"] = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
          FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(words)),
counts AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n,
           (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:], ' ')
    JOIN totals t ON t.lang = c.lang),
best AS (
    SELECT * FROM cuts c WHERE NOT EXISTS (
        SELECT 1 FROM counts b WHERE b.lang = c.lang AND b.size > len(string_split(c.phrase, ' '))
        AND 100 * b.f >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER same AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best WINDOW same AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY rank <= 2000
"""
