"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (divergence, exact_dedup, langid, mixing, ngram_join, pieces, pii, periodic, projected_search,
                           resharding, suffix_dedup, topk, warc)
from tabwright.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d
"""


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.plan_mix(table(spark, folder, "documents"))
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


#: The layout that op3 starts from, and the shards that it fills.
OLD_SHARDS, NEW_SHARDS = 12, 16


def _text_size(row: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(f"{row}.text"), F.lit(""))) + 1).cast("long")


def _text_crc32(row: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"{row}.text"), F.lit("")))


@query
def op3_resharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(OLD_SHARDS)), F.lit(0))
    before, after = scratch_path(spark, "shards-old"), scratch_path(spark, "shards-new")
    resharding.write_layout(docs, old, before)
    rows, _ = resharding.reshard_layout(spark, before, docs.schema, _text_size, lambda row: [F.col(f"{row}.doc_id"), _text_crc32(row)],
                                        lambda total: resharding.even_capacities(total, NEW_SHARDS), after)
    return rows.select("row.doc_id", _text_size("row").alias("size"), _text_crc32("row").alias("text_crc32"), F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


#: A public SentencePiece model with byte fallback.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op5_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("original", F.col("text"))
    encoded = pieces.encode(docs, MODEL_FILE, carry=["doc_id", "original"])
    return pieces.decoded(encoded, MODEL_FILE).select(
        "doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("text").eqNullSafe(F.col("original")).alias("lossless"), "ids")


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_round_trip(spark, table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 takes 5 bits a letter, so 5 hexadecimal digits make 4 letters.
ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM g
"""


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    counts = [F.size(pii.of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


@query
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


ORACLES["op10_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.parts, c.parts)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.parts) = len(q.parts) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.looped(table(spark, folder, "documents")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda run: F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.expr("1000 * length div period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_projected_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return projected_search.nearest(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


ORACLES["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS kinds FROM kept GROUP BY lang),
own AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(l.kinds, 0) AS kinds
           FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON l.lang = g.lang LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
probs AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.total + g.kinds) AS p,
                 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.kinds) AS q
          FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
          LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM probs a JOIN probs b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
rated AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM probs WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rated)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
