"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import bpe, centroids, conversations, licenses, mixing, near_dedup, personal, quality, secrets, substring_dedup, suffix_tree, topk, toxicity
from seriesmill.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    found = found.withColumn("matches", licenses.all_matches(F.col("matches"), F.col("notices")))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"]))), ",")
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["paragraph"], m["family"])), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["probability"])), F.lit(0.0))
    return found.select("doc_id", "n_paragraphs", F.size("matches").cast("long").alias("n_matches"), families.alias("families"), places.alias("matches"), best.alias("probability"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_spans_text(base), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda i: F.coalesce(F.crc32(i.cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: F.crc32(i.cast("string")) % 3 != 1)
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda i: F.crc32(i.cast("string")) % 7 == 2
    return suffix_tree.score(table(spark, sf_dir, "documents"), held_out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of the temperature mix of all documents, budgeted at the tokens there are."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "pass", "place", "weight")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(_spans_text(base), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_near_dedup": op2_near_dedup,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_mixing": op8_mixing,
    "op9_substring": op9_substring,
    "op10_bpe": op10_bpe,
    "op11_centroids": op11_centroids,
    "op12_personal": op12_personal,
    "op13_trie": op13_trie,
}
ORACLES: dict[str, str] = {
    "op5_topk": """
        WITH usable AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
    "op11_centroids": centroids.oracle(),
    "op13_trie": conversations.ORACLE,
}
