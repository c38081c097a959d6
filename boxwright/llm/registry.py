"""Queries of the operators: each applies one operator to its whole table and returns digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import attribution, bpe, collocations, compression, conversations, embeddings, mixing, pii, rules, sharding, simhash, suffix_tree, topk
from boxwright.llm.text import crc_of_id, table, word_count
from boxwright.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_mixing")
def op1(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(table(spark, d, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("at")))
    mixed = mixing.mix(rows, size=F.col("size"), order=F.col("at"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "positions")


@query("op2_pii")
def op2(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(table(spark, d, "documents").select("doc_id", "text"), keep=("doc_id",))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)], F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans")
    )


@query("op3_compression")
def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"))
    labels = table(spark, d, "labels").select("doc_id", "quality").where(crc_of_id(F.col("doc_id")) % 4 != 2)
    model = compression.fit(docs, labels)
    scored = compression.score_texts(docs, model)
    return scored.select("doc_id", "held_out", "score").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op4_suffix_tree")
def op4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", (crc_of_id(F.col("doc_id")) % 7 == 2).alias("held_out"))
    return suffix_tree.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op5_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k <= 10""")
def op5(spark: SparkSession, d: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op6_sharding")
def op6(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, d, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_token_counts")
def op7(spark: SparkSession, d: str) -> DataFrame:
    ranks = attribution.rank_file(spark, public_tokenizers.path(RANKS))
    counted = attribution.section_tokens(table(spark, d, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, "line", "first")
    return counted.select("doc_id", "n_tokens", F.posexplode_outer("sections").alias("section", "x")).select(
        "doc_id", "n_tokens", "section", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.tokens").cast("long").alias("tokens")
    )


@query("op8_byte_bpe")
def op8(spark: SparkSession, d: str) -> DataFrame:
    ranks = attribution.rank_file(spark, public_tokenizers.path(RANKS))
    coded = bpe.encode(table(spark, d, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_simhash")
def op9(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), keep=("doc_id",))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_quality_rules")
def op10(spark: SparkSession, d: str) -> DataFrame:
    stats = materialize(rules.text_statistics(table(spark, d, "documents").select("doc_id", "text")).drop("text"))
    learned = rules.fit_rules(stats, table(spark, d, "labels"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"), rules.kept(learned).alias("kept")
    )


@query("op11_collocations", """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM lists, unnest(range(1, 6)) t(m) WHERE len(w) >= m),
counts AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, max(c.f) AS cover FROM counts c, unnest(range(2, 5)) a(s), unnest(range(1, 5)) b(i)
  WHERE s < c.m AND i + s - 1 <= c.m GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, k, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM counts c JOIN totals USING (lang), unnest(range(1, 5)) t(k), counts l, counts r
  WHERE c.m > 1 AND k < c.m AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM cuts),
best AS (SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank FROM least x LEFT JOIN inner_ i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE first = 1 AND (cover IS NULL OR cover < a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best WHERE rank <= 2000""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents").select("lang", "text"))


@query("op12_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN degree ON degree.u = vec_id""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, d, "conversations").select("conv_id", "turn", "role", "text")))
