"""The queries of this package, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiga.llm import hard_negatives, html_text, language, mixing, neighbours, ngram_join, packing, prefix_trie, pu_quality, rules, secret_links, sharding, sql, url_templates
from cantiga.llm.common import remainder, table, word_count

SHARD_BYTES = 1 << 20
QUALITY_SCORE = 0.7
MIX_WEIGHTS = [1.0, 2.0, 3.0]
URL_RULES = [
    url_templates.Rule("com", "/", "allow"),
    url_templates.Rule("example.com", "/en/", "block"),
    url_templates.Rule("www.example.com", "/en/", "allow"),
    url_templates.Rule("net", "/es/", "block"),
    url_templates.Rule("net", "/fr/", "block"),
]


def op1_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return sharding.extendible_shards(documents, F.col("doc_id"), F.octet_length("text"), SHARD_BYTES, ["doc_id"]).rows


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    index = neighbours.build_index(vectors)
    if index is None:
        return neighbours.no_neighbours(vectors)
    return neighbours.search(index, vectors.where(F.col("vec_id") % 20 == 0))


def op4_similar_texts(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"), keep=["page_id", "url"])


def op6_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"), word_count(F.col("text")), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_languages(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), remainder(F.col("doc_id"), 5) == 0
    trees = language.learn(documents.where(~held_out))
    found = language.identify(documents, trees)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    judged = url_templates.judge_urls(pages.select(F.col("page_id").alias("id"), "url"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")), URL_RULES)
    return judged.withColumnRenamed("id", "page_id")


def op10_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, folder, "labels").where(~held_out)
    scored, _ = pu_quality.score_quality(table(spark, folder, "documents"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_SCORE).cast("int").alias("predicted"))


def op11_linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_links.digests(secret_links.find_credentials(table(spark, folder, "documents")))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return prefix_trie.build_trie(prefix_trie.rebuilt_from_heads(turns))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    seventh = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extendible_shards, op2_quality_rules, op3_nearest_vectors, op4_similar_texts, op5_main_text, op6_packed_sequences, op7_mixed_sources, op8_languages, op9_url_verdicts,
        op10_quality_scores, op11_linked_secrets, op12_conversation_trie, op13_hard_negatives,
    )
}
#: The others learn, draw, tokenize or search step by step, which SQL does not express; their tests hold brute force against them.
ORACLE: dict[str, str] = {
    "op1_extendible_shards": sql.shards_sql(SHARD_BYTES),
    "op9_url_verdicts": sql.urls_sql(URL_RULES, url_templates.TreeSettings()),
    "op11_linked_secrets": secret_links.digests_sql(),
    "op12_conversation_trie": prefix_trie.TRIE_SQL,
    "op13_hard_negatives": hard_negatives.NEGATIVES_SQL,
}
