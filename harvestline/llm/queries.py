"""The registered queries of the numbered operators, and their reference SQL."""

from __future__ import annotations

from harvestline.llm import divergence, language, mixing, neighbour_graph, neighbours, packing, prefix_trie, quality, reference_sql, sampling, secrets, simhash, substrings, toxicity
from harvestline.llm.common import documents


def _labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_language(spark, folder):
    return language.score(documents(spark, folder))


def op2_best_fit_packing(spark, folder):
    return packing.pack(documents(spark, folder))


def op3_top_k(spark, folder):
    return neighbours.top_k(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


def op4_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder))


def op5_toxicity(spark, folder):
    return toxicity.classify(documents(spark, folder), _labels(spark, folder))


def op6_fingerprints(spark, folder):
    return sampling.neighbours(documents(spark, folder))


def op7_secrets(spark, folder):
    return secrets.found_secrets(documents(spark, folder))


def op8_quality(spark, folder):
    return quality.classify(documents(spark, folder), _labels(spark, folder))


def op9_mixing(spark, folder):
    return mixing.mix(documents(spark, folder, "doc_id", "text", "source"))


def op10_substrings(spark, folder):
    return substrings.dedup(documents(spark, folder))


def op11_neighbour_graph(spark, folder):
    return neighbour_graph.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


def op12_divergence(spark, folder):
    return divergence.audit(documents(spark, folder, "text", "lang", "source"))


def op13_prefix_trie(spark, folder):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(reference_sql.SQL)
