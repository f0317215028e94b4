"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, language_id, lexical_search, mixing, passages, pii, prefix_trie, quality_rules, sentencepiece_bpe, simhash, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_passages": passages.op5_passages,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_sentencepiece": sentencepiece_bpe.op12_sentencepiece,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
