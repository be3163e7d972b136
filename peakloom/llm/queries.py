"""The queries opN_<name> and the pipeline, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import (
    bpe, conversation_trie, decontamination, fill_middle, language, privacy, simhash, spans, suffixes, token_counts, topk, toxicity, weak_rules,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {
        "op1_decontamination": decontamination.op1,
        "op2_language": language.op2,
        "op3_suffix_dedup": suffixes.op3,
        "op4_token_counts": token_counts.op4,
        "op5_sentence_spans": spans.op5,
        "op6_privacy": privacy.op6,
        "op7_top_k": topk.op7,
        "op8_toxicity": toxicity.op8,
        "op9_simhash": simhash.op9,
        "op10_byte_bpe": bpe.op10,
        "op11_weak_rules": weak_rules.op11,
        "op12_conversation_trie": conversation_trie.op12,
        "op13_fill_middle": fill_middle.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"op5_sentence_spans": spans.OP5_SQL, "op7_top_k": topk.OP7_SQL, "op11_weak_rules": weak_rules.OP11_SQL, "op13_fill_middle": fill_middle.OP13_SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
