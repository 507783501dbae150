"""The registered queries of this package and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import (
    alignment, chat, ctw, decontaminate, packing, periods, private, quality, simhash, suffix, tokens, urlfilter, warc,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        quality.op8_quality_rules,
        simhash.op6_simhash_near_dedup,
        decontaminate.op7_benchmark_decontamination,
        private.op4_pii,
        packing.op2_best_fit_packing,
        ctw.op5_lm_scoring,
        suffix.op1_suffix_array_dedup,
        urlfilter.op9_url_filters,
        warc.op10_warc,
        chat.op3_chat_formatting,
        tokens.op11_token_counts,
        periods.op12_periodic_runs,
        alignment.op13_cross_tokenizer_alignment,
    )
    return {f.__name__: f for f in found}


def statements() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat.ORACLE,
        "op7_benchmark_decontamination": decontaminate.ORACLE,
        "op9_url_filters": urlfilter.oracle(),
        "op10_warc": warc.ORACLE,
    }
