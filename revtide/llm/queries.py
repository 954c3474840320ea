"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revtide.llm import bpe, collocations, contamination, html, jaccard, mixing, quality, rules, secrets, substrings, surrogates, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        secrets.op1_secret_scan,
        quality.op2_quality_classifier,
        bpe.op3_bpe,
        urls.op4_url_filter,
        contamination.op5_decontamination,
        rules.op6_quality_rules,
        surrogates.op9_pii_surrogates,
        substrings.op7_substring_dedup,
        jaccard.op8_jaccard_join,
        html.op10_html_main_text,
        mixing.op11_source_mix,
        trie.op12_prefix_trie,
        collocations.op13_collocations,
    )
}
