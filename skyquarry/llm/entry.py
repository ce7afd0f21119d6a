"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from skyquarry.llm import bpe, chaining, chat, classifier, line_runs, negatives, packing, quality_rules, repair, setsketch, spotsigs, suffix_dedup, url_filter


def _urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.fixed_rules(spark))


def queries():
    return {
        "op1_packing": packing.query,
        "op2_chat_formatting": chat.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_spotsigs": spotsigs.query,
        "op5_quality_rules": quality_rules.query,
        "op6_bpe": bpe.query,
        "op7_chaining": chaining.query,
        "op8_quality_classifier": classifier.query,
        "op9_setsketch": setsketch.query,
        "op10_url_filters": _urls,
        "op11_repair": repair.query,
        "op12_hard_negatives": negatives.query,
        "op13_line_dedup": line_runs.query,
        "spotsigs_classes": spotsigs.similar,
    }


def oracle_sql():
    return {
        "op2_chat_formatting": chat.ORACLE,
        "op3_suffix_dedup": suffix_dedup.ORACLE,
        "op9_setsketch": setsketch.ORACLE,
        "op10_url_filters": url_filter.ORACLE,
        "op11_repair": repair.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
        "op13_line_dedup": line_runs.ORACLE,
    }
