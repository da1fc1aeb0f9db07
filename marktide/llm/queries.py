"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import hard_negatives, mixing
from .common import table
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .license_scan import license_scan
from .packing import pack_documents
from .periodic_runs import run_digests
from .quality_rules import oracle_sql as quality_sql
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .token_files import token_round_trip
from .toxicity import toxicity


def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_html_extract(spark, sf_dir):
    return html_extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), copy_col="copy").select("doc_id", "source", "copy", "text")


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    return token_round_trip(table(spark, sf_dir, "documents"))


def op11_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_exact_dedup, op3_substring_dedup, op4_simhash, op5_html_extract, op6_mixing, op7_toxicity, op8_packing, op9_license_scan, op10_token_files, op11_token_counts, op12_hard_negatives, op13_periodic_runs)
}

ORACLE_SQL = {
    "op1_quality_rules": quality_sql(),
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op6_mixing": mixing.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
}
