"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, decontaminate, html_render, language, mixing, near_dedup, secret_scan, suffix_dedup, token_store, tool_calls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A public vocabulary's file; any file of the tokenizers library serves.
TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as mu-law media in the shared folder, read back, expanded, decoded and resampled."""
    return audio.media_features(audio.store_texts(table(spark, sf_dir, "documents")))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids in a content-addressed store, read back and verified."""
    path = tokenizer_path()
    return token_store.verify_store(token_store.build_store(table(spark, sf_dir, "documents"), path), path)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language by cross-parsing entropy."""
    return language.identify_documents(table(spark, sf_dir, "documents"))


QUERIES["op1_telephony"] = op1_telephony
QUERIES["op2_token_store"] = op2_token_store
QUERIES["op3_language"] = op3_language


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scanned for the benchmark's 10-word windows."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op9_decontaminate"] = op9_decontaminate
ORACLES["op9_decontaminate"] = decontaminate.ORACLE


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 50-byte strings that an earlier document holds."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES["op5_suffix_dedup"] = op5_suffix_dedup


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's class of near-duplicates at 0.8 over five-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op6_near_dedup"] = op6_near_dedup


def op4_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text, laid out."""
    return html_render.render_pages(table(spark, sf_dir, "pages"))


QUERIES["op4_html_render"] = op4_html_render


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every text with the forest's verdict."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), words=secret_scan.vocabulary_words(tokenizer_path()))


QUERIES["op7_secret_scan"] = op7_secret_scan


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's calls and results, linked, ordered, checked and serialised."""
    return tool_calls.link_conversations(table(spark, sf_dir, "conversations"))


QUERIES["op8_tool_calls"] = op8_tool_calls


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors and the rate that mixes the domains to their targets."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op10_mixing"] = op10_mixing
