"""The training-data pipeline: language, near-duplicates, benchmark leaks, domain mixture, token store.

Defined results: documents without a letter go in the first stage; documents with a null doc_id stay, and one without
an id is a class of its own or goes with its copies; rows that share a doc_id stay or go together, equal rows stay once;
further columns come through unchanged, whatever their names; an empty corpus gives an empty store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language, mixing, near_dedup, token_store
from corpusloom.llm.catalog import tokenizer_path
from corpusloom.llm.common import aside, back, ensure_session, materialize, table

#: Shares of the tokens that the mixture is to have; domains are those of the label table.
MIXTURE = {"quality1-toxic0": 0.86, "quality0-toxic0": 0.08, "quality1-toxic1": 0.05, "quality0-toxic1": 0.01}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; a missing lang becomes the identified one."""
    ensure_session(spark)
    model = language.learn(docs.where(~language.held_out_column()))
    rows, names = aside(docs, "doc_id", "text", "lang")
    found = language.identify(rows, model).where(F.col("lang_pred") != language.UNKNOWN)
    return back(found.withColumn("lang", F.coalesce("lang", "lang_pred")), names, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ensure_session(spark)
    return near_dedup.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    rows, names = aside(docs, "doc_id", "text")
    rated = mixing.mixed(rows, table(spark, sf_dir, "labels"), MIXTURE, keep=True)
    return back(mixing.apply_rates(rated, names), names, docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' content-addressed token store, read back and verified."""
    ensure_session(spark)
    path = tokenizer_path()
    return token_store.verify_store(token_store.build_store(docs, path), path)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_store", token_stage),
]

#: No stage but the decontamination is expressible in SQL; the run is tested against plain Python stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
