"""Queries over sources as a recipe: apportionment, water-filling, repeats, weights, artifacts.

The recipe's sources are the documents' sources; their unique tokens are their characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, quotas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source: documents, unique tokens, a weight and an index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("unique_tokens"))
    return own.withColumn("idx", F.regexp_extract("source", r"\d+", 0).cast("int")).withColumn("weight", F.col("idx") % 5 + 1)


SOURCES = r"SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS unique_tokens, regexp_extract(source, '\d+')::INTEGER AS idx, regexp_extract(source, '\d+')::INTEGER % 5 + 1 AS weight FROM documents GROUP BY source"


@query(f"SELECT source, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, idx) <= 1000003 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM (SELECT source, idx, (1000003 * weight) // sum(weight) OVER () AS fl, (1000003 * weight) % sum(weight) OVER () AS rest FROM ({SOURCES}))")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 000 003 tokens over the sources by weight."""
    return quotas.apportion(sources(spark, sf_dir), 1_000_003, "weight", "idx").select("source", "target")


@query()
def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets under repeat caps; a plan on the driver over the recipe's few sources."""
    rows = sources(spark, sf_dir).orderBy("idx").collect()
    got = quotas.water_fill(2_000_000, {r["source"]: float(r["weight"]) for r in rows}, {r["source"]: r["unique_tokens"] for r in rows}, {r["source"]: 1 + r["idx"] % 2 for r in rows})
    return spark.createDataFrame(sorted(got.items()), "source string, target long")


@query()
def capability_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 000 tokens over all sources alike, each under its own tokens and a fifth of 3 000 000."""
    rows = sources(spark, sf_dir).orderBy("idx").collect()
    share = {r["source"]: 1 / max(1, len(rows)) for r in rows}
    got, short = quotas.allocate_capability(400_000, 3_000_000, share, {r["source"]: r["unique_tokens"] for r in rows}, dict.fromkeys(share, 1.0))
    return spark.createDataFrame([*sorted(got.items()), ("(shortfall)", short)], "source string, target long")


@query(f"SELECT source, asked::BIGINT AS asked, round(asked / unique_tokens, 6) AS repeats FROM (SELECT source, unique_tokens, 30000 * weight + 40000 * (idx % 3) AS asked FROM ({SOURCES})) WHERE asked / unique_tokens > 1.0")
def repeat_ceiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose two stages ask more than one pass of their tokens."""
    own = sources(spark, sf_dir)
    stages = own.select("source", (F.col("weight") * 30000).alias("tokens")).unionByName(own.select("source", (F.col("idx") % 3 * 40000).alias("tokens")))
    pool = own.select("source", "unique_tokens", F.lit(1.0).alias("max_repeat"))
    return quotas.repeat_violations(stages, pool).select("source", "asked", F.round("repeats", 6).alias("repeats"))


@query(f"SELECT source, ceil(100000 * weight / (idx % 3 + 1) * 1.03)::BIGINT AS target FROM ({SOURCES})")
def unique_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("source", quotas.unique_target(F.col("weight") * 100000, F.col("idx") % 3 + 1).alias("target"))


@query(f"SELECT source, round(0.05 * docs / unique_tokens, 9) AS weight FROM ({SOURCES})")
def token_sampling_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("source", F.round(quotas.token_sampling_weight(F.lit(0.05), F.col("docs"), F.col("unique_tokens")), 9).alias("weight"))


@query("SELECT source AS name, count(*) AS bytes, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS sha256 FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected artifacts against observed ones in which two sources are missing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("sha256"))
    return audits.artifact_violations(rows.where("name not in ('src1', 'src2')"), rows)
