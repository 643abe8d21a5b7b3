"""First-wins deduplication in its variants: before or after rejection, by one key or two, with answer caps.

An order is a list of columns that settles every tie, so that results do not depend on partitioning.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; a local one where that is unset, which
    is an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    return f"{root.rstrip('/')}/corpusloom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: iterations restart from files that outlive executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation (no key's rows are gathered or sorted). Null keys each stay."""
    names = [c for c in rows.columns if c not in order]
    packed = F.struct(*order, *names)
    firsts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(packed, F.struct(*order)).alias("row"))
    return firsts.select("row.*").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def mark_duplicates(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `duplicate`: whether an earlier row has the same key (claims come before any rejection)."""
    least = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = rows.join(least, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("duplicate", F.coalesce(F.struct(*order) != F.col("_first"), F.lit(False))).drop("_key", "_first")


def dedup_after_reject(rows: DataFrame, key: str, order: list[str], reject: str = "reject") -> DataFrame:
    """Only rows without a reject code claim their key; the first of each stays."""
    return first_by(rows.where(F.col(reject).isNull()), key, order)


def two_key_dedup(rows: DataFrame, first_key: str, second_key: str, order: list[str]) -> DataFrame:
    """Keeps a row iff no earlier kept row shares either key; a refused row claims nothing.

    Rounds over the undecided rows: a row that is the first of both its keys is kept, and every undecided
    row that shares a key with a kept one is refused, until none is undecided. Each round decides the first
    undecided row of every group of rows linked by keys, so rounds are bounded by the longest chain."""
    place = F.struct(*order)
    undecided = written(rows.withColumn("_place", place))
    kept: DataFrame | None = None
    while not undecided.isEmpty():
        a = undecided.groupBy(F.col(first_key).alias("_a")).agg(F.min("_place").alias("_fa"))
        b = undecided.groupBy(F.col(second_key).alias("_b")).agg(F.min("_place").alias("_fb"))
        ranked = undecided.join(a, F.col(first_key).eqNullSafe(F.col("_a"))).join(b, F.col(second_key).eqNullSafe(F.col("_b")))
        ranked = written(ranked.drop("_a", "_b"))
        now = ranked.where((F.col("_place") == F.col("_fa")) & (F.col("_place") == F.col("_fb"))).drop("_fa", "_fb")
        kept = now if kept is None else kept.unionByName(now)
        left = undecided.join(now.select(F.col(first_key).alias("_a")).distinct(), F.col(first_key).eqNullSafe(F.col("_a")), "left_anti")
        left = left.join(now.select(F.col(second_key).alias("_b")).distinct(), F.col(second_key).eqNullSafe(F.col("_b")), "left_anti")
        undecided = written(left)
    return (kept if kept is not None else undecided).drop("_place")


def answer_cap(rows: DataFrame, prompt_key: str, source: str, answer_key: str, cap: int, order: list[str]) -> DataFrame:
    """Prompt dedup with at most `cap` uses of an answer in a source. A prompt's later rows are candidates
    only while its earlier ones were refused for the cap, so rounds alternate: the first undecided row of
    each prompt competes, and the first `cap` of each answer, counted with those kept before, are kept."""
    place = F.struct(*order)
    undecided = written(rows.withColumn("_place", place))
    kept: DataFrame | None = None
    while not undecided.isEmpty():
        heads = undecided.groupBy(F.col(prompt_key).alias("_p")).agg(F.min("_place").alias("_fp"))
        marked = undecided.join(heads, F.col(prompt_key).eqNullSafe(F.col("_p"))).withColumn("_head", F.col("_place") == F.col("_fp")).drop("_p", "_fp")
        used = (kept if kept is not None else undecided.limit(0)).groupBy(F.col(source).alias("_s"), F.col(answer_key).alias("_k")).agg(F.count("*").alias("_used"))
        # A head is certain once all rows before it in its answer's queue are heads or decided.
        queue = Window.partitionBy(source, answer_key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = marked.withColumn("_sure", F.min(F.col("_head").cast("int")).over(queue)).withColumn("_n", F.sum(F.col("_head").cast("int")).over(queue))
        counted = counted.join(used, F.col(source).eqNullSafe(F.col("_s")) & F.col(answer_key).eqNullSafe(F.col("_k")), "left").drop("_s", "_k")
        room = F.col("_n") + F.coalesce("_used", F.lit(0)) <= cap
        decided = written(counted.where(F.col("_head") & (F.col("_sure") == 1)).withColumn("_keep", room).drop("_head", "_sure", "_n", "_used"))
        now = decided.where("_keep").drop("_keep")
        kept = now if kept is None else kept.unionByName(now)
        rest = undecided.join(now.select(F.col(prompt_key).alias("_p")).distinct(), F.col(prompt_key).eqNullSafe(F.col("_p")), "left_anti")
        undecided = written(rest.join(decided.where(~F.col("_keep")).select("_place"), "_place", "left_anti").select(*undecided.columns))
    return (kept if kept is not None else undecided).drop("_place")


def resume(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows whose key an earlier output does not hold."""
    done = existing.select(F.col(key).alias("_done")).distinct()
    return rows.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def ordered_distinct(items: Column) -> Column:
    """The distinct items of an array, in order of first occurrence."""
    return F.array_distinct(items)
