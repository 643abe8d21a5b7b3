"""Restartable builds: each source's partition is built once, checked when it is found, and built anew if unfinished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _fs, exists

REPORT = "name string, target long, recipe string, rows long, digest long"


def table_digest(rows: DataFrame) -> tuple[int, int]:
    """(rows, digest) of a table; the digest does not depend on the order of its rows."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(rows.columns))), F.lit(0)).alias("d")).first()
    return found["n"], found["d"]


def build_source(spark: SparkSession, root: str, name: str, target: int, recipe: str, make: Callable[[], DataFrame]) -> dict:
    """The report of a source's partition below root. One with a report is reused after a check of its rows; another
    target or recipe (say, of another tokenizer) or changed rows are errors. One without is what an interrupted
    build left: it is deleted and made again. The report is written last."""
    folder = f"{root}/{name}"
    if exists(spark, f"{folder}/report"):
        report = spark.read.schema(REPORT).json(f"{folder}/report").first().asDict()
        if report["target"] != target:
            raise ValueError(f"{name} was built for another budget; choose another folder")
        if report["recipe"] != recipe:
            raise ValueError(f"{name} was built by another recipe")
        if (report["rows"], report["digest"]) != table_digest(spark.read.parquet(f"{folder}/rows")):
            raise ValueError(f"{name} was changed after it was built")
        return report
    fs, path = _fs(spark, folder)
    fs.delete(path, True)
    make().write.parquet(f"{folder}/rows")
    rows, digest = table_digest(spark.read.parquet(f"{folder}/rows"))
    report = {"name": name, "target": target, "recipe": recipe, "rows": rows, "digest": digest}
    spark.createDataFrame([tuple(report.values())], REPORT).coalesce(1).write.json(f"{folder}/report")
    return report


def reusable_pool(spark: SparkSession, path: str, tokens: str, split: str, target: int) -> DataFrame | None:
    """The pool at path, if its training rows hold the target's tokens and it has validation rows; else None."""
    if not exists(spark, path):
        return None
    pool = spark.read.parquet(path)
    held = pool.agg(F.coalesce(F.sum(F.when(F.col(split) == "train", F.col(tokens))), F.lit(0)).alias("train"), F.coalesce(F.sum(F.when(F.col(split) == "val", F.col(tokens))), F.lit(0)).alias("val")).first()
    return pool if held["train"] >= target and held["val"] > 0 else None
