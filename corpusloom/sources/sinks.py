"""Writers: JSONL with a budget, binary token shards, atomic publication, manifests, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import take_budget


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; by default an existing destination is an error."""
    rows.write.mode(mode).json(path)


def write_jsonl_budget(rows: DataFrame, path: str, order: list[str], amount: Column, budget: int) -> None:
    """Rows in order until their amounts reach the budget, the last one whole."""
    write_jsonl(take_budget(rows, None, order, amount, F.lit(budget)), path)


def publish(rows: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """All or nothing: written beside the destination, then renamed onto it. A table that is replaced is set aside
    first and removed last, so that a failure in between leaves it whole, under its name or beside it."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    mark = uuid.uuid4().hex
    stage, aside = (_fs(spark, f"{path}.{kind}-{mark}")[1] for kind in ("stage", "aside"))
    try:
        rows.write.format(fmt).save(stage.toString())
        replaced = fs.exists(target)
        if replaced and not fs.rename(target, aside):
            raise OSError(f"could not set {path} aside")
        if not fs.rename(stage, target):
            if replaced:
                fs.rename(aside, target)
            raise OSError(f"could not publish {path}")
        fs.delete(aside, True)
    finally:
        fs.delete(stage, True)


def ordered_shards(shards: list[tuple[str, DataFrame]], order: str) -> DataFrame:
    """Shards one behind the other, in the order of the list: (source_ord, order, ...)."""
    out = None
    for k, (name, rows) in enumerate(shards):
        own = rows.withColumn("source", F.lit(name)).withColumn("source_ord", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy("source_ord", order)


def manifest(rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """By keys: rows, characters and a digest of the rows' digests that does not depend on their order."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("sha256"))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_token_shards(rows: DataFrame, path: str, tokens: str, mask: str | None = None, order: str = "doc_id") -> DataFrame:
    """Token shards as rows (part, ids, mask): little-endian 16-bit ids and 0/1 bytes, documents in order, one
    shard for each range of the order; written as Parquet and returned as read back."""
    import numpy as np
    import pandas as pd

    ranged = rows.select(F.col(order).alias("o"), F.col(tokens).alias("t"), (F.col(mask) if mask else F.lit(None).cast("array<int>")).alias("m")).repartitionByRange("o").sortWithinPartitions("o").withColumn("part", F.spark_partition_id())

    def run(batches):
        part, ids, bits, first = None, [], [], None
        for batch in batches:
            for o, t, m, p in zip(batch["o"], batch["t"], batch["m"], batch["part"]):
                part, first = p, o if first is None else first
                ids.append(np.asarray(t, "<u2").tobytes())
                bits.append(b"" if m is None else np.asarray(m, np.uint8).tobytes())
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "ids": [b"".join(ids)], "mask": [b"".join(bits)]})

    ranged.mapInPandas(run, "part int, first long, ids binary, mask binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def leaderboard_markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a few rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"
