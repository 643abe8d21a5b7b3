"""Deterministic splits by hash of a group, and leak checks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_bucket
from .budget import prefix_sum


def split_998(group: Column) -> Column:
    """train / val / sealed in 998 : 1 : 1 by group."""
    bucket = stable_bucket(group, 1000)
    return F.when(bucket == 0, "val").when(bucket == 1, "sealed").otherwise("train")


def split_98(group: Column) -> Column:
    """train / val / sealed in 98 : 1 : 1 by group."""
    bucket = stable_bucket(group, 100)
    return F.when(bucket == 0, "val").when(bucket == 1, "sealed").otherwise("train")


def split_share(key: Column, of: int, below: int, explicit: Column | None = None) -> Column:
    """val for buckets under `below` of `of`, unless the row names its split."""
    own = F.when(stable_bucket(key, of) < below, "val").otherwise("train")
    return F.coalesce(explicit, own) if explicit is not None else own


def split_with_floor(rows: DataFrame, order: list[str], tokens: Column, key: Column, floor: int = 32_768) -> DataFrame:
    """The first rows are val until they hold `floor` tokens; of the others one in 200 by hash."""
    before = prefix_sum(rows, None, order, tokens, "_before")
    return before.withColumn("split", F.when((F.col("_before") < floor) | (stable_bucket(key, 200) == 0), "val").otherwise("train")).drop("_before")


def grouped_split(pairs: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """Whole groups to val: a fifth of them, one at least and eight at most, in the order of a hash.
    Fewer than 10 rows or 5 groups are an error."""
    sizes = pairs.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups")).first()
    if sizes["rows"] < 10:
        raise ValueError("at least 10 distinct pairs are needed")
    if sizes["groups"] < 5:
        raise ValueError("at least 5 distinct prompts are needed")
    count = max(1, min(sizes["groups"] // 5, 8))
    picked = pairs.select(group).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256), group).limit(count)
    return pairs.join(F.broadcast(picked.withColumn("_val", F.lit(True))), group, "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def leaks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n): how many values of each key both sides hold; all must be 0."""
    counts = [left.select(F.col(k)).distinct().join(right.select(F.col(k)).distinct(), k).agg(F.count("*").alias("n")).select(F.lit(k).alias("key"), "n") for k in keys]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(missing, extra): keys of the left that the right lacks, and the other way round; both must be 0."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    missing = a.join(b, key, "left_anti").agg(F.count("*").alias("missing"))
    return missing.crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("extra")))


def index_in_epoch(index: Column, blocks: Column, seed: int) -> Column:
    """Affine permutation: block of the index-th draw, each block once an epoch. The stride is prime and over
    every block count, so it shares no factor; start and stride vary with the epoch."""
    epoch = F.floor(index / blocks)
    stride = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (stable_bucket(F.concat(F.lit(f"{seed}:s:"), epoch.cast("string")), len(PRIMES)) + 1).cast("int"))
    start = stable_bucket(F.concat(F.lit(f"{seed}:o:"), epoch.cast("string")), 1_000_003)
    return F.pmod(start + stride * F.pmod(index, blocks), blocks)


#: Primes over 2**31: no count of blocks below that shares a factor with them.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)


def row_number_by_hash(group: str, key: Column) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(key))
