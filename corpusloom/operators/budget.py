"""Running budgets, rotations and windows over ordered rows.

Prefix sums are in two levels, so that one hot partition key is not one task: rows are range-partitioned by
(key, order), summed inside each range partition, and the totals of the ranges before are carried on. The
carried totals have one row a range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import written


def prefix_sum(rows: DataFrame, key: str | None, order: list[str], amount: Column, name: str = "before") -> DataFrame:
    """rows with the sum of `amount` over the rows of the same key that come before in `order`."""
    own = rows.withColumn("_key", F.col(key) if key else F.lit(0)).withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0).cast("long")))
    placed = written(own.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_key", "_part").agg(F.sum("_amount").alias("_total"))
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = summed.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_carried") + F.col("_inside")).alias(name))


def row_index(rows: DataFrame, key: str | None, order: list[str], name: str = "index") -> DataFrame:
    """rows numbered from 0 in each key."""
    return prefix_sum(rows, key, order, F.lit(1), name)


def take_budget(rows: DataFrame, key: str | None, order: list[str], amount: Column, budget: Column) -> DataFrame:
    """Rows until the amounts before reach the budget; the row that reaches it is the last, whole."""
    return prefix_sum(rows, key, order, amount, "_before").where(F.col("_before") < budget).drop("_before")


def rotated_budget(rows: DataFrame, key: str, order: list[str], amount: Column, budget: Column, rotation: int) -> DataFrame:
    """Whole rows from a rotated start, once each, until the budget; rows without amount are passed over."""
    counted = row_index(rows, key, order, "_i")
    sizes = rows.groupBy(F.col(key).alias("_n_key")).agg(F.count("*").alias("_n"))
    turned = counted.join(sizes, F.col(key).eqNullSafe(F.col("_n_key"))).withColumn("_turn", F.pmod(F.col("_i") - F.lit(rotation), F.col("_n"))).drop("_n_key")
    return take_budget(turned.where(amount > 0), key, ["_turn"], amount, budget).drop("_i", "_n", "_turn")


def repeat_to_quota(rows: DataFrame, key: str, order: list[str], amount: Column, quota: int) -> DataFrame:
    """Rows over as many passes as the quota needs, `taken` saying how much of the last one counts.

    The passes are a sequence of ceil(quota / amounts of a key)."""
    sums = rows.groupBy(F.col(key).alias("_k")).agg(F.sum(amount.cast("long")).alias("_sum")).where("_sum > 0")
    placed = prefix_sum(rows, key, order, amount, "_before").join(sums, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(quota) / F.col("_sum")).cast("int") - 1)))
    start = F.col("pass") * F.col("_sum") + F.col("_before")
    out = passes.withColumn("taken", F.least(amount.cast("long"), F.lit(quota) - start)).where(F.col("taken") > 0)
    return out.drop("_before", "_sum")


def circular_copy(rows: DataFrame, order: list[str], tokens: str, count: int, offset: int, end: int = 0) -> tuple[DataFrame, int]:
    """(rows of (pass, piece) that together hold exactly `count` tokens of the pool from `offset` around, the
    next offset); the last token is the end id."""
    size = rows.agg(F.sum(F.size(tokens).cast("long")).alias("n")).first()["n"] or 0
    if size == 0 or count <= 0:
        return rows.limit(0).select(*order, F.lit(0).alias("pass"), F.col(tokens).alias("piece")), offset
    first = offset % size
    laps = -(-(first + count) // size)
    placed = prefix_sum(rows, None, order, F.size(tokens), "_before").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
    start = F.col("pass") * F.lit(size) + F.col("_before")
    low, high = F.greatest(start, F.lit(first)), F.least(start + F.size(tokens), F.lit(first + count))
    cut = placed.withColumn("_low", low).withColumn("_high", high).withColumn("_start", start).where("_high > _low")
    piece = F.slice(tokens, (F.col("_low") - F.col("_start") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int"))
    closed = F.when(F.col("_high") == first + count, F.concat(F.slice(piece, 1, F.size(piece) - 1), F.array(F.lit(end)))).otherwise(piece)
    return cut.select(*order, "pass", closed.alias("piece")), (first + count) % size


def fixed_windows(tokens: Column, length: int) -> Column:
    """array<struct<offset, x, y>>: windows of `length` and the same moved on by one."""
    last = F.size(tokens) - length - 1
    offsets = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.slice(tokens, o + 1, length).alias("x"), F.slice(tokens, o + 2, length).alias("y")))


def segments(stream: DataFrame, key: str, position: str, token: str, end: int = 0) -> DataFrame:
    """(key, document, start, size) of the documents of a token stream, each closed by the end id."""
    numbered = prefix_sum(stream, key, [position], (F.col(token) == end).cast("int"), "document")
    return numbered.groupBy(key, "document").agg(F.min(position).alias("start"), F.count("*").alias("size"))
