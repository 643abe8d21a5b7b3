"""Samplers that depend on keys and seeds only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .budget import prefix_sum, row_index
from .dedup import first_by


def hash_order(seed: int, *keys: str) -> Column:
    """A stable shuffle key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by hash of the keys, on a grid of 1e6."""
    return (F.conv(F.substring(hash_order(seed, *keys), 1, 12), 16, 10).cast("long") % 1_000_000) / F.lit(1e6)


def shuffled_top(rows: DataFrame, seed: int, key: str, limit: int) -> DataFrame:
    """The first `limit` rows of a stable shuffle."""
    return rows.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(limit).drop("_h")


def linspace_rows(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """`count` rows spread evenly over the order, the first and the last among them."""
    total = rows.count()
    if total == 0 or count <= 0:
        return rows.limit(0)
    places = sorted({(i * (total - 1)) // max(1, count - 1) if count > 1 else 0 for i in range(count)})
    return row_index(rows, None, order, "_i").where(F.col("_i").isin(places)).drop("_i")


def stratified(rows: DataFrame, objective: str, difficulty: str, key: str, count: int, seed: int, positions: str | None = None) -> DataFrame:
    """Round robin over objectives and, inside one, over difficulties; `turn` is the order of the draw.

    Inside a stratum the order is a stable shuffle, with the values of `positions` interleaved where given.
    A count of 0, above the rows, or too small to reach every stratum is an error."""
    total = rows.count()
    if count <= 0 or count > total:
        raise ValueError("the count must be positive and within the rows")
    strata = rows.select(objective, difficulty).distinct().collect()  # a handful of task kinds
    objectives = sorted({r[0] for r in strata})
    most = max(sum(r[0] == o for r in strata) for o in objectives)
    if count < len(objectives) * most:
        raise ValueError(f"at least {len(objectives) * most} rows are needed")
    draw = rows.withColumn("_h", hash_order(seed, key))
    lane = [objective, difficulty] + ([positions] if positions else [])
    draw = draw.withColumn("_p", F.row_number().over(Window.partitionBy(*lane).orderBy("_h", key)))
    inner = ["_p", positions, "_h", key] if positions else ["_h", key]
    draw = draw.withColumn("_n", F.row_number().over(Window.partitionBy(objective, difficulty).orderBy(*inner)))
    # The n-th of every difficulty before the next of any; exhausted strata drop out of the turn.
    draw = draw.withColumn("_m", F.row_number().over(Window.partitionBy(objective).orderBy("_n", difficulty)))
    # A rank within its objective beyond the count is out of reach, so at most `count` rows an objective are ordered.
    reach = draw.where(F.col("_m") <= count).drop("_h", "_p", "_n")
    return row_index(reach, None, ["_m", objective], "turn").where(F.col("turn") < count).drop("_m")


def deck(rows: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """`draws` draws without replacement, a new shuffle whenever the deck is used up."""
    size = rows.count()
    if size == 0 or draws <= 0:
        return rows.limit(0).withColumn("epoch", F.lit(0)).withColumn("draw", F.lit(0).cast("long"))
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // size) - 1))))
    shuffled = epochs.withColumn("_h", hash_order(seed, "epoch", key))
    numbered = prefix_sum(shuffled, "epoch", ["_h", key], F.lit(1), "_i")
    return numbered.withColumn("draw", F.col("epoch").cast("long") * size + F.col("_i")).where(F.col("draw") < draws).drop("_h", "_i")


def mixture(draws: DataFrame, weights: dict[str, float], seed: int, *keys: str) -> DataFrame:
    """draws with `source`, chosen by weight from a hash of the keys."""
    total = sum(weights.values())
    if not weights or total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("invalid weights")
    u, edge, out = uniform(seed, *keys), 0.0, None
    for name in list(weights)[:-1]:
        edge += weights[name] / total
        out = F.when(u < round(edge, 9), name) if out is None else out.when(u < round(edge, 9), name)
    last = F.lit(list(weights)[-1])
    return draws.withColumn("source", out.otherwise(last) if out is not None else last)


def replacement(seed: int, size: Column, *keys: str) -> Column:
    """An index below `size` by hash of the keys: a draw with replacement."""
    return F.pmod(F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("long"), size)


def padded(tokens: Column, mask: Column, length: int, end: int = 0) -> tuple[Column, Column]:
    """Tokens and mask cut or filled to `length`, with the end id and 0."""
    fill = lambda c, x: F.slice(F.concat(c, F.array_repeat(F.lit(x), length)), 1, length)
    return fill(tokens, end), fill(mask, 0)


def curriculum_stage(progress: Column, stages: list[tuple[str, float]]) -> Column:
    """The first stage whose end lies beyond the progress; the last one at the end."""
    out = F.when(progress < stages[0][1], stages[0][0])
    for name, end in stages[1:]:
        out = out.when(progress < end, name)
    return out.otherwise(stages[-1][0])


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """rows with `advantage`, the reward less its group's mean; groups of equal rewards are left out."""
    stats = rows.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_mean"), F.min(reward).alias("_low"), F.max(reward).alias("_high")).where("_low < _high")
    joined = rows.join(stats, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_g", "_mean", "_low", "_high")


def prompt_pool(rows: DataFrame, seed: int, limit: int, least: int = 8) -> DataFrame:
    """Distinct chat prompts of `least` characters or more (from `prompt` or `q`), shuffled, at most `limit`."""
    text = F.trim(F.coalesce(F.when(F.col("prompt") != "", F.col("prompt")), F.col("q"), F.lit("")))
    kept = rows.withColumn("prompt", text).where((F.col("category") == "chat") & (F.length("prompt") >= least))
    keyed = kept.withColumn("_key", F.lower(F.regexp_replace("prompt", r"\s+", " ")))
    return shuffled_top(first_by(keyed, "_key", ["prompt_id"]).drop("_key"), seed, "prompt_id", limit)
