"""Evaluation analytics over recorded rollouts and benchmark records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(rows: DataFrame, k: int) -> DataFrame:
    """Overall, by capability and by schema: tasks, pass@1, empirical pass@k, success, dynamic rate, entropy.

    rows: capability, schema_id, first_success (0/1), initial_successes, entropy; one row a task."""
    n = F.count("*")
    return rows.groupingSets([[], ["capability"], ["schema_id"]], "capability", "schema_id").agg(
        F.when(F.grouping("capability") == 0, "capability").when(F.grouping("schema_id") == 0, "schema").otherwise("overall").alias("level"),
        F.coalesce("capability", "schema_id", F.lit("all")).alias("name"),
        n.alias("tasks"),
        F.round(F.sum("first_success") / n, 9).alias("pass_1"),
        F.round(F.count_if(F.col("initial_successes") >= 1) / n, 9).alias("pass_k"),
        F.round(F.sum("initial_successes") / (n * k), 9).alias("success_rate"),
        F.round(F.count_if((F.col("initial_successes") > 0) & (F.col("initial_successes") < k)) / n, 9).alias("dynamic_rate"),
        F.round(F.avg("entropy"), 9).alias("mean_entropy"),
    ).select("level", "name", "tasks", "pass_1", "pass_k", "success_rate", "dynamic_rate", "mean_entropy")


def frontier_weights(rows: DataFrame) -> DataFrame:
    """Tasks solved sometimes (0 < successes < k), weighted p (1 - p), at least 0.02."""
    p = F.col("successes") / F.col("k")
    return rows.where((F.col("successes") > 0) & (F.col("successes") < F.col("k"))).withColumn("weight", F.round(F.greatest(F.lit(0.02), p * (1 - p)), 9))


def refine(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """New samples of tasks on top of a previous profile's, by position: (position, task_id, k, successes,
    initial_successes, first_success, entropy). Another task at a position is an error."""
    old = previous.select("position", *[F.col(c).alias(f"old_{c}") for c in ("task_id", "k", "successes", "initial_successes", "first_success", "entropy")])
    joined = rows.join(old, "position", "left")
    known = F.col("old_task_id").isNotNull()
    same = F.when(known & (F.col("old_task_id") != F.col("task_id")), F.raise_error(F.concat(F.lit("another task at position "), F.col("position").cast("string")))).otherwise(F.col("task_id"))
    k = F.col("k") + F.coalesce("old_k", F.lit(0))
    entropy = (F.col("entropy") * F.col("k") + F.coalesce(F.col("old_entropy") * F.col("old_k"), F.lit(0.0))) / k
    return joined.select(
        "position", same.alias("task_id"), k.alias("k"), (F.col("successes") + F.coalesce("old_successes", F.lit(0))).alias("successes"),
        F.coalesce("old_initial_successes", "initial_successes").alias("initial_successes"), F.coalesce("old_first_success", "first_success").alias("first_success"), F.round(entropy, 9).alias("entropy"),
    )


def bridge_schemas(schemas: DataFrame, rows: DataFrame) -> DataFrame:
    """Schemas without any success, with their least difficulty, 0.20 where none was tried."""
    solved = rows.where("successes > 0").select("capability", "schema_id").distinct()
    tried = rows.groupBy("capability", "schema_id").agg(F.min("difficulty").alias("difficulty"))
    open_ones = schemas.join(solved, ["capability", "schema_id"], "left_anti").join(tried, ["capability", "schema_id"], "left")
    return open_ones.select("capability", "schema_id", F.coalesce("difficulty", F.lit(0.20)).alias("difficulty"), F.lit(1.0).alias("weight"))


def focus(score: Column) -> Column:
    """How much a capability still needs: (1 - score) squared, at least 0.02."""
    return F.greatest(F.lit(0.02), F.pow(1 - score, F.lit(2.0)))


def gate(score: Column, peak: Column, drop: float) -> Column:
    """Whether a score holds its peak, less the allowed drop."""
    return score + 1e-12 >= F.greatest(F.lit(0.0), peak - drop)


def next_difficulty(rate: Column, difficulty: Column) -> Column:
    """0.05 harder above a rate of 0.72, easier under 0.08, within 0.05 .. 0.95."""
    return F.when(rate > 0.72, F.least(F.lit(0.95), difficulty + 0.05)).when(rate < 0.08, F.greatest(F.lit(0.05), difficulty - 0.05)).otherwise(difficulty)


def next_scale(rate: Column, base: Column, scale: Column) -> Column:
    """Half the old scale and half the observed over the base utility, the latter within 0.25 .. 4."""
    seen = F.greatest(F.lit(0.005), rate * (1 - rate))
    return 0.5 * scale + 0.5 * F.greatest(F.lit(0.25), F.least(F.lit(4.0), seen / F.greatest(F.lit(0.005), base)))


def replay_slot(step: Column, bridge: list[str], others: list[str]) -> Column:
    """Even steps take the bridge schemas in turn, odd ones the others."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(i, F.lit(len(names))) + 1).cast("int"))
    if not bridge:
        return pick(others, step)
    return F.when(step % 2 == 0, pick(bridge, F.floor(step / 2))).otherwise(pick(others, F.floor(step / 2)))


def leaderboard(records: DataFrame, categories: list[str]) -> DataFrame:
    """By model: correct and total, of each category and in all, and how many need a look.

    records: model, section, category, status (correct / incorrect / manual_review)."""
    ok = F.col("status") == "correct"
    columns = [F.count_if(ok & (F.col("category") == c)).alias(f"{c}_correct") for c in categories] + [F.count_if(F.col("category") == c).alias(f"{c}_total") for c in categories]
    return records.groupBy("model").agg(*columns, F.count_if(ok).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("status") == "manual_review").alias("manual_review"))


def adjudication_problems(records: DataFrame) -> DataFrame:
    """(problem, n): rows without a label and items labelled twice; both must be 0."""
    missing = records.where(F.col("manual_correct").isNull()).agg(F.lit("missing_label").alias("problem"), F.count("*").alias("n"))
    twice = records.groupBy("model", "section", "item_index").agg(F.count("*").alias("c")).where("c > 1").agg(F.lit("duplicate_item").alias("problem"), F.count("*").alias("n"))
    return missing.unionByName(twice)


def adjudication_totals(records: DataFrame) -> DataFrame:
    """Correct and total by model and section, and by model, section and category (rollup)."""
    own = records.rollup("model", "section", "category").agg(F.count_if("manual_correct").alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("depth"))
    return own.where("depth in (0, 1)").drop("depth")


def disagreements(records: DataFrame) -> DataFrame:
    return records.where(F.col("manual_correct") != F.col("auto_correct")).select("model", "section", "item_index", "auto_correct", "manual_correct")


def gates(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of checks over two one-row summaries: no loss of pass@1 and pass@k, more success, entropy kept."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in ("pass_1", "pass_k", "success_rate", "mean_entropy")])
    c = candidate.select("pass_1", "pass_k", "success_rate", "mean_entropy")
    checks = {
        "pass_1_kept": F.col("pass_1") >= F.col("b_pass_1"), "pass_k_kept": F.col("pass_k") >= F.col("b_pass_k"),
        "success_improves": F.col("success_rate") > F.col("b_success_rate"), "entropy_kept": F.col("mean_entropy") >= 0.65 * F.col("b_mean_entropy"),
    }
    rows = c.crossJoin(b).select(*[x.alias(n) for n, x in checks.items()])
    return rows.withColumn("passed", F.col("pass_1_kept") & F.col("pass_k_kept") & F.col("success_improves") & F.col("entropy_kept"))


def ood_gates(totals: DataFrame, reasoning_floor: int = 7, facts_floor: int = 5) -> DataFrame:
    """By model whether its adjudicated counts reach the floors."""
    by = totals.groupBy("model").agg(F.sum(F.when(F.col("section") == "reasoning", F.col("correct"))).alias("reasoning"), F.sum(F.when(F.col("section") == "facts", F.col("correct"))).alias("facts"))
    return by.select("model", (F.coalesce("reasoning", F.lit(0)) >= reasoning_floor).alias("reasoning_floor"), (F.coalesce("facts", F.lit(0)) >= facts_floor).alias("facts_floor"))


def majority(rows: DataFrame, group: str, target: str) -> DataFrame:
    """By group its most frequent target (the smallest on ties) and how often it hits."""
    counts = rows.groupBy(group, target).agg(F.count("*").alias("hits"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("hits"), target))
    return counts.withColumn("_r", best).where("_r = 1").drop("_r").withColumnRenamed(target, "answer")


def chance(objective: Column, operations: Column, orders: Column) -> Column:
    """The chance of a blind guess: valid orders over all, 1 in the steps, 1 in 1201 numbers."""
    factorials = F.array(*[F.lit(float(math.factorial(n))) for n in range(1, 13)])
    return F.when(objective == "order_steps", orders / F.element_at(factorials, operations)).when(objective == "find_error", 1.0 / operations).otherwise(F.lit(1 / 1201))


def chance_report(rows: DataFrame, group: str, k: int) -> DataFrame:
    """By group: tasks, the expected rate of blind guesses and their expected pass@k. rows: p, the chance."""
    return rows.groupBy(group).agg(F.count("*").alias("tasks"), F.round(F.avg("p"), 9).alias("expected_rate"), F.round(F.avg(1 - F.pow(1 - F.col("p"), F.lit(float(k)))), 9).alias("expected_pass_k"))


def eval_counters(rows: DataFrame) -> DataFrame:
    """Each task counted in all, by split, by objective and by objective and difficulty."""
    sets = [[], ["split"], ["objective"], ["objective", "difficulty"]]
    return rows.groupingSets(sets, "split", "objective", "difficulty").agg(F.count("*").alias("tasks"), F.sum("success").alias("successes"), F.grouping_id("split", "objective", "difficulty").alias("set"))
