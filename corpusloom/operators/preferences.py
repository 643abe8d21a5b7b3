"""Preference pairs from two judges: validation, agreement, margins, blind packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order


def judgment_problem(ranking: Column, scores: Column, unsafe: Column, ids: Column) -> Column:
    """Why a judgment is invalid; null if it is valid. scores: map of id to 0..4."""
    at = lambda x: F.try_element_at(scores, x)
    pairs = F.sequence(F.lit(1), F.greatest(F.size(ranking) - 1, F.lit(1)))
    falling = F.forall(pairs, lambda i: (F.size(ranking) < 2) | (at(F.try_element_at(ranking, i)) >= at(F.try_element_at(ranking, i + 1))))
    return (
        F.when((F.array_sort(ranking) != F.array_sort(ids)) | ranking.isNull(), "ranking")
        .when((F.array_sort(F.map_keys(scores)) != F.array_sort(ids)) | ~F.forall(F.map_values(scores), lambda s: s.between(0, 4)), "scores")
        .when(~falling, "incoherent")
        .when(F.size(F.array_except(F.coalesce(unsafe, F.array().cast("array<string>")), ids)) > 0, "unsafe_unknown")
    )


def coverage_problems(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """(missing, unknown, duplicate): prompts without judgment, judgments without prompt, prompts judged twice."""
    prompts, seen = candidates.select("prompt_id").distinct(), judged.select("prompt_id")
    missing = prompts.join(seen, "prompt_id", "left_anti").agg(F.count("*").alias("missing"))
    unknown = seen.join(prompts, "prompt_id", "left_anti").agg(F.count("*").alias("unknown"))
    twice = seen.groupBy("prompt_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate"))
    return missing.crossJoin(unknown).crossJoin(twice)


def preference_pairs(candidates: DataFrame, judge_a: DataFrame, judge_b: DataFrame, min_margin: int = 1, most: int = 2) -> DataFrame:
    """One row a pair, or one a prompt without any, with its `reason`.

    candidates: prompt_id, candidates array<struct<candidate_id, text, stopped, repeat_ratio>>; judges: prompt_id,
    ranking, scores, unsafe. Both judges' first choices must agree, be safe, finished and not empty; losers are
    taken by least total score, then by last total rank, with a margin in both judges, two at most."""
    names = ("ranking", "scores", "unsafe")
    a = judge_a.select("prompt_id", *[F.col(c).alias(f"{c}_a") for c in names])
    b = judge_b.select("prompt_id", *[F.col(c).alias(f"{c}_b") for c in names])
    j = candidates.join(a, "prompt_id").join(b, "prompt_id").withColumn("top", F.try_element_at("ranking_a", F.lit(1)))
    none = F.array().cast("array<string>")
    bad = F.concat(F.coalesce("unsafe_a", none), F.coalesce("unsafe_b", none))
    j = j.withColumn("chosen", F.try_element_at(F.filter("candidates", lambda c: c["candidate_id"] == F.col("top")), F.lit(1)))
    invalid = F.array_contains(bad, F.col("top")) | ~F.col("chosen.stopped") | (F.col("chosen.text") == "")
    j = j.withColumn("reason", F.when(F.col("top") != F.try_element_at("ranking_b", F.lit(1)), "judge_top_disagreement").when(invalid, "chosen_invalid"))

    def weigh(c: Column) -> Column:
        own, top = c["candidate_id"], F.col("top")
        sa, sb = F.try_element_at("scores_a", own), F.try_element_at("scores_b", own)
        margin = F.least(F.try_element_at("scores_a", top) - sa, F.try_element_at("scores_b", top) - sb)
        place = F.array_position("ranking_a", own) + F.array_position("ranking_b", own)
        return F.struct((sa + sb).alias("total"), (-place).alias("place"), own.alias("id"), margin.alias("margin"), c["text"].alias("text"))

    losers = F.array_sort(F.transform(F.filter("candidates", lambda c: c["candidate_id"] != F.col("top")), weigh))
    usable = F.filter(losers, lambda x: (x["margin"] >= min_margin) & (x["text"] != F.col("chosen.text")) & (F.col("chosen.repeat_ratio") <= 0.22) & (F.length(F.col("chosen.text")) <= 4000))
    j = j.withColumn("losers", F.when(F.col("reason").isNull(), F.slice(usable, 1, most)))
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (F.size("losers") == 0), "no_clear_margin").otherwise(F.col("reason")))
    flat = j.withColumn("loser", F.explode_outer(F.when(F.col("reason").isNull(), F.col("losers"))))
    return flat.select(
        "prompt_id", "reason", F.when(F.col("reason").isNull(), F.col("top")).alias("chosen_id"), F.col("loser.id").alias("rejected_id"),
        F.when(F.col("reason").isNull(), F.col("chosen.text")).alias("chosen"), F.col("loser.text").alias("rejected"), F.col("loser.margin").alias("margin"),
    )


def judge_packets(candidates: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two packets for blind judges: the candidates' ids and texts in a stable shuffle, and the same reversed."""
    flat = candidates.select("prompt_id", F.explode("candidates").alias("c")).select("prompt_id", F.col("c.candidate_id").alias("candidate_id"), F.col("c.text").alias("text"))
    keyed = flat.withColumn("h", hash_order(seed, "prompt_id", "candidate_id"))
    shuffled = keyed.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("h", "candidate_id", "text"))).alias("x"))
    packet = shuffled.select("prompt_id", F.transform("x", lambda c: F.struct(c["candidate_id"].alias("candidate_id"), c["text"].alias("text"))).alias("candidates"))
    return packet, packet.select("prompt_id", F.reverse("candidates").alias("candidates"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
