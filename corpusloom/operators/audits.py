"""Audits and reports: sources, token masks, mixes, manifests, metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row a group with its nearest-rank percentiles, from a histogram of the distinct values."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = hist.withColumn("_upto", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    aggs = [F.min(F.when(F.col("_upto") > F.bround((F.col("_all") - 1) * F.lit(q), 0), F.col("_v"))).alias(name) for name, q in quantiles.items()]
    return upto.groupBy(*keys).agg(*aggs)


def conversation_audit(records: DataFrame, corrupt: str | None = None) -> DataFrame:
    """Counts of records (source, m, k) by source: lines, broken, valid, multi-turn, duplicate prompts, thinking."""
    strip = F.lit(" \n\t\r")
    users = F.filter(F.transform(X.by_role(F.col("m"), "user"), lambda x: F.trim(F.coalesce(x, F.lit("")), strip)), lambda x: x != "")
    answers = F.filter(F.transform(X.by_role(F.col("m"), "assistant"), lambda x: F.trim(F.coalesce(x, F.lit("")), strip)), lambda x: x != "")
    bad = F.col(corrupt).isNotNull() if corrupt else F.lit(False)
    base = records.select("source", "k", bad.alias("bad"), F.col("m").isNull().alias("none"), users.alias("users"), answers.alias("answers"))
    base = base.withColumn("valid", ~F.col("bad") & ~F.col("none") & (F.size("users") > 0) & (F.size("answers") > 0))
    base = base.withColumn("prompt", F.array_join("users", "\n")).withColumn("answer", F.array_join("answers", "\n"))
    base = base.withColumn("blocks", X.think_blocks(F.col("answer"))).withColumn("final", X.without_think(F.col("answer")))
    think = F.trim(F.array_join("blocks", "\n"), strip)
    base = base.withColumn("think", think).withColumn("fp", F.when(F.col("valid"), X.fingerprint(F.col("prompt"))))
    when = lambda c: F.count_if(F.col("valid") & c)
    return base.groupBy("source").agg(
        F.count("*").alias("lines"),
        F.count_if("bad").alias("invalid_json"),
        F.count_if(~F.col("bad") & F.col("none")).alias("missing_messages"),
        F.count_if(~F.col("bad") & ~F.col("none") & ~F.col("valid")).alias("missing_turn"),
        F.count_if("valid").alias("valid"),
        when((F.size("users") > 1) | (F.size("answers") > 1)).alias("multi_turn"),
        (F.count("fp") - F.count_distinct("fp")).alias("duplicate_prompt"),
        when(F.size("blocks") > 0).alias("with_think"),
        when(~X.tags_balanced(F.col("answer"))).alias("bad_think_tags"),
        when((F.size("blocks") > 0) & (F.col("think") == "")).alias("empty_think"),
        when(F.col("final") == "").alias("empty_final"),
        when(F.length("answer") > 4000).alias("answer_gt_4000"),
        when(F.length("think") > 1600).alias("think_gt_1600"),
    )


def cross_source_duplicates(records: DataFrame, order: str, fp: str) -> DataFrame:
    """For each source the prompts that a source before it in `order` has too."""
    firsts = records.groupBy(fp).agg(F.min(order).alias("_first"))
    joined = records.select("source", order, fp).distinct().join(firsts, fp)
    return joined.groupBy("source").agg(F.count_if(F.col(order) > F.col("_first")).alias("duplicate_prompt_cross_source"))


def etl_report(docs: DataFrame, split: Column, tokens: Column) -> DataFrame:
    """By source: read, rejected, duplicates, kept, tokens by split, characters a token. docs has reject and duplicate."""
    kept = F.col("reject").isNull() & ~F.col("duplicate")
    base = docs.withColumn("_kept", kept).withColumn("_split", split).withColumn("_tokens", tokens.cast("long"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("_kept") & (F.col("_split") == s), F.col("_tokens"))), F.lit(0)).alias(f"{s}_tokens")
    return base.groupBy("source").agg(
        F.count("*").alias("read"), F.count_if(F.col("reject").isNotNull()).alias("rejected"),
        F.count_if(F.col("reject").isNull() & F.col("duplicate")).alias("duplicates"), F.count_if("_kept").alias("docs"),
        part("train"), part("val"), part("sealed"),
        F.round(F.sum(F.when(F.col("_kept"), F.length("text"))) / F.sum(F.when(F.col("_kept"), F.col("_tokens"))), 4).alias("chars_per_token"),
    )


def supervised_tokens(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def mask_audit(rows: DataFrame, tokens: str, mask: str, max_length: int, end: int = 0) -> DataFrame:
    """One row: whether masks fit their tokens, are 0/1, never teach the end id, documents are whole and within
    the length and each teaches something; the mean and the 95th percentile of what they teach."""
    own = rows.select(
        (F.size(tokens) == F.size(mask)).alias("aligned"), F.forall(mask, lambda x: x.isin(0, 1)).alias("binary"),
        F.forall(F.arrays_zip(F.col(tokens).alias("t"), F.col(mask).alias("m")), lambda z: (z["t"] != end) | (z["m"] == 0)).alias("end_free"),
        (F.try_element_at(tokens, F.lit(-1)) == end).alias("whole"), F.size(tokens).alias("n"), supervised_tokens(F.col(mask)).alias("s"),
    )
    return own.agg(
        F.count("*").alias("documents"), F.coalesce(F.bool_and("aligned"), F.lit(True)).alias("aligned"), F.coalesce(F.bool_and("binary"), F.lit(True)).alias("binary"),
        F.coalesce(F.bool_and("end_free"), F.lit(True)).alias("end_free"), F.coalesce(F.bool_and("whole"), F.lit(True)).alias("complete"),
        F.coalesce(F.max("n") <= max_length, F.lit(True)).alias("within"), F.coalesce(F.min("s") > 0, F.lit(True)).alias("all_supervised"),
        F.sum("s").alias("supervised"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", 0.95), 6).alias("p95"),
    )


def training_mix(stats: DataFrame, epochs: float, update_tokens: int) -> DataFrame:
    """stats (conversations, tokens, supervised) with assistant tokens a conversation and advised steps."""
    return stats.withColumn("per_conversation", F.round(F.col("supervised") / F.col("conversations"), 6)).withColumn("steps", F.ceil(F.lit(float(epochs)) * F.col("tokens") / F.lit(update_tokens)).cast("long"))


def artifact_violations(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files that are missing, or differ in size or digest."""
    o = observed.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    joined = expected.join(o, "name", "left")
    return joined.where(F.col("_sha").isNull() | (F.col("_bytes") != F.col("bytes")) | (F.col("_sha") != F.col("sha256"))).select("name", "bytes", "sha256")


def macro_validation(evals: DataFrame) -> DataFrame:
    """One row: the mean over sources of their token-weighted mean losses, and the micro mean."""
    by = evals.groupBy("source").agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("l"), F.sum(F.col("loss") * F.col("tokens")).alias("s"), F.sum("tokens").alias("t"))
    return by.agg(F.round(F.avg("l"), 6).alias("macro"), F.round(F.sum("s") / F.sum("t"), 6).alias("micro"))


def bits_per_byte(nll: Column, text: Column) -> Column:
    """Nats over the UTF-8 bytes of a text, in bits."""
    return nll / F.log(F.lit(2.0)) / F.octet_length(text)


def judge_stats(rows: DataFrame) -> DataFrame:
    """By kind: judged rows, accepted ones, refusals, truncations."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if("refusal").alias("refusals"), F.count_if("truncated").alias("truncated"))


def ema(values: Column, keep: float) -> Column:
    """The exponential average after each of an array's values, from the first."""
    out = F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) * F.lit(keep) + x * F.lit(1 - keep))),
    )
    return F.when(F.size(values) > 0, out).otherwise(F.array().cast("array<double>"))


def rewind(log: DataFrame, step: str, cursor: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, what is set aside) of a log rewound to a step."""
    return log.where(F.col(step) <= cursor), log.where(F.col(step) > cursor)


def spark_bucket(value: Column, low: Column, high: Column, levels: int = 8) -> Column:
    """A level 0 .. levels - 1 between the ends; 0 where they are equal."""
    return F.when(high > low, F.least(F.lit(levels - 1), F.floor((value - low) / (high - low) * levels))).otherwise(F.lit(0)).cast("int")


def log_summary(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """By run: its train events, first and last loss, least loss. Rows without a loss are not train events."""
    rows = log.where(F.col(loss).isNotNull())
    return rows.groupBy(run).agg(F.count("*").alias("events"), F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss"), F.min(loss).alias("best_loss"))
