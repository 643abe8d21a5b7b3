"""Generator and streaming queries: rows depend on seeds only; streams run over a copy of the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generators, programs, sampling, verifiers
from ..operators.dedup import shared_folder
from ..streaming import metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def program_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced tasks over arithmetic programs."""
    return programs.tasks(spark, 200).drop("valid_orders")


@query
def program_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, shape, key and split of the tasks' programs, evaluated anew."""
    own = programs.tasks(spark, 200).select("id", "target", "objective", programs.program_facts("program_ast").alias("f"))
    return own.select("id", "objective", "target", "f.*")


@query
def program_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks' own answers scored: all succeed."""
    rows = programs.tasks(spark, 200).withColumn("output", F.col("answer"))
    return verifiers.score_program_output(rows).select("id", "objective", "success")


@query
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 of 200 tasks, objectives and difficulties in turn (the sample is the operator)."""
    return sampling.stratified(programs.tasks(spark, 200), "objective", "difficulty", "id", 30, 5, "target").select("id", "objective", "difficulty", "turn")


@query
def problem_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.problems(spark, 500, 1)


@query
def problem_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed conversations with distinct prompts until 50 000 characters."""
    own = generators.as_conversations(generators.problems(spark, 1000, 2))
    return generators.unique_until_budget(own, 50_000).select("n", "family", "q", "ans_text")


@query
def problem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.as_documents(generators.problems(spark, 400, 3))


@query
def distillation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.distillation_tasks(generators.problems(spark, 500, 4))


def _log(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(folder of events as JSON files, folder for a stream's output)."""
    root = shared_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("kind"), F.col("ts").alias("at")).repartition(4).write.json(f"{root}/log")
    return f"{root}/log", f"{root}/out"


@query
def stream_running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's exponential average, by a stateful stream over a log."""
    log, out = _log(spark, sf_dir)
    metrics.run_to_table(metrics.running_average(metrics.read_log(spark, log, "run string, step long, loss double")), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query
def stream_counting_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full windows of 20 events of each run with their success rate."""
    log, out = _log(spark, sf_dir)
    own = metrics.read_log(spark, log, "run string, step long, kind string").select(F.col("run").alias("key"), F.col("step").alias("seq"), (F.col("kind") != "error").alias("ok"))
    metrics.run_to_table(metrics.counting_windows(own, 20), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query
def stream_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (views) joined to responses (purchases) of the same run that follow within the timeout."""
    log, out = _log(spark, sf_dir)
    own = metrics.read_log(spark, log, "run string, step long, loss double, kind string, at timestamp")
    side = lambda kind: own.where(F.col("kind") == kind).select(F.col("run").alias("grp"), F.lit(0).alias("step"), F.lit(0).alias("item"), (F.col("loss") / 100 - 1).alias("score"), "at")
    metrics.run_to_table(metrics.rendezvous(side("view").drop("score"), side("purchase")), out, f"{out}-checkpoint")
    return spark.read.parquet(out)
