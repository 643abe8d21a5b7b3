"""Evaluation queries. The tables hold no rollouts, so they are read out of `events`: a user is a task, its events
in order are rollouts, and any event but an error is a success; capabilities and schemas follow from user ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audits, preferences, profiles, sampling, splits, verifiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, FRONTIER = 4, 16


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, i, ok, value): the first FRONTIER rollouts of each task."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).select(F.col("user_id").alias("task_id"), (F.col("event_type") != "error").cast("int").alias("ok"), "value", F.row_number().over(order).alias("i"))
    return rows.where(F.col("i") <= FRONTIER)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).groupBy("task_id").agg(
        F.max(F.when(F.col("i") == 1, F.col("ok"))).alias("first_success"), F.sum(F.when(F.col("i") <= K, F.col("ok"))).alias("initial_successes"),
        F.sum("ok").alias("successes"), F.count("*").alias("k"), F.round(F.avg("value"), 6).alias("entropy"),
    )
    return rows.select(
        "*", F.concat(F.lit("cap"), (F.col("task_id") % 6).cast("string")).alias("capability"), F.concat(F.lit("schema"), (F.col("task_id") % 15).cast("string")).alias("schema_id"),
        ((F.col("task_id") % 9 + 1) / 10.0).alias("difficulty"),
    )


ROLLOUTS = f"SELECT * FROM (SELECT user_id AS task_id, (event_type <> 'error')::INTEGER AS ok, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i <= {FRONTIER}"
TASKS = f"SELECT task_id, max(ok) FILTER (i = 1) AS first_success, sum(ok) FILTER (i <= {K}) AS initial_successes, sum(ok) AS successes, count(*) AS k, round(avg(value), 6) AS entropy, 'cap' || (task_id % 6) AS capability, 'schema' || (task_id % 15) AS schema_id, (task_id % 9 + 1) / 10.0::DOUBLE AS difficulty FROM ({ROLLOUTS}) GROUP BY task_id"
SUMMARY = f"count(*) AS tasks, round(sum(first_success) / count(*), 9) AS pass_1, round(count(*) FILTER (initial_successes >= 1) / count(*), 9) AS pass_k, round(sum(initial_successes) / (count(*) * {K}), 9) AS success_rate, round(count(*) FILTER (initial_successes > 0 AND initial_successes < {K}) / count(*), 9) AS dynamic_rate, round(avg(entropy), 9) AS mean_entropy"


@query(f"SELECT CASE WHEN grouping(capability) = 0 THEN 'capability' WHEN grouping(schema_id) = 0 THEN 'schema' ELSE 'overall' END AS level, coalesce(capability, schema_id, 'all') AS name, {SUMMARY} FROM ({TASKS}) GROUP BY GROUPING SETS ((), (capability), (schema_id))")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.pass_at_k(tasks(spark, sf_dir), K)


@query(f"SELECT task_id, capability, schema_id, difficulty, round(greatest(0.02, (successes / k) * (1 - successes / k)), 9) AS weight FROM ({TASKS}) WHERE successes > 0 AND successes < k")
def frontier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.frontier_weights(tasks(spark, sf_dir)).select("task_id", "capability", "schema_id", "difficulty", "weight")


@query(f"WITH t AS (SELECT * FROM ({TASKS}) WHERE task_id >= 20), s AS (SELECT DISTINCT capability, schema_id FROM ({TASKS}) UNION SELECT 'cap9', 'schema99') SELECT s.capability, s.schema_id, coalesce(min(difficulty), 0.20)::DOUBLE AS difficulty, 1.0::DOUBLE AS weight FROM s LEFT JOIN t USING (capability, schema_id) GROUP BY ALL HAVING coalesce(max(CASE WHEN successes > 14 THEN 1 ELSE 0 END), 0) = 0")
def bridge_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas without a task that succeeds in more than 14 of 16 rollouts."""
    own = tasks(spark, sf_dir)
    schemas = own.select("capability", "schema_id").distinct().unionByName(spark.range(1).select(F.lit("cap9").alias("capability"), F.lit("schema99").alias("schema_id")))
    tried = own.where("task_id >= 20").withColumn("successes", F.when(F.col("successes") > 14, F.col("successes")).otherwise(0))
    return profiles.bridge_schemas(schemas, tried)


@query(f"SELECT capability, round(greatest(0.02, pow(1 - score, 2)), 9) AS focus, score + 1e-12 >= greatest(0.0, 0.82 - 0.02) AS holds FROM (SELECT capability, sum(first_success) / count(*) AS score FROM ({TASKS}) GROUP BY capability)")
def capability_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tasks(spark, sf_dir).groupBy("capability").agg((F.sum("first_success") / F.count("*")).alias("score"))
    return own.select("capability", F.round(profiles.focus(F.col("score")), 9).alias("focus"), profiles.gate(F.col("score"), F.lit(0.82), 0.02).alias("holds"))


@query(f"SELECT task_id, round(CASE WHEN rate > 0.72 THEN least(0.95, difficulty + 0.05) WHEN rate < 0.08 THEN greatest(0.05, difficulty - 0.05) ELSE difficulty END, 9) AS difficulty, round(0.5 + 0.5 * greatest(0.25, least(4.0, greatest(0.005, rate * (1 - rate)) / 0.16)), 9) AS scale FROM (SELECT task_id, difficulty, successes / k AS rate FROM ({TASKS}))")
def curriculum_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tasks(spark, sf_dir).withColumn("rate", F.col("successes") / F.col("k"))
    return own.select("task_id", F.round(profiles.next_difficulty(F.col("rate"), F.col("difficulty")), 9).alias("difficulty"), F.round(profiles.next_scale(F.col("rate"), F.lit(0.16), F.lit(1.0)), 9).alias("scale"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['b0', 'b1'][(event_id // 2) % 2 + 1] ELSE ['x', 'y', 'z'][(event_id // 2) % 3 + 1] END AS slot FROM events")
def replay_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", profiles.replay_slot(F.col("event_id"), ["b0", "b1"], ["x", "y", "z"]).alias("slot"))


@query(f"SELECT task_id, i, round(ok - m, 9) AS advantage FROM (SELECT task_id, i, ok, avg(ok) OVER w AS m, min(ok) OVER w AS lo, max(ok) OVER w AS hi FROM ({ROLLOUTS}) WINDOW w AS (PARTITION BY task_id)) WHERE lo < hi")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_advantage(rollouts(spark, sf_dir), "task_id", "ok").select("task_id", F.col("i").cast("long").alias("i"), F.round("advantage", 9).alias("advantage"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark records: a model is a user's residue, a category the event's type, the status its value's."""
    status = F.when(F.col("value") < 30, "correct").when(F.col("value") < 60, "manual_review").otherwise("incorrect")
    return events(spark, sf_dir).select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.when(F.col("event_type").isin("click", "view"), "facts").otherwise("reasoning").alias("section"),
        F.col("event_type").alias("category"), F.col("event_id").alias("item_index"), status.alias("status"), (status == "correct").alias("auto_correct"), (F.col("event_id") % 4 != 0).alias("manual_correct"),
    )


BENCH = "SELECT 'm' || (user_id % 3) AS model, CASE WHEN event_type IN ('click', 'view') THEN 'facts' ELSE 'reasoning' END AS section, event_type AS category, event_id AS item_index, CASE WHEN value < 30 THEN 'correct' WHEN value < 60 THEN 'manual_review' ELSE 'incorrect' END AS status, value < 30 AS auto_correct, event_id % 4 <> 0 AS manual_correct FROM events"
CATEGORIES = ["click", "purchase", "view"]


@query("SELECT model, " + ", ".join(f"count(*) FILTER (status = 'correct' AND category = '{c}') AS {c}_correct, count(*) FILTER (category = '{c}') AS {c}_total" for c in CATEGORIES) + f", count(*) FILTER (status = 'correct') AS correct, count(*) AS total, count(*) FILTER (status = 'manual_review') AS manual_review FROM ({BENCH}) GROUP BY model")
def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.leaderboard(bench(spark, sf_dir), CATEGORIES)


@query(f"SELECT model, section, category, count(*) FILTER (manual_correct) AS correct, count(*) AS total FROM ({BENCH}) GROUP BY GROUPING SETS ((model, section), (model, section, category))")
def adjudication_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.adjudication_totals(bench(spark, sf_dir))


@query(f"SELECT model, section, item_index, auto_correct, manual_correct FROM ({BENCH}) WHERE manual_correct <> auto_correct")
def adjudication_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.disagreements(bench(spark, sf_dir))


@query("SELECT 'missing_label' AS problem, 0::BIGINT AS n UNION ALL SELECT 'duplicate_item', 0::BIGINT")
def adjudication_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.adjudication_problems(bench(spark, sf_dir))


HALF = "SELECT sum(first_success) / count(*) AS pass_1, count(*) FILTER (initial_successes >= 1) / count(*) AS pass_k, sum(initial_successes) / (count(*) * 4) AS success_rate, avg(entropy) AS mean_entropy FROM ({0}) WHERE task_id % 2 = {1}"


@query(f"SELECT *, pass_1_kept AND pass_k_kept AND success_improves AND entropy_kept AS passed FROM (SELECT c.pass_1 >= b.pass_1 AS pass_1_kept, c.pass_k >= b.pass_k AS pass_k_kept, c.success_rate > b.success_rate AS success_improves, c.mean_entropy >= 0.65 * b.mean_entropy AS entropy_kept FROM ({HALF.format(TASKS, 0)}) b, ({HALF.format(TASKS, 1)}) c)")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd tasks as the candidate against even ones as the baseline."""
    own = tasks(spark, sf_dir)
    half = lambda r: profiles.pass_at_k(own.where(F.col("task_id") % 2 == r), K).where("level = 'overall'")
    return profiles.gates(half(0), half(1))


@query(f"SELECT model, coalesce(sum(c) FILTER (section = 'reasoning'), 0) >= 7 AS reasoning_floor, coalesce(sum(c) FILTER (section = 'facts'), 0) >= 5 AS facts_floor FROM (SELECT model, section, count(*) FILTER (manual_correct) AS c FROM ({BENCH}) GROUP BY ALL) GROUP BY model")
def ood_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bench(spark, sf_dir).groupBy("model", "section").agg(F.count_if("manual_correct").alias("correct"))
    return profiles.ood_gates(own)


@query(f"SELECT capability, answer::BIGINT AS answer, hits FROM (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY hits DESC, answer) AS r FROM (SELECT capability, initial_successes AS answer, count(*) AS hits FROM ({TASKS}) GROUP BY capability, initial_successes)) WHERE r = 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.majority(tasks(spark, sf_dir), "capability", "initial_successes")


@query(f"SELECT objective, count(*) AS tasks, round(avg(p), 9) AS expected_rate, round(avg(1 - pow(1 - p, 4)), 9) AS expected_pass_k FROM (SELECT objective, CASE objective WHEN 'order_steps' THEN 1 / factorial(n)::DOUBLE WHEN 'find_error' THEN 1.0::DOUBLE / n ELSE 1::DOUBLE / 1201 END AS p FROM (SELECT ['execute', 'order_steps', 'find_error'][task_id % 3 + 1] AS objective, (task_id % 2 + 2)::INTEGER AS n FROM ({TASKS}))) GROUP BY objective")
def chance_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected rate and pass@4 of blind guesses."""
    own = tasks(spark, sf_dir).select(F.element_at(F.array(F.lit("execute"), F.lit("order_steps"), F.lit("find_error")), (F.col("task_id") % 3 + 1).cast("int")).alias("objective"), (F.col("task_id") % 2 + 2).cast("int").alias("n"))
    return profiles.chance_report(own.withColumn("p", profiles.chance(F.col("objective"), F.col("n"), F.lit(1.0))), "objective", 4)


@query(f"SELECT split, objective, difficulty, count(*) AS tasks, sum(success)::BIGINT AS successes, grouping(split, objective, difficulty)::BIGINT AS set FROM (SELECT 's' || (task_id % 2) AS split, 'o' || (task_id % 3) AS objective, 'd' || (task_id % 4) AS difficulty, first_success AS success FROM ({TASKS})) GROUP BY GROUPING SETS ((), (split), (objective), (objective, difficulty))")
def macro_micro_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, n: F.concat(F.lit(p), (F.col("task_id") % n).cast("string"))
    return profiles.eval_counters(tasks(spark, sf_dir).select(name("s", 2).alias("split"), name("o", 3).alias("objective"), name("d", 4).alias("difficulty"), F.col("first_success").alias("success")))


@query("SELECT round(avg(l), 6) AS macro, round(sum(s) / sum(t), 6) AS micro FROM (SELECT sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1) AS l, sum(value * (event_id % 7 + 1)) AS s, sum(event_id % 7 + 1) AS t FROM events GROUP BY event_type)")
def macro_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.macro_validation(events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("value").alias("loss"), (F.col("event_id") % 7 + 1).alias("tokens")))


@query("SELECT doc_id, round(n_chars * 0.9 / ln(2.0) / octet_length(encode(text)), 9) AS bpb FROM documents")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 0.9 nats a character as the given loss."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.round(audits.bits_per_byte(F.col("n_chars") * 0.9, F.col("text")), 9).alias("bpb"))


@query("SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value < 100) AS ok, count(*) FILTER (value >= 100 AND value < 150) AS refusals, count(*) FILTER (value >= 150) AS truncated FROM events GROUP BY event_type")
def judge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("value") < 100).alias("ok"), F.col("value").between(100, 149.999999).alias("refusal"), (F.col("value") >= 150).alias("truncated"))
    return audits.judge_stats(own)


EMA = "WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), e AS (SELECT user_id, i, value AS ema FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, e.ema * 0.95 + r.value * (1 - 0.95) FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1) SELECT user_id, max(i) AS n, round(max_by(ema, i), 6) AS last FROM e GROUP BY user_id"


@query(EMA)
def ema_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential average of each run's losses after its last event."""
    own = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    average = own.select("user_id", audits.ema(F.transform("x", lambda e: e["value"]), 0.95).alias("e"))
    return average.select("user_id", F.size("e").cast("long").alias("n"), F.round(F.element_at("e", -1), 6).alias("last"))


@query("SELECT user_id, max(event_id) AS last_step, count(*) AS kept FROM events WHERE event_id <= 2500 GROUP BY user_id")
def metric_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays, _ = audits.rewind(events(spark, sf_dir), "event_id", 2500)
    return stays.groupBy("user_id").agg(F.max("event_id").alias("last_step"), F.count("*").alias("kept"))


@query("SELECT event_id, CASE WHEN hi > lo THEN least(7, floor((value - lo) / (hi - lo) * 8))::INTEGER ELSE 0 END AS level FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = events(spark, sf_dir).groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return events(spark, sf_dir).join(ends, "user_id").select("event_id", audits.spark_bucket(F.col("value"), F.col("lo"), F.col("hi")).alias("level"))


@query("SELECT user_id AS run, count(*) AS events, min_by(value, event_id) AS first_loss, max_by(value, event_id) AS last_loss, min(value) AS best_loss FROM events GROUP BY user_id")
def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.log_summary(events(spark, sf_dir).withColumnRenamed("user_id", "run"), "run", "event_id", "value")


# Preferences: four neighbours by id are a prompt's candidates, a text's digest stands for it; judges are hashes.


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, judge A, judge B): four candidates a prompt; scores 0..4 from hashes, rankings by score."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text"))
    flat = ids.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")).alias("prompt_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate_id"), "text", "doc_id")
    score = lambda salt: F.conv(F.substring(F.sha2(F.concat(F.lit(salt), (F.floor(F.col("doc_id") / 2)).cast("string")), 256), 1, 4), 16, 10).cast("int") % 5
    flat = flat.withColumn("sa", score("q")).withColumn("sb", F.greatest(F.lit(0), score("q") - (F.col("doc_id") % 2).cast("int")))
    entry = F.struct("candidate_id", "text", (F.col("doc_id") % 11 != 0).alias("stopped"), F.lit(0.0).alias("repeat_ratio"))
    candidates = flat.groupBy("prompt_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))

    def judge(column: str) -> DataFrame:
        rows = flat.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct((-F.col(column)).alias("s"), "candidate_id"))).alias("x"))
        ranking = F.transform("x", lambda c: c["candidate_id"])
        return rows.select("prompt_id", ranking.alias("ranking"), F.map_from_arrays(ranking, F.transform("x", lambda c: (-c["s"]).cast("int"))).alias("scores"), F.array().cast("array<string>").alias("unsafe"))

    return candidates, judge("sa"), judge("sb")


FLAT = "SELECT 'p' || (doc_id // 4) AS prompt_id, 'c' || doc_id AS id, sha256(text) AS text, doc_id % 11 <> 0 AS stopped, q AS sa, greatest(0, q - doc_id % 2)::INTEGER AS sb FROM (SELECT *, (concat('0x', substr(sha256('q' || (doc_id // 2)), 1, 4))::INTEGER) % 5 AS q FROM documents)"
PAIRS = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY sa DESC, id) AS ra, row_number() OVER (PARTITION BY prompt_id ORDER BY sb DESC, id) AS rb FROM ({FLAT})),
top AS (SELECT a.prompt_id, a.id, a.text, a.stopped, a.sa, a.sb, a.id = b.id AS agree FROM f a JOIN f b ON a.prompt_id = b.prompt_id AND a.ra = 1 AND b.rb = 1),
state AS (SELECT *, CASE WHEN NOT agree THEN 'judge_top_disagreement' WHEN NOT stopped OR text = '' THEN 'chosen_invalid' END AS reason FROM top),
pair AS (SELECT s.prompt_id, s.id AS chosen_id, f.id AS rejected_id, s.text AS chosen, f.text AS rejected, least(s.sa - f.sa, s.sb - f.sb) AS margin, row_number() OVER (PARTITION BY s.prompt_id ORDER BY f.sa + f.sb, -(f.ra + f.rb), f.id) AS r
  FROM state s JOIN f ON f.prompt_id = s.prompt_id AND f.id <> s.id WHERE s.reason IS NULL AND least(s.sa - f.sa, s.sb - f.sb) >= 1 AND f.text <> s.text)
SELECT prompt_id, NULL AS reason, chosen_id, rejected_id, chosen, rejected, margin FROM pair WHERE r <= 2
UNION ALL SELECT prompt_id, coalesce(reason, 'no_clear_margin'), CASE WHEN false THEN '' END, NULL, NULL, NULL, NULL FROM state WHERE reason IS NOT NULL OR prompt_id NOT IN (SELECT prompt_id FROM pair)"""


@query(PAIRS)
def pref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_pairs(*judged(spark, sf_dir))


@query(f"SELECT DISTINCT prompt_id, NULL::VARCHAR AS problem FROM ({FLAT})")
def judge_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judgment made by the rule is valid."""
    candidates, a, _ = judged(spark, sf_dir)
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    return candidates.join(a, "prompt_id").select("prompt_id", preferences.judgment_problem(F.col("ranking"), F.col("scores"), F.col("unsafe"), ids).alias("problem"))


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS unknown, 0::BIGINT AS duplicate")
def judge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, a, _ = judged(spark, sf_dir)
    return preferences.coverage_problems(candidates, a)


@query(f"SELECT prompt_id, list(id ORDER BY sha256(concat_ws(':', '7', prompt_id, id))) AS a, list(id ORDER BY sha256(concat_ws(':', '7', prompt_id, id)) DESC) AS b FROM ({FLAT}) GROUP BY prompt_id")
def judge_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = preferences.judge_packets(judged(spark, sf_dir)[0], 7)
    names = lambda df, n: df.select("prompt_id", F.transform("candidates", lambda c: c["candidate_id"]).alias(n))
    return names(a, "a").join(names(b, "b"), "prompt_id")


@query("SELECT doc_id, source, CASE WHEN r <= greatest(1, least(g // 5, 8)) THEN 'val' ELSE 'train' END AS split FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY sha256('4:' || source), source) AS r, count(*) OVER () AS g FROM (SELECT DISTINCT source FROM documents)) USING (source)")
def dpo_prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups to validation: here a source stands for a prompt."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return splits.grouped_split(rows, "source", 4)


# Verifiers: generations are made of documents' words.


@query(r"SELECT doc_id, replace(list_extract(regexp_extract_all(text, '[0-9](?:[0-9 ]*[0-9])?'), -1), ' ', '') AS last FROM documents")
def last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.last_number(F.col("text")).alias("last"))


@query(r"SELECT event_id, CASE event_id % 4 WHEN 0 THEN regexp_matches(f, '\boui\b') WHEN 1 THEN regexp_matches(f, '\bpair') AND NOT contains(f, 'impair') WHEN 2 THEN contains(f, event_type) ELSE coalesce(list_extract(regexp_extract_all(f, '[0-9]+'), -1) = (event_id % 10)::VARCHAR, false) END AS ok FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'oui, c''est ' || event_type || ' ' || (event_id % 10) WHEN 1 THEN 'pair ' || (event_id % 20) ELSE 'impair et non ' || event_type END AS f FROM events)")
def legacy_answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, parity, yes or no, and containment against short made-up answers."""
    e = F.col("event_id")
    final = F.when(e % 3 == 0, F.concat(F.lit("oui, c'est "), "event_type", F.lit(" "), (e % 10).cast("string"))).when(e % 3 == 1, F.concat(F.lit("pair "), (e % 20).cast("string"))).otherwise(F.concat(F.lit("impair et non "), "event_type"))
    answer = F.when(e % 4 == 0, "oui").when(e % 4 == 1, "pair").when(e % 4 == 2, F.col("event_type")).otherwise("x")
    return events(spark, sf_dir).select("event_id", verifiers.answer_matches(answer, F.when(e % 4 == 3, e % 10), final).alias("ok"))


@query("SELECT event_id, round(CASE WHEN n <= 60 THEN 0.0 ELSE 0.5 * least(1.0, (n - 60) / 40) END, 9) AS penalty FROM (SELECT event_id, event_id % 120 AS n FROM events)")
def overlong_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(verifiers.overlong_penalty(F.col("event_id") % 120, 100, 40, 0.5), 9).alias("penalty"))


TYPED = """
WITH x AS (
  SELECT event_id, event_id % 4 AS kind, event_type AS t, event_id % 60 AS said, event_id % 50 AS want, event_id % 7 AS n, event_id % 5 AS m,
         event_type IN ('click', 'view', 'error') AS listed FROM events)
SELECT event_id,
  CASE kind WHEN 0 THEN said = want WHEN 3 THEN n = m ELSE true END AS primary_success,
  CASE WHEN CASE kind WHEN 0 THEN said = want WHEN 3 THEN n = m ELSE true END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS primary_score,
  1.0::DOUBLE AS format_score,
  CASE kind WHEN 0 THEN said::VARCHAR WHEN 1 THEN CASE WHEN listed THEN '["' || t || '"]' ELSE '[]' END WHEN 2 THEN 'abstain' ELSE '{"n": ' || n || '}' END AS parsed_answer,
  CASE WHEN kind = 0 AND said <> want THEN 'number_wrong' WHEN kind = 3 AND n <> m THEN 'json_value' END AS failure_code
FROM x
"""


@query(TYPED)
def typed_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric, choice, abstention and JSON specs against made-up generations."""
    e = F.col("event_id")
    number = F.to_json(F.struct(F.lit("integer").alias("kind"), (e % 50).alias("value")))
    choice = F.to_json(F.struct(F.lit("choice").alias("kind"), F.col("event_type").alias("value"), F.array(F.lit("click"), F.lit("view"), F.lit("error")).alias("choices")))
    abstain = F.to_json(F.struct(F.lit("abstain").alias("kind")))
    shape = F.to_json(F.struct(F.lit("json").alias("kind"), F.struct((e % 5).cast("int").alias("n")).alias("value"), F.struct(F.lit("integer").alias("n")).alias("json_schema")))
    spec = F.when(e % 4 == 0, number).when(e % 4 == 1, choice).when(e % 4 == 2, abstain).otherwise(shape)
    said = F.when(e % 4 == 0, F.concat(F.lit("<think>x</think>Réponse : "), (e % 60).cast("string"))).when(e % 4 == 1, F.concat(F.lit("C'est "), "event_type")).when(e % 4 == 2, F.lit("Aucune information.")).otherwise(F.concat(F.lit('{"n": '), (e % 7).cast("string"), F.lit("}")))
    return events(spark, sf_dir).select("event_id", verifiers.verify(spec, said).alias("v")).select("event_id", "v.*")


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 9 = 7) THEN 'correct' WHEN event_id % 3 = 1 THEN 'manual_review' ELSE 'incorrect' END AS status, "
    "CASE WHEN event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 9 = 7) THEN 'numeric_final_unique' WHEN event_id % 3 = 1 THEN 'numeric_final_ambiguous' ELSE 'numeric_final_missing' END AS reason FROM events"
)
def strict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.concat(F.lit("Donc "), (e % 9).cast("string"))).when(e % 3 == 1, F.concat(F.lit("Réponse : "), (e % 9).cast("string"), F.lit(" ou 7"))).otherwise(F.lit("rien"))
    return events(spark, sf_dir).select("event_id", verifiers.score_strict(F.lit("num"), (e % 9).cast("string"), F.array(F.lit("")), said).alias("s")).select("event_id", "s.*")


@query(
    "SELECT event_id, round(CASE WHEN formed THEN 0.1 ELSE 0.0 END - penalty + CASE WHEN correct AND formed THEN 1.0 + 0.25 * greatest(0.0, 1.0 - n / 80) + CASE WHEN coherent THEN 0.15 ELSE 0.0 END ELSE 0.0 END, 9)::DOUBLE AS reward, "
    "round(greatest(-0.25, least(1.05, score + CASE WHEN score = 1.0 THEN 0.03 * stopped + 0.02 ELSE 0.0 END - CASE WHEN stopped = 0 THEN 0.2 ELSE 0.0 END)), 9)::DOUBLE AS typed FROM "
    "(SELECT event_id, event_id % 3 <> 0 AS formed, event_id % 2 = 0 AS correct, event_id % 120 AS n, (event_id % 5) / 10.0::DOUBLE AS penalty, event_id % 7 = 0 AS coherent, (event_id % 5) / 4.0::DOUBLE AS score, (event_id % 2) AS stopped FROM events)"
)
def reward_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rewards of made-up generations."""
    e = F.col("event_id")
    plain = verifiers.reward(e % 2 == 0, e % 3 != 0, e % 120, 80, (e % 5) / F.lit(10.0), e % 7 == 0)
    score, stopped = (e % 5) / F.lit(4.0), e % 2 == 1
    typed = verifiers.typed_reward(score, score == 1.0, stopped, F.concat(F.lit("Réponse : "), (e % 10).cast("string")), F.lit(1.0))
    return events(spark, sf_dir).select("event_id", F.round(plain, 9).alias("reward"), F.round(typed, 9).alias("typed"))


@query(f"SELECT task_id AS position, task_id, (CASE WHEN task_id % 2 = 0 THEN 2 * k ELSE k END)::BIGINT AS k, (CASE WHEN task_id % 2 = 0 THEN 2 * successes ELSE successes END)::BIGINT AS successes, initial_successes::BIGINT AS initial_successes, first_success::BIGINT AS first_success, round(entropy, 9) AS entropy FROM ({TASKS})")
def profile_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile refined by the same samples again on every other task."""
    own = tasks(spark, sf_dir).select(F.col("task_id").alias("position"), "task_id", *[F.col(c).cast("long").alias(c) for c in ("k", "successes", "initial_successes", "first_success")], "entropy")
    return profiles.refine(own, own.where("task_id % 2 = 0"))
