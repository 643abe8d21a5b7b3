"""Queries over conversations: rendering, supervision, filters, audits.

A record is a conversation with its messages in order; the table names no source, so records take the
supervised sources in turn by conversation id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audits, dedup, quality
from .documents import FINGERPRINT, FRENCH, WORDS, re2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SOURCES = sorted(quality.SFT_RULES)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, source, m, k): one row a conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    m = F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.pmod("conv_id", F.lit(len(SOURCES))) + 1).cast("int"))
    return grouped.select("conv_id", source.alias("source"), m.alias("m"), F.lit("-").alias("k"))


NAMES = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
STRIP = r"E' \n\t\r'"
RECORDS = f"SELECT conv_id, {NAMES}[conv_id % {len(SOURCES)} + 1] AS source, list({{'role': role, 'text': trim(coalesce(text, ''), {STRIP})}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"
FULL = f"SELECT conv_id, source, list_filter(m, lambda x: x.text <> '') AS m FROM ({RECORDS})"
USERS = "list_transform(list_filter(m, lambda x: x.role = 'user'), lambda x: x.text)"
ANSWERS = "list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.text)"


@query(rf"SELECT conv_id, sha256(array_to_string(list_transform(m, lambda x: '{X.IM_START}' || x.role || E'\n' || x.text || E'{X.IM_END}\n'), '')) AS sha FROM ({FULL})")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("conv_id", F.sha2(X.render_chat(F.col("m")), 256).alias("sha"))


@query(
    rf"SELECT conv_id, 2 * len(m) AS segments, len(list_filter(m, lambda x: x.role = 'assistant')) AS learnt, sha256(array_to_string(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: CASE WHEN starts_with(x.text, '<think>') THEN x.text ELSE E'<think>\n\n</think>\n' || x.text END || E'{X.IM_END}\n'), '')) AS taught FROM ({FULL})"
)
def chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with an empty thinking block ahead of plain answers, and what is learnt of them."""
    own = records(spark, sf_dir).select("conv_id", X.chat_segments(F.col("m"), ensure_think=True).alias("s"))
    learnt = F.filter("s", lambda x: x["learn"])
    return own.select("conv_id", F.size("s").cast("long").alias("segments"), F.size(learnt).cast("long").alias("learnt"), F.sha2(F.array_join(F.transform(learnt, lambda x: x["text"]), ""), 256).alias("taught"))


RULES = "(VALUES " + ", ".join(f"('{n}', {p}, {f}, {t})" for n, (_, _, p, f, t) in sorted(quality.SFT_RULES.items())) + ") AS rules(source, max_prompt, max_final, max_think)"
FINAL = rf"trim(regexp_replace(x.text, '(?is)<think>(.*?)</think>', '', 'g'), {STRIP})"
GRAMS = rf"""(CASE WHEN len({WORDS.format(FINAL)}) < 80 THEN 0.0 ELSE 1.0 - len(list_distinct(list_transform(range(1, len({WORDS.format(FINAL)}) - 2), lambda i: ({WORDS.format(FINAL)})[i:i+3])))::DOUBLE / (len({WORDS.format(FINAL)}) - 3) END)"""
PERSONA = re2(X.INVENTED_PERSONA).replace(r"[\wÀ-ÿ-]", r"[\wÀ-ÿ\-]")
CODES = rf"""list_filter(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: CASE
  WHEN len(regexp_extract_all(x.text, '(?i)<think>')) <> len(regexp_extract_all(x.text, '(?i)</think>')) OR len(regexp_extract_all(x.text, '(?i)<think>')) <> len(regexp_extract_all(x.text, '(?is)<think>(.*?)</think>')) THEN 'balises_think_invalides'
  WHEN {FINAL} = '' THEN 'reponse_finale_vide' WHEN length({FINAL}) > max_final THEN 'reponse_trop_longue' WHEN {GRAMS} > 0.35 THEN 'repetition'
  WHEN regexp_matches({FINAL}, '{re2(X.COARSE)}') THEN 'contenu_grossier' WHEN source <> 'identity' AND regexp_matches({FINAL}, '{re2(X.FOREIGN_ASSISTANT)}') THEN 'identite_etrangere'
  WHEN source IN ('chat_human', 'oasst_fr', 'croissant') AND regexp_matches({FINAL}, '{PERSONA}') THEN 'persona_inventee' END), lambda c: c IS NOT NULL)"""


@query(
    rf"SELECT conv_id, source, CASE WHEN max_prompt IS NULL THEN 'messages_absents' WHEN len(codes) > 0 THEN codes[1] WHEN len({USERS}) = 0 OR len({ANSWERS}) = 0 THEN 'tour_manquant' WHEN coalesce(list_sum(list_transform({USERS}, lambda u: length(u))), 0) > max_prompt THEN 'prompt_trop_long' END AS reject FROM (SELECT *, {CODES} AS codes FROM ({FULL}) LEFT JOIN {RULES} USING (source))"
)
def conv_quality_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of its source that a conversation fails."""
    return quality.clean_conversations(records(spark, sf_dir)).select("conv_id", "source", "reject")


@query(
    f"SELECT source, coalesce(reject, 'kept') AS reject, count(*) AS n FROM (SELECT source, CASE WHEN max_prompt IS NULL THEN 'messages_absents' WHEN len(codes) > 0 THEN codes[1] WHEN len({USERS}) = 0 OR len({ANSWERS}) = 0 THEN 'tour_manquant' WHEN coalesce(list_sum(list_transform({USERS}, lambda u: length(u))), 0) > max_prompt THEN 'prompt_trop_long' END AS reject FROM (SELECT *, {CODES} AS codes FROM ({FULL}) LEFT JOIN {RULES} USING (source))) GROUP BY ALL"
)
def conv_reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality.clean_conversations(records(spark, sf_dir))
    return own.groupBy("source", F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"))


TURNS = "list_filter(m, lambda x: x.role <> 'system')"


@query(
    f"SELECT conv_id, len(t) > 0 AND len(t) % 2 = 0 AND list_bool_and(list_transform(t, lambda x, i: x.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) AS alternates FROM (SELECT conv_id, {TURNS} AS t FROM ({FULL}))"
)
def conv_role_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("conv_id", quality.alternates(F.col("m")).alias("alternates"))


@query(
    rf"SELECT conv_id, source FROM (SELECT conv_id, source, row_number() OVER (PARTITION BY {FINGERPRINT.format(rf'array_to_string({USERS}, chr(10))')} ORDER BY source, conv_id) AS r FROM ({RECORDS})) WHERE r = 1"
)
def conv_prompt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first conversation of each prompt, by source."""
    rows = records(spark, sf_dir).withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.trim(F.coalesce(x["text"], F.lit("")), F.lit(" \n\t\r")).alias("text"))))
    keyed = rows.select("source", "conv_id", X.prompt_fingerprint(F.col("m")).alias("fp"))
    return dedup.first_by(keyed, "fp", ["source", "conv_id"]).select("conv_id", "source")


@query(
    rf"""SELECT source, count(*) AS lines, 0::BIGINT AS invalid_json, 0::BIGINT AS missing_messages, count(*) FILTER (NOT valid) AS missing_turn, count(*) FILTER (valid) AS valid,
  count(*) FILTER (valid AND (len(users) > 1 OR len(answers) > 1)) AS multi_turn, count(*) FILTER (valid) - count(DISTINCT fp) FILTER (valid) AS duplicate_prompt, count(*) FILTER (valid AND len(blocks) > 0) AS with_think,
  0::BIGINT AS bad_think_tags, 0::BIGINT AS empty_think, count(*) FILTER (valid AND answer = '') AS empty_final, count(*) FILTER (valid AND length(answer) > 4000) AS answer_gt_4000, 0::BIGINT AS think_gt_1600
FROM (SELECT *, len(users) > 0 AND len(answers) > 0 AS valid, array_to_string(answers, E'\n') AS answer, regexp_extract_all(array_to_string(answers, E'\n'), '(?is)<think>(.*?)</think>') AS blocks, {FINGERPRINT.format(r"array_to_string(users, E'\n')")} AS fp
  FROM (SELECT source, list_filter({USERS}, lambda u: u <> '') AS users, list_filter({ANSWERS}, lambda u: u <> '') AS answers FROM ({RECORDS}))) GROUP BY source"""
)
def conv_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.conversation_audit(records(spark, sf_dir))


@query(
    "SELECT role, min(n) FILTER (up > round_even((c - 1) * 0.5, 0)) AS median, min(n) FILTER (up > round_even((c - 1) * 0.9, 0)) AS p90, min(n) FILTER (up > round_even((c - 1) * 0.99, 0)) AS p99 FROM (SELECT role, length(text) AS n, row_number() OVER (PARTITION BY role ORDER BY length(text)) AS up, count(*) OVER (PARTITION BY role) AS c FROM conversations WHERE text IS NOT NULL) GROUP BY role"
)
def conv_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.length("text").cast("long").alias("n"))
    return audits.nearest_ranks(rows, ["role"], "n", {"median": 0.5, "p90": 0.9, "p99": 0.99})


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, tokens, mask): a word's length stands for its id; an end id 0 closes each conversation."""
    segments = records(spark, sf_dir).select("conv_id", "source", X.chat_segments(F.col("m")).alias("s"))
    split = F.transform("s", lambda x: F.struct(F.regexp_extract_all(x["text"], F.lit(r"[^ \n]+"), F.lit(0)).alias("w"), x["learn"].cast("int").alias("l")))
    ids = F.flatten(F.transform(split, lambda x: F.transform(x["w"], lambda w: F.length(w))))
    bits = F.flatten(F.transform(split, lambda x: F.transform(x["w"], lambda w: x["l"])))
    return segments.select("conv_id", "source", F.concat(ids, F.array(F.lit(0))).alias("tokens"), F.concat(bits, F.array(F.lit(0))).alias("mask"))


BODY = r"len(regexp_extract_all({0}, '[^ \n]+'))"
TAUGHT = rf"coalesce(list_sum(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: {BODY.format(f"x.text || E'{X.IM_END}'")})), 0)"
ALL_IDS = rf"coalesce(list_sum(list_transform(m, lambda x: {BODY.format(f"x.text || E'{X.IM_END}'")} + 1)), 0) + 1"


@query(f"SELECT conv_id, ({TAUGHT})::BIGINT AS supervised, ({ALL_IDS})::BIGINT AS tokens FROM ({FULL})")
def supervised_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = masked(spark, sf_dir)
    return own.select("conv_id", audits.supervised_tokens(F.col("mask")).cast("long").alias("supervised"), F.size("tokens").cast("long").alias("tokens"))


@query(
    f"SELECT count(*) AS documents, true AS aligned, true AS \"binary\", true AS end_free, true AS complete, coalesce(max(n) <= 4096, true) AS within, coalesce(min(s) > 0, true) AS all_supervised, sum(s)::BIGINT AS supervised, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95 FROM (SELECT {TAUGHT} AS s, {ALL_IDS} AS n FROM ({FULL}))"
)
def conv_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.mask_audit(masked(spark, sf_dir), "tokens", "mask", 4096)


@query(
    f"SELECT source, conversations, tokens, supervised, round(supervised / conversations, 6) AS per_conversation, ceil(2.0 * tokens / 4096)::BIGINT AS steps FROM (SELECT source, count(*) AS conversations, sum({ALL_IDS})::BIGINT AS tokens, sum({TAUGHT})::BIGINT AS supervised FROM ({FULL}) GROUP BY source)"
)
def training_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = masked(spark, sf_dir)
    stats = own.groupBy("source").agg(F.count("*").alias("conversations"), F.sum(F.size("tokens")).alias("tokens"), F.sum(audits.supervised_tokens(F.col("mask"))).alias("supervised"))
    return audits.training_mix(stats, 2.0, 4096)


@query(
    f"SELECT source, (count(*) FILTER (o > first))::BIGINT AS duplicate_prompt_cross_source FROM (SELECT DISTINCT source, o, fp, min(o) OVER (PARTITION BY fp) AS first FROM (SELECT source, list_position({NAMES}, source) AS o, {FINGERPRINT.format(rf'array_to_string({USERS}, chr(10))')} AS fp FROM ({RECORDS}))) GROUP BY source"
)
def cross_source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.trim(F.coalesce(x["text"], F.lit("")), F.lit(" \n\t\r")).alias("text"))))
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return audits.cross_source_duplicates(rows.select("source", place.alias("o"), X.prompt_fingerprint(F.col("m")).alias("fp")), "o", "fp")


@query()
def answer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt dedup with at most two answers of a kind in a source; the kind is the answers' number of lines."""
    own = records(spark, sf_dir).select("conv_id", "source", X.by_role(F.col("m"), "user").alias("u"), X.by_role(F.col("m"), "assistant").alias("a"))
    keyed = own.select("source", "conv_id", X.fingerprint(F.array_join("u", "\n")).alias("prompt"), F.size(X.full_lines(F.array_join("a", "\n"))).alias("answer"))
    return dedup.answer_cap(keyed, "prompt", "source", "answer", 2, ["source", "conv_id"]).select("conv_id", "source")


@query(f"SELECT conv_id, round(least(1.0, greatest(0.0, coalesce((0.95 - u) / 0.5, 0.0))), 6) AS penalty FROM (SELECT conv_id, CASE WHEN len(w) >= 20 THEN len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])))::DOUBLE / (len(w) - 3) END AS u FROM (SELECT conv_id, {WORDS.format(f'array_to_string({ANSWERS}, chr(10))')} AS w FROM ({RECORDS})))")
def rambling_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("conv_id", F.array_join(X.by_role(F.col("m"), "assistant"), "\n").alias("t"))
    return rows.select("conv_id", F.round(X.rambling_penalty(F.col("t")), 6).alias("penalty"))


@query(
    rf"SELECT conv_id, CASE WHEN NOT coalesce(len(t) > 0 AND len(t) % 2 = 0 AND list_bool_and(list_transform(t, lambda x, i: x.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)), false) THEN 'ordre_des_roles' WHEN source <> 'verified' AND NOT list_bool_and(list_transform(a, lambda x: length(x) < 40 OR len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[A-Za-zÀ-ÿ'']+')), {FRENCH})) >= 3)) THEN 'reponse_non_francaise' WHEN n > 513 OR s <= 0 THEN 'trop_long_ou_vide' END AS code FROM (SELECT conv_id, source, {TURNS} AS t, {ANSWERS} AS a, {ALL_IDS} AS n, {TAUGHT} AS s FROM ({FULL}))"
)
def conv_encoding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a conversation is not encoded whole into 512 ids."""
    own = masked(spark, sf_dir).withColumn("s", audits.supervised_tokens(F.col("mask"))).withColumn("n", F.size("tokens")).select("conv_id", "n", "s")
    rows = records(spark, sf_dir).withColumn("m", X.full_messages(F.col("m"))).join(own, "conv_id")
    return rows.select("conv_id", quality.encoding_code(F.col("m"), F.col("source"), F.col("n"), F.col("s"), 512).alias("code"))


PAIR = f"SELECT conv_id, trim(regexp_replace(coalesce({USERS}[1], ''), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(coalesce({ANSWERS}[1], ''), '\\s+', ' ', 'g')) AS a FROM ({FULL})"


def _french(c: str) -> str:
    return rf"(length({c}) < 40 OR len(list_intersect(list_distinct(regexp_extract_all(lower({c}), '[A-Za-zÀ-ÿ'']+')), {FRENCH})) >= 3)"


@query(f"SELECT conv_id, length(q) BETWEEN 35 AND 7000 AND length(a) BETWEEN 60 AND 5000 AND {_french('q')} AND {_french('a')} AS ok FROM ({PAIR})")
def qa_pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question and answer of each conversation as a pair."""
    rows = records(spark, sf_dir).withColumn("m", X.full_messages(F.col("m")))
    first = lambda role: F.coalesce(F.try_element_at(X.by_role(F.col("m"), role), F.lit(1)), F.lit(""))
    return rows.select("conv_id", quality.pair_ok(first("user"), first("assistant")).alias("ok"))


@query(
    f"SELECT conv_id, CASE WHEN think IS NULL THEN 'sans_think' WHEN final = '' THEN 'final_vide' WHEN length(think) > 40 THEN 'think_trop_long' WHEN length(final) > CASE WHEN conv_id % 2 = 0 THEN 1500 ELSE 500 END THEN 'final_trop_long' END AS code FROM (SELECT conv_id, CASE WHEN conv_id % 5 <> 0 THEN trim(substr(q, 1, 10 + conv_id % 50)) END AS think, a AS final FROM ({PAIR}))"
)
def distillation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers wrapped as a teacher's output, refused for the reasons of the distillation filter."""
    rows = records(spark, sf_dir).withColumn("m", X.full_messages(F.col("m")))
    first = lambda role: X.squeeze(F.coalesce(F.try_element_at(X.by_role(F.col("m"), role), F.lit(1)), F.lit("")))
    think = F.substring(first("user"), F.lit(1), (F.col("conv_id") % 50 + 10).cast("int"))
    raw = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("<think>"), think, F.lit("</think>"), first("assistant"))).otherwise(first("assistant"))
    kind = F.when(F.col("conv_id") % 2 == 0, "chat").otherwise("maths")
    return rows.select("conv_id", quality.distilled_code(raw, kind, 40, 500, F.lit(True)).alias("code"))


@query(r"SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(trim(text), '\s+', ' ', 'g')) ORDER BY conv_id * 1000 + turn) AS r FROM conversations WHERE role = 'user' AND length(trim(text)) >= 8) WHERE r = 1 ORDER BY sha256(concat_ws(':', '6', CAST(conv_id * 1000 + turn AS VARCHAR))) LIMIT 40")
def prompt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 distinct chat prompts in a stable shuffle (the limit is the operator)."""
    from ..operators.sampling import prompt_pool as pool

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    named = rows.withColumn("prompt_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("prompt", F.col("text")).withColumn("q", F.lit("")).withColumn("category", F.lit("chat"))
    return pool(named, 6, 40).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, document, count(*) AS size FROM (SELECT conv_id, coalesce(sum((role = 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS document FROM conversations) GROUP BY ALL")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as a stream whose documents end with an assistant's turn."""
    from ..operators.budget import segments

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.when(F.col("role") == "assistant", 0).otherwise(1).alias("token"))
    return segments(rows, "conv_id", "turn", "token").select("conv_id", "document", "size")


@query()
def circular_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 30 000 ids of the pool from id 1000 around; the last one is the end id."""
    from ..operators.budget import circular_copy as copy

    pool = masked(spark, sf_dir).select("conv_id", "tokens")
    out, _ = copy(pool, ["conv_id"], "tokens", 30_000, 1000)
    return out


@query(rf"SELECT conv_id, turn, CASE WHEN contains(t, '</think>') THEN trim(string_split(t, '</think>')[-1], {STRIP}) ELSE trim(string_split(t, '<think>')[1], {STRIP}) END AS final FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>a</think>' WHEN 1 THEN 'b<think>' ELSE '' END || text AS t FROM conversations)")
def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of turns with made-up thinking marks."""
    mark = F.when(F.col("turn") % 3 == 0, "<think>a</think>").when(F.col("turn") % 3 == 1, "b<think>").otherwise("")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", X.visible_final(F.concat(mark, "text")).alias("final"))
