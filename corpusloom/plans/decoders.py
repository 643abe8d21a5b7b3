"""Queries of the source decoders, over documents and conversations in the shapes that the decoders read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import task_bank, verifiers
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two parts of their first line: what is asked and what is answered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    strip = F.lit(" \n\t\r")
    return docs.withColumn("ask", F.trim(F.substring("text", 1, 40), strip)).withColumn("out", F.trim(F.substring("text", 41, 60), strip))


STRIP = r"E' \n\t\r'"
DOCS = f"SELECT doc_id, source, trim(substr(coalesce(text, ''), 1, 40), {STRIP}) AS ask, trim(substr(coalesce(text, ''), 41, 60), {STRIP}) AS out FROM documents"


def shown(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The decoded messages of each row: their number, the roles and the texts' digest."""
    texts = F.array_join(F.transform("m", lambda m: m["text"]), "\0")
    return rows.select(key, F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"), F.sha2(texts, 256).alias("texts_sha256"))


def pair(ask: str, out: str, rows: str) -> str:
    """SQL of `shown` for a question and an answer."""
    return f"SELECT doc_id, 2::BIGINT AS n, 'user,assistant' AS roles, sha256({ask} || chr(0) || {out}) AS texts_sha256 FROM ({rows})"


@query(pair(r"CASE WHEN doc_id % 3 = 0 THEN ask || E'\n\n' || source ELSE ask END", "out", f"SELECT * FROM ({DOCS}) WHERE ask <> '' AND out <> ''"))
def decode_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.col("ask").alias("instruction"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("input"), F.col("out").alias("output"))
    return shown(readers.decode_alpaca(rows))


@query(pair("ask", r"E'<think>\n2+2=4 et ' || (doc_id % 7) || E'\n</think>\nLa réponse est ' || (doc_id % 90) || '.'", f"SELECT * FROM ({DOCS}) WHERE ask <> '' AND doc_id % 5 <> 0"))
def decode_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked sums with calculator marks; every fifth has no answer mark."""
    answer = F.concat(F.lit("2+2=<<2+2=4>>4 et "), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 5 == 0, F.lit("\n")).otherwise(F.lit("\n#### ")), (F.col("doc_id") % 90).cast("string"))
    return shown(readers.decode_gsm8k(documents(spark, sf_dir).select("doc_id", F.col("ask").alias("question"), answer.alias("answer"))))


@query(pair("ask", r"CASE WHEN doc_id % 2 = 0 THEN E'<think>\n' || source || E'\n</think>\n' || out ELSE out END", f"SELECT * FROM ({DOCS}) WHERE out <> '' AND doc_id % 3 <> 0"))
def decode_dolphin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked solutions, every other with thoughts; every third row lacks its marks."""
    solution = F.concat(F.lit("<|begin_of_solution|>"), "out", F.lit("<|end_of_solution|>"))
    thought = F.concat(F.lit("<|begin_of_thought|>"), "source", F.lit("<|end_of_thought|>"))
    said = F.when(F.col("doc_id") % 3 == 0, F.col("out")).when(F.col("doc_id") % 2 == 0, F.concat(thought, solution)).otherwise(solution)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return shown(readers.decode_dolphin(documents(spark, sf_dir).select("doc_id", F.array(turn("user", F.col("ask")), turn("assistant", said)).alias("messages"))))


@query(pair("ask", "out", f"SELECT * FROM ({DOCS}) WHERE doc_id % 2 = 0"))
def decode_pleias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("en").alias("language"), F.col("ask").alias("query"), F.col("out").alias("synthetic_answer"), F.lit("").alias("query_seed_url"), F.col("doc_id").alias("synth_id"))
    return shown(readers.decode_pleias(rows))


@query(
    r"SELECT doc_id, 'Contexte : ' || ask || ' ' || source || E'\n\n' || 'q ' || doc_id || ' ?' AS question, coalesce(out, '') AS answer FROM (SELECT doc_id, source, trim(regexp_replace(ask, '\s+', ' ', 'g')) AS ask, out FROM ("
    + DOCS + ")) WHERE doc_id % 2 = 0 AND ask <> ''"
)
def decode_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over two joined documents, of a listed and another title."""
    docs = documents(spark, sf_dir).where("trim(regexp_replace(ask, '\\\\s+', ' ')) <> ''")
    title = F.when(F.col("doc_id") % 2 == 0, readers.QA_TITLES[0]).otherwise("other")
    rows = docs.select("doc_id", F.array("ask", "source").alias("documents"), F.concat(F.lit("q "), F.col("doc_id").cast("string"), F.lit(" ?")).alias("question"), F.array("out").alias("answers"), title.alias("title"))
    ids = F.regexp_extract("question", r"q (\d+) \?$", 1).cast("long")
    return readers.decode_qa(rows).select(ids.alias("doc_id"), "question", "answer")


CHAT = f"SELECT conv_id, list({{'role': role, 'text': trim(coalesce(text, ''), {STRIP})}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"


def _messages(m: str, rows: str) -> str:
    return f"SELECT conv_id, len(m)::BIGINT AS n, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles, sha256(array_to_string(list_transform(m, lambda x: x.text), chr(0))) AS texts_sha256 FROM (SELECT conv_id, {m} AS m FROM ({rows}))"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, m): conversations with trimmed texts."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return grouped.select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("m"))


@query(_messages("m", f"SELECT * FROM ({CHAT}) WHERE len(m) >= 2"))
def decode_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(readers.decode_chat(conversations(spark, sf_dir).withColumnRenamed("m", "conversation")), "conv_id")


@query(
    _messages(
        r"list_transform(m, lambda x, i: {'role': x.role, 'text': CASE WHEN i = 1 AND x.role = 'user' THEN E'Contexte :\nc' || conv_id || E'\n\n' || x.text ELSE x.text END})",
        f"SELECT * FROM ({CHAT}) WHERE len(m) >= 2 AND conv_id % 3 <> 0",
    )
)
def decode_chat_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by people, each with a context; every third is not by people."""
    human = F.when(F.col("conv_id") % 3 == 0, "model").otherwise("human")
    rows = conversations(spark, sf_dir).select("conv_id", human.alias("author"), F.lit("human").alias("style"), F.lit(None).cast("boolean").alias("code"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("context"), F.col("m").alias("conversation"))
    return shown(readers.decode_chat_human(rows), "conv_id")


@query(
    _messages(
        "list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant') AND x.text <> '')",
        f"SELECT * FROM ({CHAT}) WHERE len(list_filter(m, lambda x: x.role = 'user' AND x.text <> '')) > 0 AND len(list_filter(m, lambda x: x.role = 'assistant' AND x.text <> '')) > 0",
    )
)
def decode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose texts stand under either name."""
    odd = F.col("conv_id") % 2 == 1
    own = F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.when(odd, m["text"]).alias("content"), F.when(~odd, m["text"]).alias("text")))
    return shown(readers.decode_messages(conversations(spark, sf_dir).select("conv_id", own.alias("messages"))), "conv_id")


@query(_messages("m", f"SELECT * FROM ({CHAT})"))
def decode_nemotron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages inside JSON metadata."""
    own = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return shown(readers.decode_nemotron(conversations(spark, sf_dir).select("conv_id", F.to_json(F.struct(own.alias("messages"))).alias("metadata"))), "conv_id")


@query("SELECT capability, count(*) AS tasks, count(*) AS solved, 1.0::DOUBLE AS score FROM (SELECT ['reasoning_program', 'grounded', 'constraints', 'code', 'uncertainty', 'state_tracking'][i % 6 + 1] AS capability FROM range(120) t(i)) GROUP BY capability")
def task_bank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 tasks, twenty a capability, whose own solutions are verified: all succeed."""
    names = list(task_bank.SCHEMAS)
    made = [task_bank.make_task(n, task_bank.SPLITS[n % 2], n % 11 / 10, names[n % 6]) for n in range(120)]
    bank = spark.createDataFrame([tuple(t.values()) for t in made], task_bank.TASK)
    judged = bank.select("capability", verifiers.verify("answer", "solution").alias("v"))
    return judged.groupBy("capability").agg(F.count("*").alias("tasks"), F.count_if("v.primary_success").alias("solved"), F.round(F.avg("v.primary_score"), 9).alias("score"))
