"""Readers: JSONL (strict and tolerant), Parquet with projection, and one decoder for each kind of source.

A decoder maps rows of its source to (t, m): the document's text, and its messages or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

MESSAGE = "struct<role:string,text:string>"
RECORD = f"t string, m array<{MESSAGE}>, k string"
CORRUPT = "_corrupt_record"
MAX_REASONING_CHARS = 3600
MAX_CONTEXT = 6500
# The native French collections of the question source.
QA_TITLES = ("fquad_v2", "piaf", "piaf_v2", "lincoln/newsquadfr", "lincoln/newsquadfr_v2")
STRIP = " \n\t\r"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """One row a line; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """One row a line; a broken line keeps its text in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_parquet(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("text", "id", "url", "metadata"), kind: str | None = None) -> DataFrame:
    """The columns that the files have, with their file's path. Without a kind, `text` must be there."""
    rows = spark.read.parquet(*paths)
    found = [c for c in columns if c in rows.columns]
    if kind is None and "text" not in found:
        raise ValueError(f"no text column in {paths}")
    return rows.select(*found, F.col("_metadata.file_path").alias("file"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def metadata_field(metadata: Column, name: str) -> Column:
    """A field of a metadata column that holds JSON text."""
    return F.get_json_object(metadata, f"$.{name}")


def _pair(user: Column, assistant: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("text")), F.struct(F.lit("assistant").alias("role"), assistant.alias("text")))


def _trim(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(STRIP))


def _with_text(rows: DataFrame, messages: Column) -> DataFrame:
    return rows.withColumn("m", messages).withColumn("t", X.render_chat(F.col("m")))


def decode_text(rows: DataFrame, least: int = 200) -> DataFrame:
    """kind text: trimmed, `least` characters or more."""
    return rows.withColumn("t", _trim(F.col("text"))).where(F.length("t") >= least).withColumn("m", F.lit(None).cast(f"array<{MESSAGE}>"))


def decode_chat(rows: DataFrame) -> DataFrame:
    """kind chat: `conversation`, two messages or more."""
    return _with_text(rows, F.transform("conversation", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))).where(F.size("m") >= 2)


def decode_chat_human(rows: DataFrame) -> DataFrame:
    """kind chat_human: author and style human, no code; a context goes ahead of a first user message."""
    kept = rows.where("author = 'human' and style = 'human' and not coalesce(code, false)")
    context = _trim(F.col("context"))
    lead = F.concat(F.lit("Contexte :\n"), context, F.lit("\n\n"))
    own = lambda m, i: F.struct(m["role"].alias("role"), F.when((i == 0) & (m["role"] == "user") & (context != ""), F.concat(lead, F.coalesce(m["text"], F.lit("")))).otherwise(F.coalesce(m["text"], F.lit(""))).alias("text"))
    return _with_text(kept, F.transform("conversation", own)).where(F.size("m") >= 2)


def decode_alpaca(rows: DataFrame) -> DataFrame:
    """kind alpaca: instruction, input and output."""
    ask, more, out = _trim(F.col("instruction")), _trim(F.col("input")), _trim(F.col("output"))
    kept = rows.where((ask != "") & (out != ""))
    return _with_text(kept, _pair(F.when(more != "", F.concat(ask, F.lit("\n\n"), more)).otherwise(ask), out))


def _between(text: Column, begin: str, end: str) -> Column:
    """What stands between the first marks; null unless both do, in order."""
    a, b = F.locate(begin, text), F.locate(end, text)
    return F.when((a > 0) & (a < b), F.trim(F.substring(text, a + len(begin), b - a - len(begin)), F.lit(STRIP)))


def decode_dolphin(rows: DataFrame) -> DataFrame:
    """kind dolphin_think: marked thoughts and solutions; any answer without a solution drops the row."""
    turns = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    body = lambda m: _trim(m["content"])
    solution = lambda m: F.coalesce(_between(body(m), "<|begin_of_solution|>", "<|end_of_solution|>"), F.lit(""))
    thought = lambda m: F.coalesce(_between(body(m), "<|begin_of_thought|>", "<|end_of_thought|>"), F.lit(""))
    answer = lambda m: F.when(thought(m) != "", F.concat(F.lit(X.THINK + "\n"), thought(m), F.lit(f"\n{X.THINK_END}\n"), solution(m))).otherwise(solution(m))
    shaped = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", body(m)).otherwise(answer(m)).alias("text")))
    lacking = F.exists(turns, lambda m: (m["role"] == "assistant") & (solution(m) == ""))
    return _with_text(rows.where(~lacking), shaped).where((F.size("m") >= 2) & (F.length("t") <= MAX_REASONING_CHARS))


def decode_gsm8k(rows: DataFrame) -> DataFrame:
    """kind gsm8k: calculator marks removed, steps and answer parted at the last ####."""
    answer = F.regexp_replace(F.regexp_replace(F.col("answer"), "<<[^<>]*>>?", ""), r">+(?=\d)", "")
    final = F.trim(F.substring_index(answer, "####", -1), F.lit(STRIP))
    steps = F.trim(F.substring(answer, F.lit(1), F.length(answer) - F.length(F.substring_index(answer, "####", -1)) - 4), F.lit(STRIP))
    question = _trim(F.col("question"))
    kept = rows.where((question != "") & F.contains("answer", F.lit("####")) & (steps != "") & (final != ""))
    return _with_text(kept, _pair(question, F.concat(F.lit(X.THINK + "\n"), steps, F.lit(f"\n{X.THINK_END}\nLa réponse est "), final, F.lit("."))))


def decode_messages(rows: DataFrame) -> DataFrame:
    """kind messages: known roles and texts (content, else text); both a user and an assistant."""
    own = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(_trim(m["content"]) != "", _trim(m["content"])).otherwise(_trim(m["text"])).alias("text")))
    kept = F.filter(own, lambda m: m["role"].isin("system", "user", "assistant") & (m["text"] != ""))
    return _with_text(rows, kept).where(F.exists("m", lambda m: m["role"] == "user") & F.exists("m", lambda m: m["role"] == "assistant"))


def decode_openhermes(rows: DataFrame) -> DataFrame:
    """kind openhermes: no flagged rows, no sums, no code, French answers."""
    ask, out = _trim(F.col("prompt")), _trim(F.col("accepted_completion"))
    flagged = F.coalesce("bad_entry", F.lit(False)) | F.coalesce("bad_prompt_detected", F.lit(False)) | F.coalesce("bad_response_detected", F.lit(False))
    sums = (F.regexp_count(ask, F.lit(r"\p{Nd}")) > 3) | ask.rlike(r"(?iU)\b(?:calcul|équation|combien|pourcentage|probabilité)\b")
    code = F.contains(out, F.lit("```")) | out.rlike(r"#include|def\s+\w+\(|function\s+\w+\(")
    return _with_text(rows.where(~flagged & (ask != "") & (out != "") & ~sums & ~code & X.looks_french(out)), _pair(ask, out))


def decode_book(rows: DataFrame, least: int = 2000) -> DataFrame:
    return rows.withColumn("t", X.clean_book(F.coalesce("text", F.lit("")))).where(F.length("t") >= least).withColumn("m", F.lit(None).cast(f"array<{MESSAGE}>"))


def decode_oral(rows: DataFrame, least: int = 300) -> DataFrame:
    return rows.withColumn("t", X.clean_oral(F.coalesce("text", F.lit("")))).where(F.length("t") >= least).withColumn("m", F.lit(None).cast(f"array<{MESSAGE}>"))


def decode_oasst(rows: DataFrame, hops: int = 5) -> DataFrame:
    """kind oasst: one path through each message tree, as (tree, m, t).

    rows: message_tree_id, message_id, parent_id, role, lang, deleted, synthetic, review_result, rank, quality,
    text, row_ord. From the tree's first root the best child follows (quality, then rank, then row_ord), at most
    `hops` times; assistant children need rank 0 or none and a quality of 0.5; the path must end on one. Each
    hop is one join of all trees' frontiers with their best children."""
    usable = rows.where("lang = 'fr' and not coalesce(deleted, false) and not coalesce(synthetic, false) and coalesce(review_result, true)")
    usable = usable.select("message_tree_id", "message_id", "parent_id", "role", "rank", F.coalesce("quality", F.lit(0.0)).alias("quality"), _trim(F.col("text")).alias("text"), "row_ord")
    fit = usable.where("role <> 'assistant' or (coalesce(rank, 0) = 0 and quality >= 0.5)").where("parent_id is not null")
    best = F.row_number().over(Window.partitionBy("parent_id", "role").orderBy(F.desc("quality"), F.asc(F.coalesce("rank", F.lit(0))), F.asc("row_ord")))
    children = fit.withColumn("_r", best).where("_r = 1").select(F.col("parent_id").alias("at"), F.col("role").alias("next_role"), F.col("message_id").alias("next"), F.col("text").alias("next_text"))
    first = F.row_number().over(Window.partitionBy("message_tree_id").orderBy("row_ord"))
    roots = usable.where("parent_id is null and role = 'prompter'").withColumn("_r", first).where("_r = 1")
    path = roots.select(F.col("message_tree_id").alias("tree"), F.col("message_id").alias("at"), F.lit("prompter").alias("role"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text"))).alias("m"))
    for _ in range(hops):
        wanted = path.withColumn("next_role", F.when(F.col("role") == "prompter", "assistant").otherwise("prompter"))
        joined = wanted.join(children, ["at", "next_role"], "left")
        grows = F.coalesce(F.col("next_text") != "", F.lit(False))
        message = F.struct(F.when(F.col("next_role") == "assistant", "assistant").otherwise("user").alias("role"), F.col("next_text").alias("text"))
        path = joined.select("tree", F.when(grows, F.col("next")).alias("at"), F.when(grows, F.col("next_role")).otherwise(F.col("role")).alias("role"), F.when(grows, F.concat("m", F.array(message))).otherwise(F.col("m")).alias("m"))
    whole = path.where((F.size("m") >= 2) & (F.element_at("m", -1)["role"] == "assistant"))
    return whole.select("tree", "m", X.render_chat(F.col("m")).alias("t"))


def decode_qa(rows: DataFrame, titles: tuple[str, ...] | None = QA_TITLES) -> DataFrame:
    """Questions over a context (documents joined) of at most 6500 characters; the first answer."""
    context = X.clean(F.array_join("documents", "\n\n"))
    kept = rows.where((context != "") & (F.length(context) <= MAX_CONTEXT))
    if titles is not None:
        kept = kept.where(F.col("title").isin(*titles))
    return kept.select(F.concat(F.lit("Contexte : "), context, F.lit("\n\n"), X.clean(F.col("question"))).alias("question"), F.coalesce(F.try_element_at("answers", F.lit(1)), F.lit("")).alias("answer"))


def decode_qa_text(rows: DataFrame) -> DataFrame:
    """Causal question text `Question : ..\\nRéponse : ..`, parted at the last answer mark, as conversations."""
    mark = "\nRéponse : "
    answer = F.substring_index(F.col("t"), mark, -1)
    prompt = F.substring(F.col("t"), F.lit(1), F.length("t") - F.length(answer) - len(mark))
    prompt = F.trim(F.regexp_replace(prompt, "^Question : ", ""), F.lit(STRIP))
    kept = rows.where(F.contains("t", F.lit(mark)) & (prompt != "") & (F.trim(answer, F.lit(STRIP)) != ""))
    return kept.select(_pair(prompt, F.trim(answer, F.lit(STRIP))).alias("m"), F.lit("grounded_qa").alias("k"))


def decode_nemotron(rows: DataFrame) -> DataFrame:
    """kind nemotron: messages inside JSON metadata."""
    messages = F.from_json(F.get_json_object("metadata", "$.messages"), "array<struct<role:string,content:string>>")
    return _with_text(rows, F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("text")))).where("m is not null")


def decode_pleias(rows: DataFrame) -> DataFrame:
    """kind pleias: French rows; the seed's url or the row's id is the group."""
    kept = rows.where("language = 'fr'")
    group = F.coalesce(F.when(F.col("query_seed_url") != "", F.col("query_seed_url")), F.col("synth_id").cast("string"))
    return _with_text(kept, _pair(_trim(F.col("query")), _trim(F.col("synthetic_answer")))).withColumn("group", group)


DECODERS = {
    "text": decode_text, "chat": decode_chat, "chat_human": decode_chat_human, "alpaca": decode_alpaca, "dolphin_think": decode_dolphin, "gsm8k": decode_gsm8k,
    "messages": decode_messages, "scholar": decode_messages, "nemotron": decode_nemotron, "pleias": decode_pleias, "openhermes": decode_openhermes, "book": decode_book, "oral": decode_oral, "oasst": decode_oasst,
}


def read_source(spark: SparkSession, kind: str, path: str | list[str], schema: str | None = None) -> DataFrame:
    """The documents of a local source (Parquet, or JSONL with a schema) of some kind."""
    if kind not in DECODERS:
        raise ValueError(f"unknown source kind {kind}")
    rows = spark.read.schema(schema).json(path) if schema else spark.read.parquet(*([path] if isinstance(path, str) else path))
    return DECODERS[kind](rows)


def tail_documents(docs: DataFrame, order: str, sources: list[str], characters: int) -> DataFrame:
    """The newest documents of each source until they hold its share of the characters."""
    from ..operators.budget import take_budget

    newest = docs.where(F.col("source").isin(*sources)).withColumn("_back", -F.col(order))
    return take_budget(newest, "source", ["_back"], F.length("text"), F.lit(characters // len(sources))).drop("_back")


def read_token_files(spark: SparkSession, tokens: str, mask: str | None = None, end: int = 0) -> DataFrame:
    """(file, document, tokens[, mask]) of little-endian 16-bit token files whose documents close with `end`.

    A file is one row of the scan, so files should be shards of a bounded size."""
    import numpy as np
    import pandas as pd

    raw = spark.read.format("binaryFile").load(tokens).select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("file"), F.col("content").alias("ids"))
    masks = spark.read.format("binaryFile").load(mask).select(F.regexp_extract("path", r"([^/]+)\.mask$", 1).alias("file"), F.col("content").alias("mask")) if mask else None
    joined = raw.join(masks, "file") if masks is not None else raw.withColumn("mask", F.lit(None).cast("binary"))

    def run(batches):
        for batch in batches:
            for name, ids, own in zip(batch["file"], batch["ids"], batch["mask"]):
                stream = np.frombuffer(ids, "<u2")
                ends = (np.flatnonzero(stream == end) + 1).tolist()
                ends += [len(stream)] if len(stream) and (not ends or ends[-1] < len(stream)) else []
                bits = np.frombuffer(own, np.uint8) if own is not None else None
                rows, start = [], 0
                for k, stop in enumerate(ends):
                    rows.append((name, k, stream[start:stop].astype(int).tolist(), None if bits is None else bits[start:stop].astype(int).tolist()))
                    start = stop
                yield pd.DataFrame(rows, columns=["file", "document", "tokens", "mask"])

    return joined.mapInPandas(run, "file string, document int, tokens array<int>, mask array<int>")
