"""Document and conversation filters as ordered reject codes: the first rule that fails names the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MAX_CHARS = 4_000_000
MIN_CHARS = 200

# Limits of the supervised sources (weight, repeats, characters of prompt, answer, thinking).
SFT_RULES = {
    "identity": (0.01, 4, 500, 500, 0),
    "distill": (0.04, 2, 800, 700, 700),
    "gsm8k": (0.10, 2, 1400, 500, 1200),
    "maths_sft": (0.18, 1, 600, 350, 600),
    "openhermes_fr": (0.30, 1, 1400, 1800, 0),
    "oasst_fr": (0.04, 2, 1800, 1800, 0),
    "croissant": (0.08, 2, 1600, 1600, 0),
    "chat_human": (0.25, 1, 1800, 1800, 0),
}
PERSONA_SOURCES = ("chat_human", "oasst_fr", "croissant")


def document_code(text: Column, book: bool = False) -> Column:
    """Why a raw document is refused; null keeps it. `text` should be NFC-normalised (functions.exact.nfc)."""
    body = F.trim(text, F.lit(" \n\t\r"))
    after = X.clean_book(body) if book else body
    repeats = X.let(X.full_lines(after), lambda x: (F.size(x) > 10) & (F.size(F.array_distinct(x)) < F.size(x) * 0.65))
    return (
        F.when(text.isNull(), "not_text")
        .when(X.has_special(body), "special_token")
        .when(body.rlike(X.SPAM), "spam")
        .when(F.length(body) < MIN_CHARS, "too_short")
        .when(F.length(body) > MAX_CHARS, "too_long")
        .when(F.length(after) - F.length(F.replace(after, F.lit("�"), F.lit(""))) > 2, "replacement_chars")
        .when(F.regexp_count(after, F.lit(r"\p{L}")) < F.length(after) * 0.30, "few_letters")
        .when(repeats, "repeated_lines")
    )


def group_key(text: Column, url: Column, own_id: Column, metadata_url: Column | None = None) -> Column:
    """What makes documents one group: the first url or id there is, else the text's digest."""
    candidates = [c for c in (metadata_url, url, own_id) if c is not None]
    return F.coalesce(*[F.when(c != "", c) for c in candidates], X.fingerprint(text))


def clean_documents(docs: DataFrame, book: bool = False) -> DataFrame:
    """docs with `text` trimmed and `reject`, the code or null."""
    return docs.withColumn("reject", document_code(F.col("text"), book)).withColumn("text", F.trim("text", F.lit(" \n\t\r")))


def rule_table(rules: dict = SFT_RULES) -> list[tuple]:
    return [(name, float(w), int(r), int(p), int(f), int(t)) for name, (w, r, p, f, t) in rules.items()]


def with_rules(records: DataFrame, rules: dict = SFT_RULES) -> DataFrame:
    """records (source, m) with their source's limits; the rule table is tiny by construction."""
    spark = records.sparkSession
    table = spark.createDataFrame(rule_table(rules), "source string, weight double, max_repeat int, max_prompt int, max_final int, max_think int")
    return records.join(F.broadcast(table), "source", "left")


def answer_code(content: Column, source: Column, max_final: Column) -> Column:
    """Why an assistant message is refused."""

    def of_final(final: Column) -> Column:
        return (
            F.when(final == "", "reponse_finale_vide")
            .when(F.length(final) > max_final, "reponse_trop_longue")
            .when(X.repetition(final) > 0.35, "repetition")
            .when(final.rlike(X.COARSE), "contenu_grossier")
            .when((source != "identity") & final.rlike(X.FOREIGN_ASSISTANT), "identite_etrangere")
            .when(source.isin(*PERSONA_SOURCES) & final.rlike(X.INVENTED_PERSONA), "persona_inventee")
        )

    return F.when(~X.tags_balanced(content), "balises_think_invalides").otherwise(X.let(X.without_think(content), of_final))


def clean_conversations(records: DataFrame, rules: dict = SFT_RULES) -> DataFrame:
    """records (source, m) with `reject` (the first failing message's code, then the whole conversation's),
    `clean` (their messages; thinking that is empty or too long removed) and `note`."""
    ruled = with_rules(records, rules)
    known = F.filter(X.full_messages("m"), lambda m: m["role"].isin("system", "user", "assistant"))
    ruled = ruled.withColumn("clean", known)
    codes = F.filter(
        F.transform("clean", lambda m: F.when(m["role"] == "assistant", answer_code(m["text"], F.col("source"), F.col("max_final")))), lambda c: c.isNotNull()
    )
    users, answers = X.by_role(F.col("clean"), "user"), X.by_role(F.col("clean"), "assistant")
    asked = F.aggregate(users, F.lit(0), lambda a, x: a + F.length(x))
    reject = (
        F.when(F.col("max_prompt").isNull() | F.col("m").isNull(), "messages_absents")
        .when(F.size(codes) > 0, F.try_element_at(codes, F.lit(1)))
        .when((F.size(users) == 0) | (F.size(answers) == 0), "tour_manquant")
        .when(asked > F.col("max_prompt"), "prompt_trop_long")
    )

    def drop_think(m: Column) -> Column:
        blocks = X.think_blocks(m["text"])
        size = F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(F.trim(b, F.lit(" \n\t\r"))))
        return (m["role"] == "assistant") & (F.size(blocks) > 0) & ((size == 0) | (size > F.col("max_think")))

    stripped = F.exists("clean", drop_think)
    body = F.transform("clean", lambda m: F.struct(m["role"].alias("role"), F.when(drop_think(m), X.without_think(m["text"])).otherwise(m["text"]).alias("text")))
    out = ruled.withColumn("reject", reject).withColumn("note", F.when(F.col("reject").isNull() & stripped, "think_retire")).withColumn("clean", body)
    return out.drop("weight", "max_repeat", "max_prompt", "max_final", "max_think")


def alternates(messages: Column) -> Column:
    """Without system messages: user and assistant in strict turn, a user first, an assistant last."""
    turns = F.filter(X.full_messages(messages), lambda m: m["role"] != "system")
    right = F.transform(turns, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (F.size(turns) > 0) & (F.size(turns) % 2 == 0) & F.forall(right, lambda x: x)


def encoding_code(messages: Column, source: Column, tokens: Column, supervised: Column, max_length: int) -> Column:
    """Why a cleaned conversation is not encoded: injected marks, order of roles, a foreign answer, its length.

    Whole conversations only: `tokens` counts its ids, `supervised` those that are learnt."""
    marks = F.exists(messages, lambda m: F.contains(m["text"], F.lit(X.EOT)) | F.contains(m["text"], F.lit(X.IM_START)) | F.contains(m["text"], F.lit(X.IM_END)))
    french = F.forall(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: X.looks_french(m["text"]))
    return (
        F.when(marks, "controle_chat_injecte")
        .when(~alternates(messages), "ordre_des_roles")
        .when((source != "verified") & ~french, "reponse_non_francaise")
        .when((tokens > max_length + 1) | (supervised <= 0), "trop_long_ou_vide")
    )


def pair_ok(question: Column, answer: Column, least: int = 60) -> Column:
    """Whether a question and answer pass (the passage-thrice rule is functions.exact.triple_repeat)."""
    q, a = X.clean(question), X.clean(answer)
    refused = F.lit(False)
    for phrase in X.REFUSALS:
        refused = refused | F.contains(F.lower(a), F.lit(phrase))
    links = (F.length(a) - F.length(F.replace(a, F.lit("http"), F.lit("")))) / 4
    return (
        F.length(q).between(35, 7000) & F.length(a).between(least, 5000) & ~q.rlike(X.CONTROL_TAG) & ~a.rlike(X.CONTROL_TAG)
        & X.looks_french(q) & X.looks_french(a) & (links <= 1) & ~refused
    )


def distilled_code(raw: Column, kind: Column, max_think: int, max_final: int, answered: Column) -> Column:
    """Why a distilled answer is refused; `answered` says whether its check passes (null: no check)."""
    think = F.trim(F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1), F.lit(" \n\t\r"))
    has = raw.rlike(r"(?s)<think>(.*?)</think>")
    at = F.locate(X.THINK_END, raw)
    final = F.trim(F.substring(raw, at + len(X.THINK_END), F.length(raw)), F.lit(" \n\t\r"))
    lines = F.length(think) - F.length(F.replace(think, F.lit("\n"), F.lit("")))
    limit = F.when(kind == "chat", 3 * max_final).otherwise(max_final)
    return (
        F.when(~has, "sans_think")
        .when(final == "", "final_vide")
        .when(raw.rlike("[぀-ヿ一-鿿]"), "cjk")
        .when(raw.rlike("(?i)kimi|moonshot|openai|chatgpt|claude|anthropic|gpt"), "marque_interdite")
        .when((F.length(think) > max_think) | (lines > 2), "think_trop_long")
        .when(F.length(final) > limit, "final_trop_long")
        .when(~answered, "reponse_fausse")
    )


def histogram(rows: DataFrame, code: str = "reject") -> DataFrame:
    """How many rows each code has, kept ones as `kept`, most first."""
    return rows.groupBy(F.coalesce(code, F.lit("kept")).alias(code)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code)
