"""Queries over documents: filters, deduplication, splits, budgets. Each has its DuckDB statement beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import text as X
from ..operators import audits, budget, dedup, quality, sampling, splits

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
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# The same patterns in RE2's spelling, for the oracle.
def re2(pattern: str) -> str:
    return pattern.replace("'", "''")


SPAM = re2(X.SPAM)
NOISE = re2(X.BOOK_NOISE)
FRENCH = "[" + ", ".join(f"'{w}'" for w in X.FRENCH_WORDS) + "]"
SPECIAL = " OR ".join(f"contains(text, '{t}')" for t in X.SPECIALS)
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
FINGERPRINT = r"sha256(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))))"
BUCKET = "((concat('0x', substr(sha256({0}), 1, 16)))::UBIGINT % {1})"
REPETITION = (
    "CASE WHEN len(w) < {floor} OR len(w) < 4 THEN 0.0 ELSE 1.0 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])))::DOUBLE / (len(w) - 3) END"
)
REJECT = rf"""CASE WHEN text IS NULL THEN 'not_text' WHEN {SPECIAL} THEN 'special_token' WHEN regexp_matches(text, '{SPAM}') THEN 'spam'
  WHEN length(trim(text, E' \n\t\r')) < 200 THEN 'too_short' WHEN length(trim(text, E' \n\t\r')) > 4000000 THEN 'too_long'
  WHEN length(text) - length(replace(text, '�', '')) > 2 THEN 'replacement_chars'
  WHEN len(regexp_extract_all(trim(text, E' \n\t\r'), '\p{{L}}')) < length(trim(text, E' \n\t\r')) * 0.30 THEN 'few_letters'
  WHEN len(lines) > 10 AND len(list_distinct(lines)) < len(lines) * 0.65 THEN 'repeated_lines' END"""
LINES = r"list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '')"
CLEANED = f"SELECT *, {REJECT} AS reject FROM (SELECT *, {LINES} AS lines FROM documents)"


@query(r"SELECT doc_id, length(trim(text, E' \n\t\r')) AS n FROM documents WHERE length(trim(text, E' \n\t\r')) >= 200")
def doc_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text source decoder: trimmed texts of 200 characters or more."""
    from ..sources.readers import decode_text

    return decode_text(documents(spark, sf_dir)).select("doc_id", F.length("t").cast("long").alias("n"))


@query(r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{L}'))::DOUBLE / greatest(length(text), 1), 6) AS share FROM documents")
def doc_alpha_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(X.letter_share(F.col("text")), 6).alias("share"))


@query(f"SELECT doc_id, len(l) AS lines, round(CASE WHEN len(l) > 0 THEN len(list_distinct(l))::DOUBLE / len(l) ELSE 1.0 END, 6) AS share FROM (SELECT doc_id, {LINES} AS l FROM documents)")
def doc_line_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(X.full_lines(F.col("text"))).cast("long").alias("lines"), F.round(X.line_share(F.col("text")), 6).alias("share"))


@query(f"SELECT doc_id, reject FROM ({CLEANED})")
def doc_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of the document filter that a text fails."""
    return quality.clean_documents(documents(spark, sf_dir)).select("doc_id", "reject")


@query(f"SELECT coalesce(reject, 'kept') AS reject, count(*) AS n FROM ({CLEANED}) GROUP BY 1")
def doc_reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(quality.clean_documents(documents(spark, sf_dir)))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{SPAM}')")
def doc_spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("text").rlike(X.SPAM)).select("doc_id")


@query(
    rf"SELECT doc_id, length(text) < 40 OR len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ'']+')), {FRENCH})) >= 3 AS french FROM documents"
)
def doc_french_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.looks_french(F.col("text")).alias("french"))


@query(f"SELECT doc_id, round({REPETITION.format(floor=80)}, 6) AS filtered, round({REPETITION.format(floor=8)}, 6) AS short, round({REPETITION.format(floor=0)}, 6) AS plain FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def doc_repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated word 4-grams under the floors of 80, 8 and 0 words."""
    base = documents(spark, sf_dir).select("doc_id", F.size(X.words(F.col("text"))).alias("n"), X.unique_share(F.col("text")).alias("u"))
    value = lambda floor: F.round(F.when(F.col("n") < floor, 0.0).otherwise(F.coalesce(1.0 - F.col("u"), F.lit(0.0))), 6)
    return base.select("doc_id", value(80).alias("filtered"), value(8).alias("short"), value(0).alias("plain"))


@query(
    f"SELECT doc_id, round(CASE WHEN len(w) < 20 THEN 0.0 ELSE least(1.0, greatest(0.0, (0.95 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])))::DOUBLE / (len(w) - 3)) / 0.5)) END, 6) AS penalty FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"
)
def doc_repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(X.repetition_penalty(F.col("text")), 6).alias("penalty"))


@query()
def doc_backref_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a passage of 30 characters stands three times in a row (a backreference, beyond the oracle's regexes)."""
    return documents(spark, sf_dir).select("doc_id", exact.triple_repeat("text").alias("thrice"))


@query(rf"SELECT doc_id, sha256(trim(array_to_string(list_filter(string_split(text, E'\n'), lambda x: NOT regexp_matches(x, '{NOISE}')), E'\n'), E' \n\t\r')) AS sha FROM documents")
def doc_book_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.clean_book(F.col("text")), 256).alias("sha"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(trim(text), '\[speaker\d+:?\]\s*', E'\n— ', 'g'), E' \n\t\r')) AS sha FROM documents WHERE length(trim(regexp_replace(trim(text), '\[speaker\d+:?\]\s*', E'\n— ', 'g'), E' \n\t\r')) >= 300")
def doc_oral_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import decode_oral

    return decode_oral(documents(spark, sf_dir)).select("doc_id", F.sha2("t", 256).alias("sha"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '\s+', ' ', 'g'))) AS sha FROM documents")
def doc_whitespace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.clean(F.col("text")), 256).alias("sha"))


@query(f"SELECT doc_id, {FINGERPRINT.format('text')} AS fingerprint, {BUCKET.format('source', 1000)}::INTEGER AS bucket FROM documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), X.stable_bucket(F.col("source"), 1000).alias("bucket"))


@query(f"SELECT min(doc_id) AS doc_id, {FINGERPRINT.format('text')} AS fingerprint FROM documents GROUP BY 2")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each fingerprint."""
    rows = documents(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))
    return dedup.first_by(rows, "fingerprint", ["doc_id"])


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {FINGERPRINT.format('text')} ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def doc_dedup_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins by source, then by document."""
    rows = documents(spark, sf_dir).select("source", "doc_id", X.fingerprint(F.col("text")).alias("fp"))
    return dedup.first_by(rows, "fp", ["source", "doc_id"]).select("doc_id", "source")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {FINGERPRINT.format('text')} ORDER BY doc_id) AS r FROM ({CLEANED}) WHERE reject IS NULL) WHERE r = 1")
def doc_dedup_after_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that pass the filter claim their fingerprint."""
    rows = quality.clean_documents(documents(spark, sf_dir)).select("doc_id", X.fingerprint(F.col("text")).alias("fp"), "reject")
    return dedup.dedup_after_reject(rows, "fp", ["doc_id"]).select("doc_id")


@query()
def doc_two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy: kept iff no earlier kept row has the same fingerprint or the same set of words."""
    bag = F.sha2(F.array_join(F.array_sort(F.array_distinct(X.words(F.col("text")))), " "), 256)
    rows = documents(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("a"), bag.alias("b"))
    return dedup.two_key_dedup(rows, "a", "b", ["doc_id"]).select("doc_id")


@query(
    f"SELECT source, split, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM (SELECT *, CASE {BUCKET.format(FINGERPRINT.format('text'), 1000)} WHEN 0 THEN 'val' WHEN 1 THEN 'sealed' ELSE 'train' END AS split FROM documents) GROUP BY ALL"
)
def split_998_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).withColumn("split", splits.split_998(X.fingerprint(F.col("text"))))
    return own.groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, CASE {BUCKET.format('CAST(doc_id AS VARCHAR)', 100)} WHEN 0 THEN 'val' WHEN 1 THEN 'sealed' ELSE 'train' END AS split FROM documents")
def split_98_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", splits.split_98(F.col("doc_id").cast("string")).alias("split"))


@query(f"SELECT doc_id, CASE WHEN {BUCKET.format('text', 1000)} < 5 THEN 'val' ELSE 'train' END AS by_fingerprint, CASE WHEN {BUCKET.format('text', 200)} < 1 THEN 'val' ELSE 'train' END AS by_content FROM documents")
def split_val_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 of 1000 and 1 of 200 to validation, by hash."""
    return documents(spark, sf_dir).select("doc_id", splits.split_share(F.col("text"), 1000, 5).alias("by_fingerprint"), splits.split_share(F.col("text"), 200, 1).alias("by_content"))


@query(
    f"SELECT doc_id, CASE WHEN before < 32768 OR {BUCKET.format('CAST(doc_id AS VARCHAR)', 200)} = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, length(text) AS n FROM documents))"
)
def split_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.length("text").alias("n"))
    return splits.split_with_floor(rows, ["doc_id"], F.col("n"), F.col("doc_id").cast("string")).select("doc_id", "split")


@query(
    "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, source, length(text) AS n FROM documents)) WHERE before < 20000"
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source until 20 000 characters, the last one whole."""
    rows = documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n"))
    return budget.take_budget(rows, "source", ["doc_id"], F.col("n"), F.lit(20000)).select("doc_id", "source")


@query(
    "SELECT doc_id, source FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, (i - 7 + 1000000 * c) % c AS turn FROM (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)) WHERE n > 0) WHERE before < 20000"
)
def rotated_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n"))
    return budget.rotated_budget(rows, "source", ["doc_id"], F.col("n"), F.lit(20000), 7).select("doc_id", "source")


@query(
    "SELECT source, count(*) AS pieces, sum(taken)::BIGINT AS taken, max(pass) AS last_pass FROM (SELECT source, pass, least(n, 500000 - (pass * total + before)) AS taken FROM (SELECT *, unnest(range(0, ceil(500000 / total)::BIGINT)) AS pass FROM (SELECT source, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(length(text)) OVER (PARTITION BY source)::BIGINT AS total FROM documents))) WHERE taken > 0 GROUP BY source"
)
def repeat_to_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over each source until 500 000 characters, the last piece cut."""
    rows = documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n"))
    out = budget.repeat_to_quota(rows, "source", ["doc_id"], F.col("n"), 500_000)
    return out.groupBy("source").agg(F.count("*").alias("pieces"), F.sum("taken").alias("taken"), F.max("pass").cast("long").alias("last_pass"))


@query(
    "SELECT doc_id, o AS \"offset\", w[o+1:o+32] AS x, w[o+2:o+33] AS y FROM (SELECT doc_id, w, unnest(range(0, len(w) - 32, 32)) AS o FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ ]+'), lambda t: length(t)::INTEGER) AS w FROM documents) WHERE len(w) > 32)"
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 ids and the same moved on by one; a word's length stands for its id."""
    ids = F.transform(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), lambda t: F.length(t))
    rows = documents(spark, sf_dir).select("doc_id", ids.alias("t")).select("doc_id", F.explode(budget.fixed_windows(F.col("t"), 32)).alias("w"))
    return rows.select("doc_id", F.col("w.offset").cast("long").alias("offset"), "w.x", "w.y")


REPORT = f"""
SELECT source, count(*) AS read, count(*) FILTER (reject IS NOT NULL) AS rejected, count(*) FILTER (reject IS NULL AND r > 1) AS duplicates, count(*) FILTER (reject IS NULL AND r = 1) AS docs,
  coalesce(sum(tokens) FILTER (reject IS NULL AND r = 1 AND split = 'train'), 0)::BIGINT AS train_tokens, coalesce(sum(tokens) FILTER (reject IS NULL AND r = 1 AND split = 'val'), 0)::BIGINT AS val_tokens,
  coalesce(sum(tokens) FILTER (reject IS NULL AND r = 1 AND split = 'sealed'), 0)::BIGINT AS sealed_tokens,
  round(sum(length(trim(text, E' \\n\\t\\r'))) FILTER (reject IS NULL AND r = 1)::DOUBLE / sum(tokens) FILTER (reject IS NULL AND r = 1), 4) AS chars_per_token
FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS r, CASE {BUCKET.format('fp', 1000)} WHEN 0 THEN 'val' WHEN 1 THEN 'sealed' ELSE 'train' END AS split, len({WORDS.format('text')}) AS tokens
  FROM (SELECT *, {FINGERPRINT.format("trim(text, E' \\n\\t\\r')")} AS fp FROM ({CLEANED})))
GROUP BY source"""


@query(REPORT)
def doc_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus build in one plan: filter, first-wins dedup, split, tokens, report by source."""
    docs = quality.clean_documents(documents(spark, sf_dir)).withColumn("fp", X.fingerprint(F.col("text")))
    slim = docs.select("doc_id", "source", "reject", "fp", F.size(X.words(F.col("text"))).alias("tokens"), F.col("text"))
    # The text is reduced to its length before the shuffle of the dedup.
    slim = slim.withColumn("n", F.length("text")).drop("text")
    marked = dedup.mark_duplicates(slim, "fp", ["doc_id"])
    kept = F.col("reject").isNull() & ~F.col("duplicate")
    split = splits.split_998(F.col("fp"))
    part = lambda s: F.coalesce(F.sum(F.when(kept & (split == s), F.col("tokens"))), F.lit(0)).alias(f"{s}_tokens")
    return marked.groupBy("source").agg(
        F.count("*").alias("read"), F.count_if(F.col("reject").isNotNull()).alias("rejected"), F.count_if(F.col("reject").isNull() & F.col("duplicate")).alias("duplicates"), F.count_if(kept).alias("docs"),
        part("train"), part("val"), part("sealed"), F.round(F.sum(F.when(kept, F.col("n"))) / F.sum(F.when(kept, F.col("tokens"))), 4).alias("chars_per_token"),
    )


@query("SELECT doc_id, h FROM (SELECT doc_id, sha256(concat_ws(':', '11', CAST(doc_id AS VARCHAR))) AS h FROM documents) ORDER BY h, doc_id LIMIT 50")
def hash_shuffle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 of a stable shuffle (the sample is the operator)."""
    rows = documents(spark, sf_dir).select("doc_id").withColumn("h", sampling.hash_order(11, "doc_id"))
    return rows.orderBy("h", "doc_id").limit(50)


@query(
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i IN (SELECT (k * (n2 - 1)) // 19 FROM (SELECT unnest(range(20)) AS k), (SELECT count(*) AS n2 FROM documents))"
)
def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 documents spread evenly over the order (the sample is the operator)."""
    return sampling.linspace_rows(documents(spark, sf_dir).select("doc_id"), ["doc_id"], 20)


@query(
    "SELECT doc_id, CASE WHEN u < 0.4 THEN 'fineweb' WHEN u < 0.6 THEN 'wiki' WHEN u < 0.75 THEN 'chat' ELSE 'maths' END AS source, u FROM (SELECT doc_id, ((concat('0x', substr(sha256(concat_ws(':', '3', CAST(doc_id AS VARCHAR))), 1, 12)))::UBIGINT % 1000000) / 1e6 AS u FROM documents)"
)
def mixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each draw, by weight."""
    rows = documents(spark, sf_dir).select("doc_id", sampling.uniform(3, "doc_id").alias("u"))
    return sampling.mixture(rows, {"fineweb": 0.40, "wiki": 0.20, "chat": 0.15, "maths": 0.25}, 3, "doc_id")


@query("SELECT doc_id, ((concat('0x', substr(sha256(concat_ws(':', '5', CAST(doc_id AS VARCHAR))), 1, 15)))::UBIGINT % 997)::BIGINT AS pick FROM documents")
def replacement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sampling.replacement(5, F.lit(997), "doc_id").alias("pick"))


AFFINE_STRIDE = BUCKET.format("concat('9:s:', CAST(doc_id // 101 AS VARCHAR))", 4)
AFFINE_START = BUCKET.format("concat('9:o:', CAST(doc_id // 101 AS VARCHAR))", 1000003)


@query(
    f"SELECT doc_id, ((start + stride * (doc_id % 101)) % 101)::BIGINT AS block FROM (SELECT doc_id, [2147483659, 2147483693, 2147483713, 2147483743][{AFFINE_STRIDE}::INTEGER + 1]::HUGEINT AS stride, {AFFINE_START}::HUGEINT AS start FROM documents)"
)
def affine_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw doc_id of blocks 0 .. 100, each block once an epoch."""
    return documents(spark, sf_dir).select("doc_id", splits.index_in_epoch(F.col("doc_id"), F.lit(101), 9).alias("block"))


@query("SELECT doc_id, CASE WHEN doc_id / 1000.0 < 0.6 THEN 'stable' ELSE 'anneal' END AS stage FROM documents")
def curriculum_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sampling.curriculum_stage(F.col("doc_id") / 1000.0, [("stable", 0.6), ("anneal", 1.0)]).alias("stage"))


@query(
    "SELECT doc_id, 0 AS epoch, draw FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '2', '0', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS draw FROM documents) WHERE draw < (SELECT count(*) + 30 FROM documents) UNION ALL SELECT doc_id, 1 AS epoch, draw FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '2', '1', CAST(doc_id AS VARCHAR))), doc_id) - 1 + (SELECT count(*) FROM documents) AS draw FROM documents) WHERE draw < (SELECT count(*) + 30 FROM documents)"
)
def deck_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 draws more than the deck holds: a whole epoch and the start of the next."""
    rows = documents(spark, sf_dir).select("doc_id")
    return sampling.deck(rows, "doc_id", rows.count() + 30, 2)


@query("SELECT source, min(n) FILTER (up > round_even((c - 1) * 0.5, 0)) AS median, min(n) FILTER (up > round_even((c - 1) * 0.9, 0)) AS p90, min(n) FILTER (up > round_even((c - 1) * 0.99, 0)) AS p99, max(n) AS longest FROM (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS up, count(*) OVER (PARTITION BY source) AS c FROM documents) GROUP BY source")
def doc_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles by half-even rounding, from histograms."""
    rows = documents(spark, sf_dir).select("source", F.length("text").cast("long").alias("n"))
    return audits.nearest_ranks(rows, ["source"], "n", {"median": 0.5, "p90": 0.9, "p99": 0.99, "longest": 1.0})


@query("SELECT source, count(*) AS rows, sum(length(text))::BIGINT AS chars, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS sha256 FROM documents GROUP BY source")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import manifest

    return manifest(documents(spark, sf_dir).withColumn("d", F.sha2("text", 256)), ["source"], "d")


@query(
    "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE source IN ('src1', 'src2')) WHERE before < 15000"
)
def eval_text_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of two sources, half of 30 000 characters each."""
    from ..sources.readers import tail_documents

    return tail_documents(documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", ["src1", "src2"], 30_000).select("doc_id", "source")


@query("SELECT key, n FROM (SELECT 'lang' AS key, count(*) AS n FROM (SELECT lang FROM documents WHERE source = 'src1' INTERSECT SELECT lang FROM documents WHERE source = 'src2') UNION ALL SELECT 'text', count(*) FROM (SELECT text FROM documents WHERE source = 'src1' INTERSECT SELECT text FROM documents WHERE source = 'src2'))")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each key two parts share."""
    docs = documents(spark, sf_dir)
    return splits.leaks(docs.where("source = 'src1'"), docs.where("source = 'src2'"), ["lang", "text"])


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def key_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.same_keys(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an earlier output (the labels) does not hold."""
    return dedup.resume(documents(spark, sf_dir).select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
