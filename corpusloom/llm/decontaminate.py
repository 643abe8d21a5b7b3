"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased. A window is WINDOW
consecutive words of an item, or the whole item where it has fewer (but not none). Document words inside
any occurrence of a window are hit.

Each distinct window is entered in a hash set under one of its words, its anchor: the longest, then the
last in order. Documents are scanned for anchor words; around each find, the words at the window's place
are compared with the window itself, so every hit is verified word by word. The window set is broadcast
only while its measured size is at most BROADCAST_BYTES; beyond it the same join shuffles, which AQE
splits where an anchor is hot.

Defined results: a null or empty text has no words and no hit; a null item_id counts as the string "";
repeated items and rows each count; an empty benchmark hits nothing; ties of anchors follow string order;
other columns are not read and come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, back, materialize, written_ids

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Measured bytes of the window set up to which it is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Distinct anchor words up to which the scan holds them as a literal hash set.
LITERAL_ANCHORS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(anchor, offset, len, window, items): each distinct window once, with the items that hold it."""
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1))), lambda i: F.slice("w", i, size))
    each = listed.select("item", F.explode(cut).alias("window"))
    own = each.groupBy("window").agg(F.collect_set("item").alias("items"))
    ranked = F.array_max(F.transform("window", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))
    found = own.select("window", "items", ranked["x"].alias("anchor"))
    return found.select(
        "anchor", (F.array_position("window", F.col("anchor")) - 1).cast("int").alias("offset"), F.size("window").alias("len"), "window", "items"
    )


def _by_anchor(set_of: DataFrame) -> DataFrame:
    """One row an anchor: its windows, numbered, with their place and words."""
    return set_of.groupBy("anchor").agg(F.collect_list(F.struct("offset", "len", "window", "items")).alias("entries"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, hits) for each row of docs, hits being its verified occurrences
    struct(start, len, items), start counted in words from 0."""
    found = materialize(windows(benchmark, size), "windows")
    bound = found.agg(F.sum(F.length(F.array_join("window", " ")) + F.length(F.array_join("items", ",")) + 40).alias("bytes"), F.count_distinct("anchor").alias("anchors")).first()
    small = (bound["bytes"] or 0) <= BROADCAST_BYTES
    entries = _by_anchor(found)
    anchors = None
    if small and bound["anchors"] <= LITERAL_ANCHORS:
        anchors = [r["anchor"] for r in found.select("anchor").distinct().collect()]

    # A row number inside the scan, so that rows with equal keys stay apart without another pass.
    base = docs.select("doc_id", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    places = F.transform("w", lambda x, i: F.when(x.isin(anchors), i).otherwise(F.lit(-1)) if anchors is not None else i)
    places = F.filter(places, lambda i: i >= 0) if anchors != [] else F.array().cast("array<int>")
    # Only the words that a window around the find can reach leave the row.
    around = F.transform(
        places, lambda i: F.struct(i.alias("i"), F.least(i, F.lit(size - 1)).alias("left"), F.element_at("w", i + 1).alias("anchor"), F.slice("w", F.greatest(i - (size - 2), F.lit(1)), 2 * size - 1).alias("near"))
    )
    scanned = base.select("doc_id", "row", F.size("w").alias("n_words"), F.explode_outer(around).alias("f"))
    flat = scanned.select("doc_id", "row", "n_words", "f.i", "f.left", "f.anchor", "f.near")
    joined = flat.join(F.broadcast(entries) if small else entries, "anchor", "left")
    true = F.filter(
        F.coalesce("entries", F.array().cast(entries.schema["entries"].dataType)),
        lambda e: (e["offset"] <= F.col("left")) & (F.slice("near", F.greatest(F.col("left") - e["offset"] + 1, F.lit(1)), e["len"]) == e["window"]),
    )
    kept = F.transform(true, lambda e: F.struct((F.col("i") - e["offset"]).alias("start"), e["len"].alias("len"), e["items"].alias("items")))
    verified = joined.select("doc_id", "row", "n_words", kept.alias("h"))
    gathered = verified.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list(F.when(F.size("h") > 0, F.col("h"))).alias("h"))
    # A window stands at one place of its anchor, and windows are distinct: no occurrence comes twice.
    return gathered.select("doc_id", "n_words", F.flatten("h").alias("hits"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where `use` names it for each element of something."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(hits: Column) -> Column:
    """The disjoint runs of hit words, struct(s, e) with e exclusive, of occurrences; runs that touch are one."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))))

    def runs(p: Column) -> Column:
        first = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    return _bound(places, runs)


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    found = occurrences(docs, benchmark, size)
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select("doc_id", F.col("n_words").cast("long"), hit.cast("long").alias("n_hit"), items.alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, size: int = WINDOW) -> DataFrame:
    """docs without the rows whose share of hit words is above `share` (0: any hit); rows with one doc_id go together."""
    hit = report(docs, benchmark, size).where("contaminated").where(F.col("n_hit") > F.col("n_words") * F.lit(share))
    marked = written_ids(hit.select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    rows, names = aside(docs, "doc_id", "text")
    return back(rows.join(marked, rows["doc_id"].eqNullSafe(F.col("_id")), "left_anti"), names, docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the hit words, and what stands between two words of one run, cut from the text.

    Pieces are the gaps and the words in turn, from the gap before the first word to the one after the last; the text
    is put together from those outside the runs. A text without hits is returned as it is."""
    rows, names = aside(docs, "doc_id", "text")
    text = F.struct("doc_id", F.sha2("text", 256).alias("digest"))
    found = occurrences(rows.select(text.alias("doc_id"), "text"), benchmark, size).where(F.size("hits") > 0)
    runs = found.select(F.col("doc_id").alias("_key"), spans(F.col("hits")).alias("_runs")).groupBy("_key").agg(F.first("_runs").alias("_runs"))
    joined = rows.join(runs, text.eqNullSafe(F.col("_key")), "left")
    gaps, own = F.split("text", ANY_WORD, -1), F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0))
    pieces = F.flatten(F.zip_with(gaps, own, lambda g, w: F.array(g, F.coalesce(w, F.lit("")))))

    def outside(p: Column) -> Column:
        # Word i is piece 2 i + 1 from 0; what stays begins behind a run's last word and ends before the next one's first.
        starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: 2 * r["e"]))
        ends = F.concat(F.transform("_runs", lambda r: 2 * r["s"] + 1), F.array(F.size(p)))
        return F.array_join(F.zip_with(starts, ends, lambda b, e: F.array_join(F.slice(p, b + 1, F.greatest(e - b, F.lit(0))), "")), "")

    cut = F.when(F.col("_runs").isNotNull(), _bound(pieces, outside)).otherwise(F.col("text"))
    return back(joined.withColumn("text", cut), names, docs)


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
scan AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM base, sizes WHERE len(w) >= n)),
hit AS (SELECT s.row, s.i, s.n, v.item FROM scan s JOIN win v ON s.x = v.x AND s.n = v.n),
covered AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row, i, n FROM hit)) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM base LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
