"""The pipeline's stages against plain Python stages over a small corpus."""

import random

import corpus_pipeline as P
from corpusloom.llm import mixing
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_near_dedup import edited
from tests.llm.test_token_store import ids_of

SPANISH = "camino pueblo noche cuando viene tarde árbol señor niña agua fuego tierra".split()


def corpus(folder, spark):
    rng = random.Random(1)
    rows = []
    for i in range(90):
        text = prose(i, 30 + i % 40, SPANISH) if i % 2 else prose(i, 30 + i % 40)
        rows.append((text, "es" if i % 2 else "fr"))
        if i % 9 == 0:
            rows.append((text, "fr"))
            rows.append((edited(text, rng, 1), None))
    item = prose(5000, 25)
    rows += [("x " + item[:120] + " y", "fr"), (item, "fr"), ("123 !!! 456", "fr"), ("", None), (None, "es")]
    docs = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, len(docs), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, [(0, item)]


def test_stages_follow_each_other(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = corpus(folder, spark)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns

    one = P.language_stage(spark, frame, folder).cache()
    kept = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == [d[0] for d in kept] and one.where("lang is null").count() == 0

    two = P.near_duplicate_stage(spark, one, folder).cache()
    first = groups([(d[0], d[1]) for d in kept])
    kept = [d for k, d in enumerate(kept) if first[k] == k]
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == [d[0] for d in kept]

    three = P.decontamination_stage(spark, two, folder).cache()
    hit = {r[0] for r in leaks([(d[0], d[1]) for d in kept], items) if r[5]}
    assert len(hit) == 2
    kept = [d for d in kept if str(d[0]) not in hit]
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == [d[0] for d in kept]

    four = P.mixing_stage(spark, three, folder)
    rates = {r["doc_id"]: r["n"] for r in mixing.mixed(three, spark.read.parquet(f"{folder}/labels.parquet"), P.MIXTURE).select("doc_id", mixing.copies(mixing.F.col("rate")).alias("n")).collect()}
    mixed = [d for d in kept for _ in range(rates[d[0]])]
    assert four.columns == columns and sorted(r["doc_id"] for r in four.collect()) == [d[0] for d in mixed]

    five = P.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in five) == [(d[0], len(ids_of(d[1]))) for d in mixed] and all(r["verified"] for r in five)


def test_an_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    frame = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        frame = stage(spark, frame, folder)
        assert frame.count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path, nasty):
    """Each stage on nulls, ties, repeated rows and columns with the operators' own names, which come through as they are."""
    folder = str(tmp_path)
    corpus(folder, spark)
    frame = nasty.selectExpr("*", "'i' as _id", "'m' as _n", "'c' as _c", "'h' as h", "'k' as key1")
    texts = {(r["doc_id"], r["text"]) for r in frame.collect()}
    for name, stage in P.STAGES[:-1]:
        frame = P.materialize(stage(spark, frame, folder), f"test-{name}")
        assert frame.columns[:5] == nasty.columns[:5] and frame.columns[-5:] == ["_id", "_n", "_c", "h", "key1"], name
        rows = frame.collect()
        assert rows and {(r["doc_id"], r["text"]) for r in rows} <= texts, name
        assert {(r["_id"], r["_n"], r["_c"], r["h"], r["score"], r["tokens"], r["rate"], r["lang_pred"]) for r in rows} == {("i", "m", "c", "h", "clash", "clash", "clash", "clash")}, name
        if name != "language":
            assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows) or name == "mixing"
    out = P.STAGES[-1][1](spark, frame, folder).collect()
    assert len(out) == frame.count() and all(r["verified"] for r in out)
