import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import language

STEMS = {"xx": "kor tan mel dus vek rin pol sag".split(), "yy": "élo üma ñai çou séa bué oià èru".split(), "zz": "shth wren bly cks ght dwa fro ply".split()}


def text(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


def slow_phrases(code, sample):
    """Phrases of longest matches, by plain search."""
    count, at = 0, 0
    while at < len(code):
        size = 0
        while at + size < len(code) and code[at : at + size + 1] in sample:
            size += 1
        count += 1
        at += size if size else 1
    return count


def test_automaton_accepts_exactly_the_factors():
    r = random.Random(0)
    sample = np.array([r.randrange(3) for _ in range(60)], np.uint8)
    to = language.suffix_automaton(sample, 3)
    factors = {bytes(sample[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(3000):
        word = bytes(r.randrange(3) for _ in range(r.randint(1, 7)))
        state = 1
        for c in word:
            state = to[state, c] if state else 0
        assert bool(state) == (word in factors)


def test_phrases_match_a_plain_parse():
    samples = {k: [text(k, i) for i in range(6)] for k in STEMS}
    parser = language.Parser(language.alphabet(samples), samples)
    texts = [text("xx", 99, 40), text("yy", 98, 30), "kor kor qqq"]
    counts, _ = parser.phrases(texts)
    for row, x in zip(counts, texts):
        code = bytes(language.symbols(x, parser.table))
        for k, lang in enumerate(parser.languages):
            sample = b"".join(bytes(language.symbols(t, parser.table)) + b"\x01" for t in samples[lang])
            state, n = b"", 1
            for c in code[: language.BLOCK]:
                one = bytes([c])
                if c != language.RARE and state + one in sample:
                    state += one
                    continue
                n += 1
                state = one if c != language.RARE and one in sample else b""
            assert row[k] == n


def corpus(spark, n=160):
    rows = [(i, text(list(STEMS)[i % 3], i), list(STEMS)[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = language.identify_documents(docs).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in held)


def test_predictions_ignore_labels_and_held_out_rows(spark):
    docs = corpus(spark)
    mixed = docs.withColumn("lang", F.when(language.held_out_column(), "yy").otherwise(F.col("lang")))
    pick = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_documents(d).collect())
    assert pick(docs) == pick(mixed)


def test_defined_cases(nasty, none, spark):
    got = {}
    for r in language.identify_documents(nasty).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[3][0]["lang_pred"] == got[4][0]["lang_pred"] == got[5][0]["lang_pred"] == "und" and len(got[8]) == 2
    assert got[6][0]["lang_pred"] in ("fr", "en") and len(got) == 15
    assert language.identify_documents(none).count() == 0
    unlabelled = nasty.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_documents(unlabelled).collect()} == {"und"}
    assert set(language.identify(nasty, language.learn(nasty)).columns) == set(nasty.columns)
