import zlib

import numpy as np
import pytest

from corpusloom.llm import token_store
from corpusloom.llm.catalog import tokenizer_path

pytest.importorskip("tokenizers")
PATH = tokenizer_path()


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_text_s_ids():
    own = token_store.WordEncoder(PATH)
    odd = ["", " ", "A. B, <|endoftext|> x", "İstanbul É. ×. ÷, ñ. don't WE'LL 12.5 a\tb\r\nc", "́x y.", "%%%, ,.. ß. ﬁ.", "Σίσυφος. ς", "中文。中文, 日本.", "x" * 5000, "a b c.", "﻿x"]
    for _ in range(2):
        for text, got in zip(odd, own.encode_all(odd)):
            assert got.tolist() == ids_of(text)[:-1], text


def test_words_under_one_hash_keep_their_own_ids(monkeypatch):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    pair = [word, word.translate(str.maketrans("ab", "ba")), f"{word} x {word}."]
    own = token_store.WordEncoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in own.encode_all(pair)] == [ids_of(x)[:-1] for x in pair]
    real = token_store.span_hashes
    monkeypatch.setattr(token_store, "span_hashes", lambda data, a, b: real(data, a, b) & np.uint64(0xFF))
    own._forget()
    crowd = ["the quick brown fox. don't, go. " + " ".join(f"w{i}x" for i in range(3000)), "the fox w7x w9x w2999x"]
    for _ in range(2):
        assert [x.tolist() for x in own.encode_all(crowd)] == [ids_of(x)[:-1] for x in crowd]


def test_ids_of_a_whole_table_are_the_library_s():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    own = token_store.WordEncoder(PATH)
    for at in range(0, len(texts), 500):
        part = [x or "" for x in texts[at : at + 500]]
        assert all(np.array_equal(a, b) for a, b in zip(own.encode_all(part), own.library(part)))


def test_cuts_cover_the_stream_and_follow_the_content():
    rng = np.random.default_rng(1)
    table = token_store.gear(50_000)
    ids = rng.integers(0, 50_000, 20_000)
    ends = token_store.cuts(ids, table)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MAX_IDS and sizes[:-1].min() >= token_store.MIN_IDS
    moved = [e - 37 for e in token_store.cuts(np.concatenate([rng.integers(0, 50_000, 37), ids]), table)]
    assert len(set(moved) & set(ends)) > 0.8 * len(ends)
    assert token_store.cuts(ids[:1], table) == [1]


def test_checksums_join():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 64, 300, 1024)]
    assert token_store.join_crcs([(zlib.crc32(p.tobytes()), len(p)) for p in parts]) == zlib.crc32(np.concatenate(parts).tobytes())
    assert token_store.join_crcs([]) == 0


def test_store_round_trip(nasty, none):
    store = token_store.build_store(nasty, PATH)
    rows = sorted(token_store.verify_store(store, PATH).collect(), key=lambda r: r["start"])
    want = [(r["doc_id"], ids_of(r["text"])) for r in nasty.select("doc_id", "text").collect()]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert all(r["verified"] for r in rows)
    keys = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    back = sorted((str(r["doc_id"]), r["ids"]) for r in token_store.reconstruct(store, PATH).collect())
    assert back == sorted((str(i), x) for i, x in want)
    digests = [bytes(r["digest"]) for r in store["chunks"].collect()]
    assert len(digests) == len(set(digests))
    assert sum(r["documents"] for r in store["manifest"].collect()) == len(want)
    empty = token_store.build_store(none, PATH)
    assert token_store.verify_store(empty, PATH).count() == 0


def test_lost_and_repeated_recipes_are_noticed(nasty):
    store = token_store.build_store(nasty.where("doc_id >= 0"), PATH)
    recipes = store["recipes"]
    lost = dict(store, recipes=recipes.where("doc_id <> 8"))
    hit = {r["part"] for r in recipes.where("doc_id = 8").collect()}
    assert {r["part"] for r in token_store.sound_parts(lost).where("not kept").collect()} == hit
    bad = {r["doc_id"] for r in token_store.verify_store(lost, PATH).where("not verified").collect()}
    assert bad == {r["doc_id"] for r in recipes.collect() if r["part"] in hit and r["doc_id"] != 8}
    again = dict(store, recipes=recipes.unionByName(recipes.where("doc_id = 0")))
    assert not any(r["verified"] for r in token_store.verify_store(again, PATH).where("doc_id = 0").collect())


def test_altered_chunks_are_noticed(nasty):
    from pyspark.sql import functions as F

    store = token_store.build_store(nasty.where("doc_id in (0, 10)"), PATH)
    bad = dict(store, chunks=store["chunks"].withColumn("data", F.reverse(F.col("data").cast("string")).cast("binary")))
    assert not any(r["verified"] for r in token_store.verify_store(bad, PATH).collect())
    lost = dict(store, chunks=store["chunks"].limit(0))
    assert [r["ids_crc32"] for r in token_store.verify_store(lost, PATH).collect()] == [None, None]
