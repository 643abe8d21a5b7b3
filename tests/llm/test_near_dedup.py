import random
import re

import numpy as np

from corpusloom.llm import near_dedup as N
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def classes(groups):
    out = {}
    for key, member in groups:
        out.setdefault(key, []).append(member)
    return sorted(sorted(x) for x in out.values())


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"neuf{rng.randrange(10**6)}"
    return " ".join(words)


def test_registers_agree_as_the_similarity():
    elements = np.arange(1, 6, dtype=np.uint64) * np.uint64(7919)
    a, b = np.array([1, 2, 3, 4, 5.0]), np.array([5, 4, 3, 2, 1.0])
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(5))
    got = N.prob_min_hash([elements, elements], [a, b], 20_000)
    assert abs((got[0] == got[1]).mean() - want) < 0.02
    many = [np.unique(np.random.default_rng(k).integers(1, 2**63, 300).astype(np.uint64)) for k in (0, 1)]
    many[1] = np.unique(np.concatenate([many[0][:200], many[1][:100]]))
    share = len(np.intersect1d(*many)) / len(np.union1d(*many))
    got = N.prob_min_hash(many, [np.ones(len(x)) for x in many], 8000)
    assert abs((got[0] == got[1]).mean() - share) < 0.03
    # The same set gives the same registers whatever is sketched beside it.
    assert (N.prob_min_hash([many[0]], [np.ones(len(many[0]))], 240) == N.prob_min_hash(many, [np.ones(len(x)) for x in many], 240)[0]).all()


def test_shingles_match_plain_words():
    texts = ["A b C d e f", "a b c", "", None, "é È 9 x-y z_w", prose(1, 400)]
    for x, (found, counts) in zip(texts, N.shingle_sets(texts)):
        assert len(found) == len(shingles(x))
    assert (N.shingle_sets(["A b c d e"])[0][0] == N.shingle_sets(["a, B! c d e."])[0][0]).all()


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = prose(100 + g, 150)
        rows.append(base)
        for _ in range(rng.randrange(8)):
            rows.append(edited(base, rng, rng.randrange(12)))
        rows.append(base)
    chain = prose(500, 200)
    for _ in range(10):  # each link is near its neighbour, the ends are far apart
        rows.append(chain)
        chain = edited(chain, rng, 3)
    rows = list(enumerate(rows))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert classes((r["class_id"], r["doc_id"]) for r in got) == classes(zip(brute(rows), (i for i, _ in rows)))
    assert all(r["class_id"] <= r["doc_id"] for r in got) and all(r["representative"] == (r["class_id"] == r["doc_id"]) for r in got)


def test_a_large_group_of_uneven_copies(spark):
    rng = random.Random(5)
    base = prose(900, 120)
    rows = [(i, edited(base, rng, rng.randrange(9))) for i in range(150)] + [(1000 + i, prose(2000 + i, 60)) for i in range(30)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes(zip(brute(rows), (i for i, _ in rows)))
    assert classes((r["class_id"], r["doc_id"]) for r in got) == want


def test_blocks_and_hot_keys_change_nothing(spark, monkeypatch):
    from corpusloom.llm import common

    rng = random.Random(8)
    origins = [prose(40, 100)]
    for _ in range(60):  # a chain of texts: buckets with many classes
        origins.append(edited(origins[-1], rng, 4))
    rows = list(enumerate(origins + [origins[0]] * 40))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = classes(zip(brute(rows), (i for i, _ in rows)))
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    got = N.near_duplicates(frame).collect()
    assert classes((r["class_id"], r["doc_id"]) for r in got) == want and len(got) == len(rows)
    assert all(r["representative"] == (r["class_id"] == r["doc_id"]) for r in got)


def test_the_gate_follows_the_threshold(spark):
    assert [N.gate(t) for t in (0.8, 0.75, 0.7)] == [158, 143, 130]
    for threshold, equal in ((0.8, 160), (0.7, 140)):
        elements = np.sort(np.random.default_rng(9).integers(1, 2**63, 110).astype(np.uint64))
        common = round(200 * threshold / (1 + threshold)) + 1
        x, y = elements[:100], np.sort(np.concatenate([elements[:common], elements[100:]]))
        one, two = np.arange(240, dtype="<u2"), np.arange(240, dtype="<u2")
        two[equal:] += 1000
        members = spark.createDataFrame([(5, 0, 1), (5, 0, 2)], "key long, band int, uid long")
        labels = spark.createDataFrame([(1, 1), (2, 2)], "uid long, label long")
        registers = spark.createDataFrame([(1, bytearray(one.tobytes())), (2, bytearray(two.tobytes()))], "uid long, registers binary")
        sets = spark.createDataFrame([(1, bytearray(N.pack_set(x))), (2, bytearray(N.pack_set(y)))], "uid long, shingles binary")
        assert N.linked(N.pack_set(x), N.pack_set(y), threshold)
        assert [(r["a"], r["b"]) for r in N.open_links(members, labels, registers, sets, threshold).collect()] == [(1, 2)]


def test_defined_cases(nasty, none):
    got = {}
    for r in N.near_duplicates(nasty).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["class_id"] == got[2][0]["class_id"] == 0 and got[11][0]["class_id"] == 10
    assert got[3][0]["class_id"] == 3 and got[4][0]["class_id"] == 4 and len(got[8]) == 2 and sum(r["representative"] for r in got[8]) == 1
    assert got[None][0]["class_id"] is None and got[2**60 + 1][0]["class_id"] == 2**60 + 1
    assert N.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in N.keep_representatives(nasty).collect()]
    assert sorted(str(x) for x in kept) == sorted(["0", "3", "4", "5", "6", "7", "8", "None", str(2**60 + 1), "10", "12", "-5"])
    assert N.keep_representatives(nasty).columns == nasty.columns
