import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import budget, dedup, sampling, splits


def greedy(rows):
    kept, a_seen, b_seen = [], set(), set()
    for i, a, b in sorted(rows):
        if a not in a_seen and b not in b_seen:
            kept.append(i)
            a_seen.add(a)
            b_seen.add(b)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_two_key_dedup_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"a{rng.randrange(12)}", f"b{rng.randrange(12)}") for i in range(60)]
    frame = spark.createDataFrame(rows, "i long, a string, b string").repartition(3)
    assert sorted(r["i"] for r in dedup.two_key_dedup(frame, "a", "b", ["i"]).collect()) == greedy(rows)


def test_answer_cap_is_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, "s", f"p{rng.randrange(25)}", f"k{rng.randrange(6)}") for i in range(80)]
    prompts, used, want = set(), {}, []
    for i, s, p, k in rows:
        if p in prompts or used.get((s, k), 0) >= 3:
            continue
        prompts.add(p)
        used[(s, k)] = used.get((s, k), 0) + 1
        want.append(i)
    frame = spark.createDataFrame(rows, "i long, s string, p string, k string")
    assert sorted(r["i"] for r in dedup.answer_cap(frame, "p", "s", "k", 3, ["i"]).collect()) == want


def test_first_by_keeps_null_keys(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "i long, k string")
    assert sorted(r["i"] for r in dedup.first_by(rows, "k", ["i"]).collect()) == [1, 2, 4]


def test_reject_before_and_after_claims(spark):
    rows = spark.createDataFrame([(1, "x", "bad"), (2, "x", None), (3, "y", None)], "i long, k string, reject string")
    assert [r["i"] for r in dedup.dedup_after_reject(rows, "k", ["i"]).orderBy("i").collect()] == [2, 3]
    assert [r["duplicate"] for r in dedup.mark_duplicates(rows, "k", ["i"]).orderBy("i").collect()] == [False, True, False]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_prefix_sum_does_not_depend_on_partitions(spark, parts):
    rng = random.Random(0)
    rows = [(i, f"s{i % 2}", rng.randrange(10)) for i in range(200)]
    want, sums = {}, {}
    for i, s, n in rows:
        want[i] = sums.get(s, 0)
        sums[s] = want[i] + n
    frame = spark.createDataFrame(rows, "i long, s string, n int").repartition(parts)
    assert {r["i"]: r["before"] for r in budget.prefix_sum(frame, "s", ["i"], F.col("n")).collect()} == want


def test_budget_takes_the_last_row_whole(spark):
    frame = spark.createDataFrame([(i, "s", 10) for i in range(10)], "i long, s string, n int")
    assert sorted(r["i"] for r in budget.take_budget(frame, "s", ["i"], F.col("n"), F.lit(25)).collect()) == [0, 1, 2]
    assert sorted(r["i"] for r in budget.rotated_budget(frame, "s", ["i"], F.col("n"), F.lit(25), 8).collect()) == [0, 8, 9]
    taken = budget.repeat_to_quota(frame, "s", ["i"], F.col("n"), 215).collect()
    assert sum(r["taken"] for r in taken) == 215 and max(r["pass"] for r in taken) == 2


def test_circular_copy_is_exact(spark):
    pool = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5])], "i long, t array<int>")
    out, offset = budget.circular_copy(pool, ["i"], "t", 8, 3)
    pieces = [x for r in out.orderBy("pass", "i").collect() for x in r["piece"]]
    assert pieces == [4, 5, 1, 2, 3, 4, 5, 0] and offset == 1
    empty, same = budget.circular_copy(pool.limit(0), ["i"], "t", 8, 3)
    assert empty.count() == 0 and same == 3


def test_windows_and_segments(spark):
    row = spark.createDataFrame([(list(range(41)),)], "t array<int>").select(budget.fixed_windows(F.col("t"), 4).alias("w")).first()
    assert [w["offset"] for w in row["w"]] == list(range(0, 37, 4)) and row["w"][0]["y"] == [1, 2, 3, 4]
    stream = spark.createDataFrame([("f", i, t) for i, t in enumerate([5, 6, 0, 7, 0])], "f string, p long, t int")
    assert [(r["start"], r["size"]) for r in budget.segments(stream, "f", "p", "t").orderBy("document").collect()] == [(0, 3), (3, 2)]


def test_permutation_visits_each_block_once(spark):
    own = spark.range(303).select(splits.index_in_epoch(F.col("id"), F.lit(101), 4).alias("b"), (F.col("id") / 101).cast("int").alias("e"))
    assert [r["n"] for r in own.groupBy("e").agg(F.count_distinct("b").alias("n")).collect()] == [101, 101, 101]


def test_splits_are_stable_and_disjoint(spark):
    keys = spark.range(10000).select(F.col("id").cast("string").alias("k")).withColumn("s", splits.split_998(F.col("k")))
    assert {r["s"] for r in keys.select("s").distinct().collect()} == {"train", "val", "sealed"}
    pairs = spark.createDataFrame([(i, f"p{i % 10}") for i in range(50)], "i long, p string")
    split = splits.grouped_split(pairs, "p")
    assert split.groupBy("p").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        splits.grouped_split(pairs.limit(5), "p")


def test_stratified_sample_covers_and_refuses(spark):
    rows = spark.createDataFrame([(i, f"o{i % 3}", f"d{i % 2}") for i in range(60)], "i long, o string, d string")
    got = sampling.stratified(rows, "o", "d", "i", 12, 1).collect()
    assert len(got) == 12 and {(r["o"], r["d"]) for r in got} == {(f"o{a}", f"d{b}") for a in range(3) for b in range(2)}
    for bad in (0, 61, 5):
        with pytest.raises(ValueError):
            sampling.stratified(rows, "o", "d", "i", bad, 1)


def test_deck_and_mixture(spark):
    rows = spark.range(7).withColumnRenamed("id", "i")
    draws = sampling.deck(rows, "i", 17, 3).collect()
    assert sorted(d["draw"] for d in draws) == list(range(17))
    assert all(len({d["i"] for d in draws if d["epoch"] == e}) == 7 for e in (0, 1))
    mixed = sampling.mixture(spark.range(4000), {"a": 1.0, "b": 3.0}, 1, "id").groupBy("source").count().collect()
    assert abs({r["source"]: r["count"] for r in mixed}["b"] - 3000) < 150
