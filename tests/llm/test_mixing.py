import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing as M
from tests.llm.conftest import prose

GOOD, BAD = "soleil chemin village arbre maison parle".split(), "zut berk nul sale moche pire".split()


def corpus(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        rows.append((i, prose(i, 40 + i % 50, BAD if toxic else GOOD)))
        if i % 2:
            labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = M.mixed(docs, labels).select("doc_id", "domain").collect()
    right = sum((r["domain"] == "quality1-toxic1") == (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] % 2 == 0)
    assert right >= 0.98 * sum(r["doc_id"] % 2 == 0 for r in got)


@pytest.mark.parametrize("targets", [[0.5, 0.5], [0.9, 0.1], [0.1, 0.9]])
def test_rates_meet_reachable_targets(spark, targets):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5, 0.8], 400)
    rows = [(int(t), x.tolist()) for t, x in zip(rng.integers(1, 500, 400), p)]
    members = spark.createDataFrame(rows, "tokens long, posterior array<double>").repartition(3)
    steps, totals, wanted = M.fit_rates(members, targets, 2)
    assert np.allclose(totals, wanted, rtol=1e-4)
    rate = np.ones(400)
    for s in steps:
        rate = np.maximum(0, rate - p @ np.array(s))
    again = [r["r"] for r in members.coalesce(1).select(M.rate_column(steps, 2).alias("r"), "tokens").collect()]
    assert np.allclose(sorted(again), sorted(rate)) and rate.min() >= 0


def test_unreachable_targets_come_as_near_as_least_squares(spark):
    members = spark.createDataFrame([(100, [0.5, 0.5])] * 20, "tokens long, posterior array<double>")
    _, totals, wanted = M.fit_rates(members, [0.9, 0.1], 2)
    assert abs(sum(totals) - sum(wanted)) < 1e-3 * sum(wanted)


def plain_descent(tokens, p, wanted, rounds=200_000):
    """Least-squares distance over nonnegative rates, by accelerated projected gradients in numpy."""
    a = (p * tokens[:, None]).T / np.sqrt(tokens)
    step, x = 1 / np.linalg.norm(a, 2) ** 2, np.sqrt(tokens)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - wanted)))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return float(np.linalg.norm(a @ x - wanted))


@pytest.mark.parametrize("case", ["nearly collinear", "out of reach", "one domain unwanted"])
def test_rates_are_a_least_squares_solution(spark, case):
    rng = np.random.default_rng(3)
    n = 120
    p = rng.dirichlet([0.5, 0.8, 0.4], n)
    targets = [0.6, 0.3, 0.1]
    if case == "nearly collinear":
        p = 0.02 * p + 0.98 * np.array([0.5, 0.3, 0.2])
        targets = [0.502, 0.299, 0.199]
    if case == "out of reach":
        p = 0.2 * p + 0.8 * np.array([0.4, 0.3, 0.3])
        targets = [0.0, 0.05, 0.95]
    if case == "one domain unwanted":
        targets = [0.7, 0.3, 0.0]
    tokens = rng.integers(1, 500, n)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>").coalesce(1)
    fit = M.optimise(members, targets, 3)
    best = plain_descent(tokens.astype(float), p, np.array(fit.wanted), 20_000)
    assert np.linalg.norm(np.array(fit.totals) - fit.wanted) <= best + 1e-3 * sum(fit.wanted)
    assert fit.residual <= 1e-3 * tokens.sum()


def test_copies_have_the_rate_as_their_mean(spark):
    n = M.copies(F.lit(1.3), "id")
    got = spark.range(20_000).select(n.alias("n")).agg(F.avg("n").alias("m"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert abs(got["m"] - 1.3) < 0.02 and (got["a"], got["b"]) == (1, 2)
    assert spark.range(50).select(M.copies(F.lit(0.9995), "id").alias("n")).distinct().collect()[0]["n"] == 1


def test_defined_cases(spark, nasty, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (7, 0, None), (12, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = M.mixed(nasty, labels, keep=True)
    assert set(nasty.columns) <= set(got.columns) and got.count() == nasty.count()
    rows = got.collect()
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-6 for r in rows)
    assert {r["tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert M.mixed(none, labels).count() == 0
    alone = M.mixed(nasty, labels.limit(0)).collect()
    assert {r["domain"] for r in alone} == {"all"} and {r["rate"] for r in alone} == {1.0}
    assert M.apply_rates(got, ["doc_id", "text"]).columns == ["doc_id", "text"]
