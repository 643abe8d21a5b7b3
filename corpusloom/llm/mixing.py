"""Mixing documents to target weights with soft domain membership.

A linear softmax classifier over hashed words, fitted on a bounded sample of labelled rows, gives every
document posteriors over domains. Document rates r >= 0 then minimise the squared distance between the
expected domain token totals, sum of r x tokens x posterior, and the targets, by projected gradient: each
pass over the documents returns the K totals and the K x K Gram matrix of those with positive rate, and no
rate is ever stored between passes, since a document's rate follows from its posteriors and the K numbers of
each step.

Bounded fit: SAMPLE_ROWS labelled rows by a hash of their key, whole texts, FEATURES hashed features.

Defined results: a null or empty text has the classifier's prior and no tokens; rows without a label are not
learnt from; repeated ids of the label table count once, with the least label; a domain without any
expected token cannot be met and is left out of the targets, the others share its weight; with no label at
all there is the one domain `all`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .near_dedup import word_hashes

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
SAMPLE_ROWS = 4000
#: Longest labelled text of the sample, in characters: longer rows are not learnt from.
SAMPLE_CHARS = 20_000
EPOCHS, RATE, PENALTY = 60, 0.5, 1e-4
#: Passes of the rate fit at most, the share of all tokens that a residual may be (`Fit` says what is left), and the
#: inverse length of a step in units of the plain one.
ROUNDS, TOLERANCE, PROXIMITY = 40, 1e-6, 1e-7

#: Domains of the label table and the shares of the tokens that the mixture is to have.
TARGETS = {"quality1-toxic0": 0.88, "quality0-toxic0": 0.06, "quality1-toxic1": 0.05, "quality0-toxic1": 0.01}


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value, tokens by row): square roots of hashed word counts, rows of length 1."""
    rows, ids, values, tokens = [], [], [], np.zeros(len(texts), np.int64)
    for k, x in enumerate(texts):
        data = np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8) if isinstance(x, str) else np.zeros(0, np.uint8)
        _, hashes = word_hashes(data)
        tokens[k] = len(hashes)
        own, count = np.unique(hashes >> np.uint64(64 - FEATURE_BITS), return_counts=True)
        value = np.sqrt(count)
        rows.append(np.full(len(own), k))
        ids.append(own.astype(np.int64))
        values.append(value / max(1e-9, np.sqrt((value**2).sum())))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float), tokens
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values), tokens


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_classifier(texts: list[str | None], labels: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, weights, biases) of a softmax regression by full-batch gradients with momentum."""
    domains = sorted(set(labels))
    if not domains:
        return ["all"], np.zeros((FEATURES, 1), np.float32), np.zeros(1)
    row, feature, value, _ = features(texts)
    target = np.zeros((len(labels), len(domains)))
    target[np.arange(len(labels)), [domains.index(x) for x in labels]] = 1
    share = target.mean(axis=0)
    weights, bias = np.zeros((FEATURES, len(domains))), np.log(share)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(EPOCHS):
        score = np.stack([np.bincount(row, value * weights[feature, k], len(labels)) for k in range(len(domains))], axis=1) + bias
        error = (_softmax(score) - target) / len(labels)
        slope = np.stack([np.bincount(feature, value * error[row, k], FEATURES) for k in range(len(domains))], axis=1) + PENALTY * weights / len(labels)
        speed_w = 0.9 * speed_w - RATE * len(domains) * 10 * slope
        speed_b = 0.9 * speed_b - RATE * error.sum(axis=0)
        weights, bias = weights + speed_w, bias + speed_b
    return domains, weights.astype(np.float32), bias


def learn(docs: DataFrame, labels: DataFrame, label: Column, key: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The classifier of the labelled rows of docs."""
    named = labels.select(F.col(key).alias("_id"), label.alias("label")).where("label is not null and _id is not null")
    named = named.groupBy("_id").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64("_id"))
    count = named.count()
    reach = min(1.0, 2.0 * SAMPLE_ROWS / max(1, count))
    near = named.where(F.pmod("h", F.lit(1 << 30)) <= int(reach * (1 << 30))).orderBy("h", "_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(key).alias("_id"), "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(near), "_id")
    rows = rows.dropDuplicates(["_id"]).select("h", "_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["h"], r["_id"]))
    return fit_classifier([r["text"] for r in rows], [r["label"] for r in rows])


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs with tokens (words) and posterior, an array in the order of the model's domains."""
    domains, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kept = docs.drop("tokens", "posterior")
    schema = T.StructType([*kept.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w, b = shared.value
        for batch in batches:
            row, feature, value, tokens = features(batch.column(batch.schema.get_field_index("text")).to_pylist())
            score = np.stack([np.bincount(row, value * w[feature, k], len(tokens)) for k in range(len(b))], axis=1) + b
            found = np.round(_softmax(score), 9)
            arrays = [*batch.columns, pa.array(tokens, pa.int64()), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "tokens", "posterior"])

    return kept.mapInArrow(run, schema)


def rate_column(steps: list[list[float]], k: int) -> Column:
    """A document's rate after these steps: from 1, less its posteriors times each step, never below 0."""
    if not steps:
        return F.lit(1.0)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: sum((F.element_at("posterior", i + 1) * F.element_at(s, i + 1) for i in range(k)), F.lit(0.0))
    return F.aggregate(rows, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


class Fit(NamedTuple):
    """Steps that give the rates, expected and wanted domain totals, and how far the rates are from a least-squares
    solution, in tokens: the length of the projected gradient in the metric of the plain step."""

    steps: list[list[float]]
    totals: list[float]
    wanted: list[float]
    residual: float


def optimise(members: DataFrame, targets: list[float] | None, k: int, total: float | None = None) -> Fit:
    """Nonnegative rates of members (tokens, posterior) whose domain totals are nearest to the targets.

    `targets` are shares of the `total` tokens; without a total it is the one that takes the tokens of the
    domain with the largest share once on average, and the others as often as the shares then ask.

    Steps are projected-gradient steps of a great length in their implicit form, r' = max(0, r - p . s) with
    s = (totals of r' - targets) / (PROXIMITY x L), L being the largest eigenvalue of the Gram matrix. The K numbers s
    are the minimum of a convex function, which damped Newton rounds find: a round is one pass that returns value, totals
    and Gram matrix at four lengths. After a step the plain one, of length 1 / L, is measured: the rates are optimal
    where it moves none of them, wherever the targets are."""
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(trials: list[list[list[float]]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(half the squared rates by tokens, domain totals, Gram matrix of the documents with positive rate) of each."""
        rates = members.select("tokens", "posterior", *[rate_column(steps, k).alias(f"r{n}") for n, steps in enumerate(trials)])
        t, columns = F.col("tokens").cast("double"), []
        for n in range(len(trials)):
            r = F.col(f"r{n}")
            columns += [F.sum(t * r * r).alias(f"v{n}"), *[F.sum(t * r * p[i]).alias(f"s{n}_{i}") for i in range(k)]]
            columns += [F.sum(F.when(r > 0, t * p[i] * p[j])).alias(f"g{n}_{i}_{j}") for i, j in pairs]
        found = {x: y or 0.0 for x, y in rates.agg(*columns).first().asDict().items()}
        gram = lambda n: np.array([[found[f"g{n}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return [(found[f"v{n}"] / 2, np.array([found[f"s{n}_{i}"] for i in range(k)]), gram(n)) for n in range(len(trials))]

    def moved(before: list[list[float]], after: list[list[float]]) -> float:
        change = rate_column(before, k) - rate_column(after, k)
        return float(members.select(change.alias("d"), "tokens").agg(F.sum(F.col("tokens") * F.col("d") * F.col("d"))).first()[0] or 0.0)

    steps: list[list[float]] = []
    ((value, mass, gram),) = measure([steps])
    share = np.array(targets if targets is not None else [1.0] * k, float)
    share = np.where(mass > 0, np.maximum(share, 0), 0)
    if not share.sum() or not mass.sum():
        return Fit([], mass.tolist(), mass.tolist(), 0.0)
    share /= share.sum()
    size = total if total is not None else float(mass[share.argmax()] / share.max())
    wanted, totals = share * size, mass
    steepest, tolerance = float(np.linalg.eigvalsh(gram)[-1]), TOLERANCE * mass.sum()
    near, residual, passes = PROXIMITY * steepest, float(np.linalg.norm(totals - wanted)), 0
    while residual > tolerance and passes < ROUNDS:
        s = np.zeros(k)
        while passes < ROUNDS:
            slope = wanted + near * s - totals
            if np.linalg.norm(slope) <= tolerance / 10:
                break
            way = np.linalg.solve(gram + near * np.eye(k), slope)
            tried = [s - part * way for part in (1.0, 0.5, 0.25, 0.0625)]
            found = measure([[*steps, x.tolist()] for x in tried])
            passes += 1
            values = [v + float(wanted @ x) + near / 2 * float(x @ x) for (v, _, _), x in zip(found, tried)]
            best = int(np.argmin(values))
            if values[best] >= value + float(wanted @ s) + near / 2 * float(s @ s):
                break  # as near as sums of doubles tell
            s, (value, totals, gram) = tried[best], found[best]
        if not s.any():
            break
        steps = [*steps, s.tolist()]
        error = totals - wanted
        residual = min(float(np.linalg.norm(error)), math.sqrt(steepest * moved(steps, [*steps, (error / steepest).tolist()])))
        passes += 1
    return Fit(steps, totals.tolist(), wanted.tolist(), residual)


def fit_rates(members: DataFrame, targets: list[float] | None, k: int, total: float | None = None) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps, expected domain totals, wanted totals) of `optimise`."""
    return optimise(members, targets, k, total)[:3]


def domain_label() -> Column:
    """The domain of a row of the label table; null without both labels."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("-toxic"), F.col("toxic").cast("string"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, keep: bool = False) -> DataFrame:
    """Every row of docs (its doc_id, or with `keep` all its columns) with tokens, domain, posterior and rate; without
    `keep` also its domain's wanted and attained tokens and the fit's residual, the same for all rows of a domain.
    Ties of posteriors go to the domain first in order."""
    model = learn(docs, labels, domain_label())
    domains = model[0]
    scored = posteriors(docs.select(*([f"`{c}`" for c in docs.columns] if keep else ["doc_id", "text"])), model)
    members = materialize(scored.select("tokens", "posterior", *([] if keep else ["doc_id"])), "members")
    # Domains that the targets do not name are not wanted: they have weight 0.
    shares = [targets.get(d, 0.0) for d in domains] if any(d in targets for d in domains) else None
    fit = optimise(members, shares, len(domains), total)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), best)
    rated = scored if keep else members.select("doc_id", "tokens", "posterior")
    rated = rated.withColumn("domain", pick(domains)).withColumn("rate", F.round(rate_column(fit.steps, len(domains)), 6))
    if keep:
        return rated
    return rated.withColumns({"wanted_tokens": F.round(pick(fit.wanted), 3), "attained_tokens": F.round(pick(fit.totals), 3), "residual": F.lit(round(fit.residual, 3))})


def copies(rate: Column, key: str = "doc_id") -> Column:
    """Whole copies with this expectation: the rate's integer part, and one more for a share of keys by hash.
    A rate within 0.001 of a whole number is that number."""
    whole = F.floor(rate + 0.001)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")


def apply_rates(rated: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture: every row of rated as often as its copies say, with these columns."""
    return rated.withColumn("_n", copies(F.col("rate"))).where("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*columns)

