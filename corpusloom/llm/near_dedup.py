"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and exact verification.

Words are those of the decontamination operator, a shingle five in a row (all of them in a shorter text),
weighted by its count in the text. Each shingle's arrivals form a Poisson process whose rate is its weight;
an arrival at a register keeps the register if it is the earliest there, and a shingle stops once its next
arrival is later than every register (early termination). Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. Texts with repeated shingles are sketched with
equal weights too, where the same agreement is the plain Jaccard similarity; the links are those of plain
similarity, and both sketches propose candidates.

BANDS bands of ROWS registers propose candidates: a pair at the threshold is missed with probability
(1 - 0.8 ** ROWS) ** BANDS, about 5e-6. Texts of equal shingle sets are one class from the start, and only
one of them goes on. Then two passes find the links of every bucket without emitting its pairs:

1. Every member is compared with its bucket's leader, the member that shares most buckets with others,
   by the exact Jaccard similarity of the shingle sets; links join classes.
2. Where a bucket still holds several classes, the members outside its largest class are compared with all
   members. Both sides are dealt to blocks of BLOCK_ROWS, and each pair of blocks is a group of its own: first
   by registers alone, of which a pair needs gate(threshold) equal ones to go on; then the shingle sets of the
   members with such pairs follow into their pair of blocks, where the pairs are verified. Pairs never leave a
   block, links do. Registers agree independently of each other, so a pair at the threshold fails the gate with
   GATE_MISS at most.

Pairs of one class need no comparison, so a link between classes is left out only by the bands or the gate:
together about 5.3e-6 for a pair at 0.8, and less above. Lower thresholds are for the bands, which are of a
fixed shape, to miss: (1 - threshold ** ROWS) ** BANDS is 4e-4 at 0.75 and 7e-3 at 0.7.

Defined results: a null or empty text, or one without words, is a class of its own row; a class is named by
its least doc_id (null ids rank last and a class of null ids alone is named null); repeated rows are rows of
one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, back, forget_state, hot_keys, id_back, materialize, release, split_join, text_rows, written_ids
from .hashing import GOLDEN, mix64, runs, span_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Members of a block.
BLOCK_ROWS = 1024
#: Members of buckets of one block that are compared in one group, bucket by bucket.
BUNDLE_ROWS = 4096
#: The probability with which a pair at the threshold may have too few equal registers.
GATE_MISS = 1e-7
_WORD = np.ones(256, bool)
_WORD[: ord("0")] = _WORD[ord("9") + 1 : ord("a")] = _WORD[ord("z") + 1 : 0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of the words of some bytes."""
    data = _LOWER[data]
    start, end = runs(_WORD[data])
    return start, span_hashes(data, start, end)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, their counts) of each text."""
    raw = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at, own in _groups(raw):
        data = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        place, hashes = word_hashes(data)
        bounds = np.searchsorted(place, np.cumsum([0, *(len(x) + 1 for x in own)]))
        with np.errstate(over="ignore"):
            joined = hashes.copy()
            for k in range(1, min(size, len(joined))):
                joined[:-k] = joined[:-k] * GOLDEN + hashes[k:]
            joined = mix64(joined)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= size:
                found = joined[a : b - size + 1]
            elif b > a:
                short = np.uint64(0)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        short = short * GOLDEN + h
                found = mix64(np.array([short]))
            else:
                found = np.zeros(0, np.uint64)
            out.append(np.unique(found, return_counts=True))
    return out


def _groups(raw: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about `most` bytes together."""
    start = total = 0
    for k, x in enumerate(raw):
        total += len(x)
        if total >= most:
            yield start, raw[start : k + 1]
            start, total = k + 1, 0
    if start < len(raw):
        yield start, raw[start:]


def prob_min_hash(elements: list[np.ndarray], weights: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """One row of registers a set: the element that arrives first in each register (0 for empty sets)."""
    n_sets = len(elements)
    kept = np.zeros(n_sets * registers, np.uint64)
    first = np.full(n_sets * registers, np.inf)
    counts = np.array([len(x) for x in elements], np.int64)
    if not counts.sum():
        return kept.reshape(n_sets, registers)
    e, w = np.concatenate(elements), np.concatenate(weights).astype(np.float64)
    owner = np.repeat(np.arange(n_sets), counts)
    time, turn = np.zeros(len(e)), np.zeros(len(e), np.uint64)
    while len(e):
        # A small set needs many arrivals of each element: their number is a power of two near registers / live.
        live = np.bincount(owner, minlength=n_sets)
        ahead = np.maximum(0, np.ceil(np.log2(np.maximum(1, registers / np.maximum(1, live))))).astype(np.int64)[owner]
        limit = first.reshape(n_sets, registers).max(axis=1)
        for power in np.unique(ahead):
            rows = np.flatnonzero(ahead == power)
            many = 1 << int(power)
            step = max(1, (1 << 20) // many)
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                with np.errstate(over="ignore"):
                    number = turn[part, None] + np.arange(1, many + 1, dtype=np.uint64)
                    random = mix64(e[part, None] + number * GOLDEN)
                    gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w[part, None]
                    register = (mix64(random ^ GOLDEN) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
                gap[:, 0] += time[part]
                arrival = np.cumsum(gap, axis=1)
                time[part], turn[part] = arrival[:, -1], turn[part] + np.uint64(many)
                cell = owner[part, None] * registers + register.astype(np.int64)
                early = arrival < first[cell]
                cell, arrival = cell[early], arrival[early]
                element = np.broadcast_to(e[part, None], early.shape)[early]
                order = np.argsort(-arrival, kind="stable")  # the earliest is written last
                first[cell[order]] = arrival[order]
                kept[cell[order]] = element[order]
        limit = first.reshape(n_sets, registers).max(axis=1)
        alive = time < limit[owner]
        e, w, owner, time, turn = e[alive], w[alive], owner[alive], time[alive], turn[alive]
    return kept.reshape(n_sets, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    rows = signature.reshape(len(signature), bands, signature.shape[1] // bands)
    with np.errstate(over="ignore"):
        key = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * GOLDEN, rows.shape[:2]).copy()
        for k in range(rows.shape[2]):
            key = mix64(key * GOLDEN + rows[:, :, k])
    return key.view(np.int64)


def set_digest(elements: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    import hashlib

    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, digest, keys, registers) of every row, in the shared folder: band keys, and 16 bits of each
    register of the equal-weight sketch; texts without words have no digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        forget_state()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            sets = shingle_sets(list(batch["text"]))
            plain = [e for e, _ in sets]
            signature = prob_min_hash(plain, [np.ones(len(e)) for e in plain])
            keys = band_keys(signature)
            short = (signature >> np.uint64(48)).astype("<u2")
            again = [k for k, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
            weighted = band_keys(prob_min_hash([sets[k][0] for k in again], [sets[k][1] for k in again]))
            lists = [x if len(e) else x[:0] for x, e in zip(keys, plain)]
            for k, x in zip(again, weighted):
                lists[k] = np.concatenate([keys[k], np.setdiff1d(x, keys[k])])
            yield pd.DataFrame(
                {"uid": np.arange(uid, uid + len(sets)), "doc_id": batch["doc_id"], "digest": [set_digest(e) if len(e) else None for e in plain], "keys": lists, "registers": [x.tobytes() for x in short]}
            )
            uid += len(sets)

    rows = text_rows(docs).mapInPandas(run, "uid long, doc_id string, digest binary, keys array<long>, registers binary")
    return materialize(id_back(rows), "sketches")


def pack_set(elements: np.ndarray) -> bytes:
    """The top 48 bits of sorted distinct hashes, six bytes each."""
    return np.ascontiguousarray((elements >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def linked(x: bytes, y: bytes, threshold: float) -> bool:
    """Whether two packed sets have a Jaccard similarity of at least the threshold."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([unpack_set(x), unpack_set(y)]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= threshold * (len(both) - common)


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, shingles) of the wanted (uid, doc_id, digest) rows, from their texts, as packed sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, pack_set(e)) for u, d, (e, _) in zip(batch["uid"], batch["digest"], shingle_sets(list(batch["text"]))) if set_digest(e) == bytes(d)]
            yield pd.DataFrame(rows, columns=["uid", "shingles"]).astype({"uid": "int64"})

    ids = wanted.select("uid", F.col("doc_id").alias("_id"), "digest")
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("uid", "digest", "text")
    found = joined.mapInPandas(run, "uid long, shingles binary")
    return materialize(found if _ids_once(docs) else found.dropDuplicates(["uid"]), "shingle-sets")


def _ids_once(docs: DataFrame) -> bool:
    """Whether no two rows share a doc_id."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(x, y, threshold) for x, y in zip(batch["sa"], batch["sb"])]
            yield batch.loc[keep, ["a", "b"]]

    pairs = materialize(pairs, "pairs")
    total = pairs.count()
    left = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))
    # A leader is in as many pairs as its buckets have members: its set follows them into several parts.
    rows = split_join(split_join(pairs, right, "b", hot_keys(pairs, "b", total)), left, "a", hot_keys(pairs, "a", total)).select("a", "b", "sa", "sb")
    return rows.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(uid, label) of the ends of edges (a, b): the least uid they are connected with.

    Labels spread along edges and then jump to their labels' labels, until a round changes none; each round
    is a table in the shared folder."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "uid"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "uid"), "uid").select("uid", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("uid").alias("label"), F.col("label").alias("jump"))
        after = spread.join(ahead, "label").select("uid", F.least("label", "jump").alias("label"), "was")
        after = materialize(after, "labels")
        release(labels)
        labels = after.select("uid", "label")
        if after.where("label <> was").isEmpty():
            release(both)
            return labels


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket (key, uid) with the bucket's leader, once. Leaders come from
    aggregates, so no bucket is sorted or gathered."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "key").groupBy("uid").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "uid")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("uid")).alias("u"))).alias("x")).select("key", (-F.col("x.u")).alias("leader"))
    met = members.join(leaders, "key").where("uid <> leader")
    return met.select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()


def gate(threshold: float, registers: int = BANDS * ROWS, miss: float = GATE_MISS) -> int:
    """The equal registers from which a pair is verified: fewer have a probability of at most `miss` at the
    threshold, by the binomial law."""
    below = 0.0
    for n in range(registers):
        below += math.comb(registers, n) * threshold**n * (1 - threshold) ** (registers - n)
        if below > miss:
            return n
    return registers


def open_links(members: DataFrame, labels: DataFrame, registers: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): linked pairs of different classes that share a bucket.

    members: key, band (-1 of the weighted sketch), uid; labels: uid, label of the classes so far; registers:
    uid, registers; sets: uid, shingles."""
    held = members.join(labels, "uid", "left").select("key", "band", "uid", F.coalesce("label", "uid").alias("label"))
    counts = held.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("x"), F.count("*").alias("classes"), F.sum("n").alias("n")).where("classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    mixed = mixed.select("key", F.col("x.label").alias("main"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("x.n")).alias("asking"))
    held = materialize(held.join(mixed, "key"), "mixed-buckets")
    # Buckets of one block share a group, for their number; BUNDLE_ROWS members are expected in it.
    bundles = max(1, held.count() // BUNDLE_ROWS)
    small = F.col("blocks") == 1
    group = F.struct(small.alias("small"), F.when(small, F.pmod(F.xxhash64("key"), F.lit(bundles))).otherwise(F.col("key")).alias("at"))
    rows = held.join(registers, "uid").withColumn("group", group)
    seat = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = rows.select("group", each(F.col("asking")).alias("i"), seat(F.col("blocks")).alias("j"), "key", "band", "uid", "label", "registers")
    asked = rows.where("label <> main").select("group", seat(F.col("asking")).alias("i"), each(F.col("blocks")).alias("j"), "key", "band", "uid", "label", "registers")
    asked = asked.select(*[F.col(c).alias(f"{c}_") for c in asked.columns])  # the two sides need names of their own

    least = gate(threshold)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            grid = lambda x: np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1)
            right = right.iloc[np.argsort(right["key"].to_numpy(), kind="stable")]
            x, y = grid(left["registers_"]), grid(right["registers"])
            ux, lx, kx, uy, ly, ky = (c.to_numpy() for c in (left["uid_"], left["label_"], left["key_"], right["uid"], right["label"], right["key"]))
            bands, low, high = left["band_"].to_numpy(), np.searchsorted(ky, kx, "left"), np.searchsorted(ky, kx, "right")
            for k, (c, d) in enumerate(zip(low.tolist(), high.tolist())):
                other = np.flatnonzero(ly[c:d] != lx[k]) + c
                same = y[other] == x[k]
                near = np.flatnonzero(same.sum(axis=1) >= least)
                if bands[k] > 0 and len(near):  # a pair belongs to the first bucket of the equal-weight sketch that it shares
                    shared = same[near].reshape(-1, BANDS, ROWS).all(axis=2)
                    near = near[~shared[:, : bands[k]].any(axis=1)]
                if len(near):
                    a.append(np.full(len(near), ux[k]))
                    b.append(uy[other[near]])
        if len(a) == 1:
            return pd.DataFrame(columns=["small", "at", "i", "j", "a", "b"], dtype=object)
        own = left.iloc[0]
        return pd.DataFrame({"small": [own["group_"]["small"]], "at": [own["group_"]["at"]], "i": [own["i_"]], "j": [own["j_"]], "a": [np.concatenate(a)], "b": [np.concatenate(b)]})

    grouped = asked.groupBy("group_", "i_", "j_").cogroup(every.groupBy("group", "i", "j"))
    near = materialize(grouped.applyInPandas(compare, "small boolean, at long, i int, j int, a array<long>, b array<long>"), "near-blocks")

    def verify(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(right["uid"].tolist(), right["shingles"]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *left[c]]) for c in ("a", "b"))
        keep = np.array([linked(own[x], own[y], threshold) for x, y in zip(a.tolist(), b.tolist())], bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    block = F.struct("small", "at", "i", "j")
    pairs = near.select(block.alias("block"), "a", "b")
    wanted = near.select(block.alias("block_"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("uid")).join(sets, "uid").select("block_", "uid", "shingles")
    return pairs.groupBy("block").cogroup(wanted.groupBy("block_")).applyInPandas(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, representative) for each row of docs (doc_id, text)."""
    sketches = sketch(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("uid").alias("u")))
    firsts = sketches.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("rep"), F.count("*").alias("n"), least.alias("least"))
    firsts = materialize(firsts, "representatives")
    reps = sketches.select("uid", "doc_id", "digest", "keys").join(firsts.select(F.col("rep").alias("uid")), "uid", "left_semi")
    # The first BANDS keys are those of the equal-weight sketch, in order of their bands.
    members = reps.select(F.posexplode("keys").alias("band", "key"), "uid").withColumn("band", F.when(F.col("band") < BANDS, F.col("band")).otherwise(-1))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(members.join(shared, "key", "left_semi"), "buckets")
    wanted = sketches.select("uid", "doc_id", "digest").join(members.select("uid").distinct(), "uid", "left_semi")
    sets = candidate_sets(docs, wanted)

    edges = materialize(similar(star_pairs(members), sets, threshold), "similar")
    labels = components(edges)
    more = materialize(open_links(members, labels, sketches.select("uid", "registers"), sets, threshold), "similar")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    # Classes of distinct shingle sets, then of their rows; a set with very many rows is split in the last join.
    known = firsts.join(labels.select(F.col("uid").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    known = materialize(known, "known")
    classes = known.groupBy("label").agg(F.min("least").alias("x"), F.sum("n").alias("class_size"))
    named = split_join(known.select("digest", "label"), classes, "label", hot_keys(known, "label", known.count()))
    named = named.select("digest", F.col("x.id").alias("class_id"), "class_size", F.col("x.u").alias("first"))
    rows = sketches.select("uid", "doc_id", "digest")
    worded, rest = rows.where("digest is not null"), rows.where("digest is null")
    joined = split_join(worded, named, "digest", hot_keys(worded, "digest", worded.count()))
    out = joined.select("doc_id", "class_id", "class_size", (F.col("uid") == F.col("first")).alias("representative"))
    return out.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("representative")))


def keep_representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, that of its least doc_id. Rows that share a doc_id stay or go
    together, but equal rows stay once. The join is with the ids that go, the smaller side."""
    found = near_duplicates(docs, threshold).groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("representative").alias("stays"))
    going = written_ids(found.where("not stays").select("_id"), "duplicates")
    rows, names = aside(docs, "doc_id", "text")
    joined = back(rows.join(going, rows["doc_id"].eqNullSafe(F.col("_id")), "left_anti"), names, docs)
    return joined if _ids_once(docs) else joined.dropDuplicates(["doc_id", "text"])
