"""Language identification by cross-parsing entropy.

For each language a suffix automaton over a bounded, deterministic sample of labelled text. A text is
parsed against each automaton into longest matches; the language that needs the fewest phrases, counted
in bits as phrases x log2(sample symbols), describes it best and wins.

Symbols are the lower-cased letters frequent in the samples; every run of other characters is one
separator; rarer letters are a symbol that no automaton knows. Texts are parsed whole, in blocks of
BLOCK symbols that each start a phrase, so that all blocks of many texts advance together.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language first
in order; repeated rows are each predicted; columns other than the text and the key never reach a
prediction; with no labelled row every text is `und`; a null key counts as the text "" in the held-out rule.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_state

UNKNOWN = "und"
#: Symbols of labelled text for each language's automaton, and the most symbols of one labelled text.
SAMPLE_SYMBOLS = 40_000
SAMPLE_TEXT_SYMBOLS = 4_000
#: Rows fetched for each language at most, in the order of a hash of their key.
SAMPLE_ROWS = 256
ALPHABET = 64
BLOCK = 512
LANES = 1 << 13
SEPARATOR, RARE = 0, 1

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(samples: dict[str, list[str]]) -> str:
    """The most frequent lower-case letters of the samples, weighed alike by language."""
    share: Counter[str] = Counter()
    for texts in samples.values():
        own = Counter(c for x in texts for c in x.lower() if c.isalpha())
        total = sum(own.values()) or 1
        for c, n in own.items():
            share[c] += n / total
    return "".join(sorted(c for c, _ in sorted(share.items(), key=lambda p: (-p[1], p[0]))[: ALPHABET - 2]))


def symbol_table(chars: str) -> np.ndarray:
    """For each code point its symbol: a letter's own, RARE for other letters, SEPARATOR for the rest."""
    out = np.where(letters(), RARE, SEPARATOR).astype(np.uint8)
    for k, c in enumerate(chars):
        out[ord(c)] = k + 2
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k + 2
    return out


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text's symbols, runs of separators as one."""
    out = table[code_points(text)]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SEPARATOR) | (out[:-1] != SEPARATOR)
    return out[keep]


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions, one row of `size` symbols a state, 0 where there is none; the start is state 1.

    Every factor of the text is a path from the start, and nothing else is."""
    n = len(text)
    to = np.zeros((2 * n + 3, size), np.int32)
    link, length = [0] * (2 * n + 3), [0] * (2 * n + 3)
    last, count = 1, 2
    for c in text.tolist():
        new = count
        count += 1
        length[new] = length[last] + 1
        p = last
        while p and not to[p, c]:
            to[p, c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = int(to[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = count
                count += 1
                to[clone] = to[q]
                length[clone], link[clone] = length[p] + 1, link[q]
                link[q] = link[new] = clone
                while p and to[p, c] == q:
                    to[p, c] = clone
                    p = link[p]
        last = new
    return to[:count].copy()


class Parser:
    """The automata of all languages, and the parse of many texts at once."""

    def __init__(self, chars: str, samples: dict[str, list[str]]):
        self.table = symbol_table(chars)
        self.size = len(chars) + 2
        self.languages = sorted(samples)
        self.bits, self.automata = [], []
        for lang in self.languages:
            parts = [np.append(symbols(x, self.table), np.uint8(RARE)) for x in samples[lang]]
            text = np.concatenate(parts)[:SAMPLE_SYMBOLS] if parts else np.zeros(0, np.uint8)
            to = suffix_automaton(text, self.size)
            to[:, RARE] = 0
            # A row's place instead of its number saves the product in each step; a miss restarts at the symbol.
            to *= self.size
            self.automata.append(to.ravel())
            self.bits.append(math.log2(max(2, len(text))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, symbols by text)."""
        coded = [symbols(x, self.table) for x in texts]
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.array([len(x) for x in coded], np.int64)
        owner, pieces = [], []
        for k, x in enumerate(coded):
            for at in range(0, len(x), BLOCK):
                owner.append(k)
                pieces.append(x[at : at + BLOCK])
        for at in range(0, len(pieces), LANES):
            self._parse(pieces[at : at + LANES], np.array(owner[at : at + LANES]), counts)
        return counts, lengths

    def _parse(self, pieces: list[np.ndarray], owner: np.ndarray, counts: np.ndarray) -> None:
        sizes = np.array([len(x) for x in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes, owner = sizes[order], owner[order]
        grid = np.full((len(pieces), BLOCK), RARE, np.uint8)
        for row, k in enumerate(order):
            grid[row, : sizes[row]] = pieces[k]
        grid = np.ascontiguousarray(grid.T)
        live = len(pieces) - np.searchsorted(sizes[::-1], np.arange(BLOCK), side="right")
        for k, to in enumerate(self.automata):
            ended = np.zeros(len(pieces), np.int32)
            start = to[self.size : 2 * self.size]
            state = np.full(len(pieces), self.size, np.int32)
            for i in range(int(sizes[0])):
                n = live[i]
                symbol = grid[i, :n]
                after = to[state[:n] + symbol]
                missed = after == 0
                ended[:n] += missed
                fresh = start[symbol[missed]]
                fresh[fresh == 0] = self.size
                after[missed] = fresh
                state[:n] = after
            np.add.at(counts[:, k], owner, ended + 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is how far the best description undercuts the second."""
        known = letters()
        good = [isinstance(x, str) and bool(x) and bool(known[code_points(x)].any()) for x in texts]
        counts, lengths = self.phrases([x for x, ok in zip(texts, good) if ok])
        cost = counts * np.array(self.bits)[None, :] if len(counts) else counts
        out, row = [], 0
        for ok in good:
            if not ok or not self.languages:
                out.append((UNKNOWN, 0.0))
                row += ok
                continue
            order = np.argsort(cost[row], kind="stable")
            best = cost[row, order[0]]
            second = cost[row, order[1]] if len(order) > 1 else lengths[row] * self.bits[0] + best
            out.append((self.languages[order[0]], float(min(1.0, max(0.0, 1.0 - best / second)))))
            row += 1
        return out


def parser(chars: str, samples: dict[str, list[str]]) -> Parser:
    """The parser of these samples, built once in each worker."""
    key = hashlib.sha256(repr((chars, sorted(samples.items()))).encode("utf-8", "surrogatepass")).hexdigest()
    return worker_state(("parser", key), lambda: Parser(chars, samples))


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> tuple[str, dict[str, list[str]]]:
    """(alphabet, labelled samples by language) from the rows of `labelled` with a label.

    Bounded sample: SAMPLE_ROWS rows a language, texts of up to SAMPLE_TEXT_SYMBOLS characters first, in the
    order of a hash of their key; SAMPLE_TEXT_SYMBOLS characters of each and SAMPLE_SYMBOLS symbols in all. One counting pass and one pass
    for the rows; what reaches the driver doesn't grow with the table."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("x"), F.col(label).alias("l"))
    rows = rows.where("l is not null and x <> ''")
    rank = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, list[str]] = {}
    if counts:
        # Expected to let through twice the rows wanted; the limit settles the rest.
        reach = F.coalesce(*[F.when(F.col("l") == l, F.lit(min(1 << 30, int(2 * SAMPLE_ROWS / n * (1 << 30)) + 1))) for l, n in sorted(counts.items())])
        near = rows.withColumn("h", rank).where(F.col("h") < reach)
        for l in sorted(counts):
            mine = near.where(F.col("l") == l).withColumn("long", F.length("x") > SAMPLE_TEXT_SYMBOLS)
            mine = mine.select("long", "h", "k", F.substring("x", 1, SAMPLE_TEXT_SYMBOLS).alias("x"))
            got = mine.orderBy("long", "h", "k", "x").limit(SAMPLE_ROWS).collect()
            texts, total = [], 0
            for r in got:
                if total >= SAMPLE_SYMBOLS:
                    break
                texts.append(r["x"])
                total += len(r["x"])
            samples[l] = texts
    return alphabet(samples), samples


def held_out_column(key: str = "doc_id"):
    """Rows that are not learnt from: crc32 of the key as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, model: tuple[str, dict[str, list[str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with lang_pred and score appended (replacing columns of these names)."""
    chars, samples = model
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((chars, samples))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = parser(*shared.value)
        for batch in batches:
            found = own.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            arrays = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learnt from the labelled rows that aren't held out."""
    model = learn(docs.where(~held_out_column()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
