"""Content-addressed store of token ids: rolling-hash chunks, unique chunk packs, recipes and Merkle manifests.

Documents are encoded by a public tokenizer, closed by an end id and cut where a rolling hash of the
last 64 ids meets a mask, so that equal passages give equal chunks wherever they stand. The store is
three sets of files in the shared folder:

* chunks: each distinct chunk once, addressed by the sha256 of its packed ids;
* recipes: in ascending doc_id order, each document's chunk addresses and lengths, its id count, the
  number of ids before it and the Merkle root of its chunk addresses;
* manifest: one row for each recipe part with the Merkle root of its documents' roots, their number, and the
  number of ids before it and in it.

Reading back compares each part's recipes with the manifest: a recipe that is lost, repeated, altered or out of
order makes `verified` false for its part. A part of which no recipe is left has no rows; `sound_parts` lists it.

Defined results: a null or empty text is the end id alone; repeated doc_ids each keep a recipe, in a
stable order by their content; null doc_ids come first; further columns are not read; an empty table
gives an empty store. Ids are packed as 16 bits where the vocabulary allows it, else 32.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, id_back, materialize, partitions_for, shared_path, text_rows, worker_state
from .hashing import GOLDEN, equal_spans, loads, mix64, padded_loads, runs, span_hashes

#: Expected, least and most ids of a chunk.
MEAN_IDS, MIN_IDS, MAX_IDS = 256, 64, 1024
#: Words whose ids a worker remembers; beyond it the memory starts anew.
MEMORY_WORDS = 2_000_000
#: Marks at the end of a word that are parted from it.
MOST_MARKS = 16
#: Chunks a task remembers having given, likewise.
SEEN_CHUNKS = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STRANGE = np.ones(256, bool)
_STRANGE[ord("a") : ord("z") + 1] = False
_SOLID = np.ones(256, bool)
_SOLID[[ord(" "), ord("\n")]] = False
#: Bytes of the staged store for each recipe part.
PART_BYTES = 64 << 20


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of data, `size` from each start, one behind the other."""
    total = np.cumsum(size)
    return data[np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]


class WordEncoder:
    """A tokenizer file of the tokenizers library, with a bounded memory of words.

    The tokenizer drops white space, counts letters in lower case and merges inside words only, so a text's
    ids are those of its words in order. Texts are cut at blanks and line feeds, and a run of up to MOST_MARKS
    ASCII marks that closes a word behind a letter is a word of its own. Each new word is encoded by the library; its ids and bytes are
    kept under a 64-bit hash, and the words of a whole batch are looked up together. A word counts as found
    only where its bytes are those kept; one whose hash another word holds is encoded by the library. Texts with
    the first character of an added token, and all texts of a tokenizer without word ends, go to the library as
    they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None
        if suffix:
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.leads = {x.content[0] for x in self.tokenizer.get_added_tokens_decoder().values()}
        if any(c.isalpha() or c.isspace() for c in self.leads):
            self.closes = None
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(1 << 17, np.uint64)
        self.entry = np.zeros(1 << 17, np.int32)
        self.offset = np.zeros(1, np.int32)  # entry k holds pool[offset[k] : offset[k + 1]]
        self.pool = np.zeros(0, self.kind)
        self.spelt = np.zeros(1, np.int32)  # and is spelt letters[spelt[k] : spelt[k + 1]]; eight zeros close the letters
        self.letters = np.zeros(8, np.uint8)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, by the library alone."""
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, text: str, count: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids of each word) of `count` words of letters alone, parted by blanks: each is one
        pre-token, and the vocabulary's word ends part the ids. None if they do not."""
        ids = self.library([text])[0]
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == count else None

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        mask = np.uint64(len(self.slots) - 1)
        at = (hashes & mask).astype(np.int64)
        held = self.slots[at]
        out = np.where(held == hashes, self.entry[at], -1)
        todo = np.flatnonzero((held != hashes) & (held != 0))
        while len(todo):
            at[todo] = at[todo] + 1 & int(mask)
            held = self.slots[at[todo]]
            same = held == hashes[todo]
            out[todo[same]] = self.entry[at[todo[same]]]
            todo = todo[~same & (held != 0)]
        return out

    def _enter(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Enter distinct new hashes."""
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slots[at[todo]] == 0]
            self.slots[at[free]] = hashes[free]
            placed = free[self.slots[at[free]] == hashes[free]]
            self.entry[at[placed]] = entries[placed]
            left = np.ones(len(hashes), bool)
            left[placed] = False
            todo = todo[left[todo]]
            at[todo] = at[todo] + 1 & mask

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Enter words (spans of data) under their distinct hashes."""
        known = len(self.offset) - 1
        if 2 * (known + len(hashes)) > len(self.slots):
            old = self.slots != 0
            kept, entries = self.slots[old], self.entry[old]
            size = 1 << (2 * (known + len(hashes))).bit_length()
            self.slots, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._enter(kept, entries)
        self._enter(hashes, self._keep(data, start, end))

    def _keep(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """New entries for words (spans of data)."""
        strange = np.append(0, np.cumsum(_STRANGE[data]))
        plain = strange[end] == strange[start]
        rest = [bytes(data[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(start[~plain].tolist(), end[~plain].tolist())]
        alike = np.array([x.isalpha() for x in rest], bool)
        groups = [np.flatnonzero(plain), np.flatnonzero(~plain)[alike]]
        order, apart, pools, sizes = [], [np.flatnonzero(~plain)[~alike]], [], []
        single = [x for x, a in zip(rest, alike.tolist()) if not a]
        for group in groups:
            size = end[group] - start[group] + 1
            text = _gather(data, start[group], size)
            text[np.cumsum(size) - 1] = 32
            found = self.together(bytes(text).decode("utf-8", "surrogatepass"), len(group)) if len(group) else None
            if found:
                order.append(group)
                pools.append(found[0])
                sizes.append(found[1])
            else:
                apart.append(group)
                single += [bytes(data[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(start[group].tolist(), end[group].tolist())]
        own = self.library(single)
        at = np.concatenate([*order, *apart])
        known, width = len(self.offset) - 1, (end - start)[at]
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(np.concatenate([*sizes, [len(x) for x in own]]).astype(np.int32), dtype=np.int32)])
        self.pool = np.concatenate([self.pool, *pools, *own])
        self.spelt = np.concatenate([self.spelt, self.spelt[-1] + np.cumsum(width, dtype=np.int32)])
        self.letters = np.concatenate([self.letters[:-8], _gather(data, start[at], width), np.zeros(8, np.uint8)])
        entries = np.empty(len(at), np.int32)
        entries[at] = np.arange(known, known + len(at), dtype=np.int32)
        return entries

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        whole = self.closes is None or any(c in x for x in texts for c in self.leads)
        own = [k for k, x in enumerate(texts) if self.closes is None or any(c in x for c in self.leads)] if whole else []
        apart = dict(zip(own, self.library([texts[k] for k in own])))
        raw = [b"" if k in apart else x.encode("utf-8", "surrogatepass") for k, x in enumerate(texts)]
        data = _LOWER[np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)]
        start, end = runs(_SOLID[data])
        # ASCII marks that close a word behind an ASCII letter, or a letter of the block that C3 leads, stand alone.
        run = np.zeros(len(start), np.int64)
        rows = np.flatnonzero(_MARK[data[end - 1]])
        while len(rows) and run[rows[0]] < MOST_MARKS:
            run[rows] += 1
            rows = rows[(end - start)[rows] > run[rows]]
            rows = rows[_MARK[data[end[rows] - run[rows] - 1]]]
        ahead = np.maximum(end - run - 1, 0)
        last, lead = data[ahead], data[np.maximum(ahead - 1, 0)]
        letter = (last >= 97) & (last <= 122) | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        marked = (run > 0) & (end - run > start) & letter
        extra = np.cumsum(marked) - marked
        place = np.arange(len(start)) + extra
        first = np.empty(len(start) + int(marked.sum()), np.int64)
        close = np.empty(len(first), np.int64)
        cut = end - np.where(marked, run, 0)
        first[place], close[place] = start, cut
        first[place[marked] + 1], close[place[marked] + 1] = cut[marked], end[marked]
        hashes = span_hashes(data, first, close) | np.uint64(1)
        found = self._find(hashes)
        if (found < 0).any():
            missing = np.flatnonzero(found < 0)
            fresh, at = np.unique(hashes[missing], return_index=True)
            if len(self.offset) + len(fresh) > MEMORY_WORDS:
                self._forget()
                fresh, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            self._learn(fresh, data, first[missing[at]], close[missing[at]])
            found = self._find(hashes)
        width = close - first
        same = self.spelt[found + 1] - self.spelt[found] == width
        same[same] = equal_spans(loads(data), first[same], padded_loads(self.letters), self.spelt[found[same]], width[same])
        if not same.all():
            other = np.flatnonzero(~same)
            found[other] = self._keep(data, first[other], close[other])
        low = self.offset[found]
        size = self.offset[found + 1] - low
        ids, total = _gather(self.pool, low, size), np.cumsum(size)
        bounds = np.cumsum([1, *(len(x) + 1 for x in raw)])
        words = np.searchsorted(first, bounds)
        total = np.append(0, total)
        return [apart[k] if k in apart else ids[total[a] : total[b]] for k, (a, b) in enumerate(zip(words, words[1:]))]


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, kept in its worker."""
    return worker_state(("encoder", path), lambda: WordEncoder(path))


def gear(size: int) -> np.ndarray:
    """A 64-bit random number for each id, by rule."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(size, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


def cuts(ids: np.ndarray, table: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: where the rolling hash of the last 64 ids has its top bits 0,
    but no nearer than MIN_IDS and no farther than MAX_IDS to the cut before."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    rolling = table[ids]
    with np.errstate(over="ignore"):
        for reach in (1, 2, 4, 8, 16, 32):  # after each pass the sum covers twice as many ids
            rolling[reach:] += rolling[:-reach] << np.uint64(reach)
    bits = MEAN_IDS.bit_length() - 1
    out, last = [], 0
    for at in (np.flatnonzero(rolling >> np.uint64(64 - bits) == 0) + 1).tolist():
        while at - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if at - last >= MIN_IDS:
            out.append(at)
            last = at
    while n - last > MAX_IDS:
        last += MAX_IDS
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over leaves; an odd node moves up alone; no leaves hash as nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


@lru_cache(maxsize=1)
def crc_shifts() -> np.ndarray:
    """For n up to MAX_IDS: tables that carry a crc32 over n further ids (4 n zero bytes), by linearity."""
    one = np.zeros((4, 256), np.uint32)
    base = np.array([zlib.crc32(b"\0" * 4, 1 << k) ^ zlib.crc32(b"\0" * 4, 0) for k in range(32)], np.uint32)
    for byte in range(4):
        for k in range(8):
            one[byte, np.arange(256) >> k & 1 == 1] ^= base[8 * byte + k]
    out = np.empty((MAX_IDS + 1, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    out[0] = [values << np.uint32(8 * b) for b in range(4)]
    for n in range(1, MAX_IDS + 1):
        x = out[n - 1]
        out[n] = one[0][x & 255] ^ one[1][x >> 8 & 255] ^ one[2][x >> 16 & 255] ^ one[3][x >> 24]
    return out


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """The crc32 of a stream from (crc32, number of ids) of its pieces in order."""
    shifts, crc = crc_shifts(), 0
    for own, n in parts:
        t = shifts[n]
        crc = int(t[0, crc & 255] ^ t[1, crc >> 8 & 255] ^ t[2, crc >> 16 & 255] ^ t[3, crc >> 24]) ^ own
    return crc


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(kind, doc_id, row, n, digests, data): a recipe row for each document, and its chunks as far as the
    same task has not given them yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path)
        table, end, seen, row = gear(own.tokenizer.get_vocab_size()), np.array([end_id], own.kind), set(), 0
        for batch in batches:
            rows = []
            encoded = own.encode_all([x if isinstance(x, str) else "" for x in batch["text"]])
            for doc_id, ids in zip(batch["doc_id"], encoded):
                ids = np.concatenate([ids, end])
                data, digests, last = ids.tobytes(), [], 0
                for at in cuts(ids, table):
                    piece = data[last * own.width : at * own.width]
                    digest = hashlib.sha256(piece).digest()
                    digests.append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        rows.append(("chunk", None, None, at - last, digest, piece))
                    last = at
                rows.append(("recipe", doc_id, row, len(ids), b"".join(digests), None))
                row += 1
                if len(seen) > SEEN_CHUNKS:
                    seen.clear()
            yield pd.DataFrame(rows, columns=["kind", "doc_id", "row", "n", "digests", "data"]).astype({"row": "Int64"})

    return id_back(text_rows(docs).mapInPandas(run, "kind string, doc_id string, row long, n long, digests binary, data binary"))


def build_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> dict[str, DataFrame]:
    """Write the store of docs (doc_id, text) and return its tables as read back: chunks, recipes, manifest."""
    spark = docs.sparkSession
    stage_path = shared_path(spark, "token-stage")
    cut = cut_documents(docs, tokenizer_path, end_id).withColumn("part", F.spark_partition_id())
    cut.write.option("compression", "zstd").partitionBy("kind").parquet(stage_path)
    stage = spark.read.schema(cut.schema).parquet(stage_path)

    pieces = stage.where("kind = 'chunk'").groupBy("digests").agg(F.first("data").alias("data"), F.first("n").alias("n"))
    chunks = materialize(pieces.select(F.col("digests").alias("digest"), "n", "data"), "token-chunks")

    # Files in ascending doc_id order; the content settles the order of repeated ids.
    flat = stage.where("kind = 'recipe'").select("doc_id", "n", "digests", "part", "row")
    sorted_recipes = (
        flat.repartitionByRange(partitions_for(stage, PART_BYTES), "doc_id", "digests", "part", "row")
        .sortWithinPartitions("doc_id", "digests", "part", "row")
        .drop("part", "row")
        .withColumn("part", F.spark_partition_id())
        .withColumn("position", F.monotonically_increasing_id())
    )

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(root=[merkle([x[i : i + 32] for i in range(0, len(x), 32)]) for x in batch["digests"]])

    named = sorted_recipes.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, n long, digests binary, part int, position long, root binary"
    recipes = materialize(id_back(named.mapInPandas(seal, schema)), "token-recipes")

    # The ids before each document: totals of the parts (one number a part) carried on, then a running sum inside.
    totals = recipes.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("documents"))
    before, offsets = 0, {}
    for part, ids, _ in sorted(totals.collect()):
        offsets[part], before = before, before + ids
    inside = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(0).cast("long")
    if offsets:
        pairs = spark.createDataFrame(list(offsets.items()), "part int, base long")
        recipes = recipes.join(F.broadcast(pairs), "part")
        base = F.col("base")
    recipes = recipes.withColumn("start", base + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    recipes = recipes.select("part", "position", "doc_id", "start", "n", "digests", "root")
    manifest = materialize(part_roots(recipes), "token-manifest")
    drop_path(spark, stage_path)
    return {"chunks": chunks, "recipes": recipes, "manifest": manifest}


def part_roots(recipes: DataFrame) -> DataFrame:
    """A row for each recipe part: its first start, documents, ids and the Merkle root of their starts and roots, in
    order. The roots stream through one task a part; the tree keeps one node for each of its levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, documents, ids, stack = None, 0, 0, 0, []

        def close() -> pd.DataFrame:
            rest = None
            while stack:
                _, node = stack.pop()
                rest = node if rest is None else hashlib.sha256(b"\1" + node + rest).digest()
            return pd.DataFrame({"part": [part], "first": [first], "documents": [documents], "ids": [ids], "root": [rest.hex()]})

        for batch in batches:
            for own, start, n, root in zip(batch["part"], batch["start"], batch["n"], batch["root"]):
                if own != part:
                    if part is not None:
                        yield close()
                    part, first, documents, ids = own, int(start), 0, 0
                documents, ids = documents + 1, ids + int(n)
                stack.append((0, hashlib.sha256(b"\0" + int(start).to_bytes(8, "little") + bytes(root)).digest()))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                    (level, right), (_, left) = stack.pop(), stack.pop()
                    stack.append((level + 1, hashlib.sha256(b"\1" + left + right).digest()))
        if part is not None:
            yield close()

    ordered = recipes.select("part", "position", "start", "n", "root").repartition("part").sortWithinPartitions("part", "position")
    return ordered.mapInPandas(run, "part int, first long, documents long, ids long, root string")


def sound_parts(store: dict[str, DataFrame]) -> DataFrame:
    """(part, kept) of every part of the manifest or the recipes: whether its recipes as read back are the listed ones."""
    found = part_roots(store["recipes"]).withColumn("here", F.lit(True))
    listed = store["manifest"].withColumn("listed", F.lit(True))
    both = listed.join(found, ["part", "first", "documents", "ids", "root"], "full_outer")
    return both.groupBy("part").agg(F.coalesce(F.bool_and(F.col("here").isNotNull() & F.col("listed").isNotNull()), F.lit(False)).alias("kept"))


def _links(store: dict[str, DataFrame], chunk_columns: DataFrame) -> DataFrame:
    """The recipes beside `pieces`, the chunk_columns (by digest) of their chunks in order."""
    recipes = store["recipes"]
    listed = recipes.select("position", F.expr("explode(sequence(0, cast(length(digests) / 32 as int) - 1)) as seq"), "digests")
    links = listed.select("position", "seq", F.expr("substring(digests, seq * 32 + 1, 32)").alias("digest"))
    joined = links.join(chunk_columns, "digest", "left")
    rest = [F.col(c) for c in chunk_columns.columns if c != "digest"]
    gathered = joined.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("seq", *rest))).alias("pieces"))
    return recipes.select("part", "position", F.col("doc_id").cast("string").alias("doc_id"), "start", "n", "digests", "root").join(gathered, "position")


def verify_store(store: dict[str, DataFrame], tokenizer_path: str) -> DataFrame:
    """Read every chunk back, check its address, and rebuild each document's id checksum and Merkle root.

    The checksum of a document follows from those of its chunks (crc32 is linear), so that chunk bytes are
    read once and stay where they are. A missing or altered chunk makes `verified` false, and so do recipes that
    are not those of the manifest (see sound_parts)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer_path)
        for batch in batches:
            data = batch["data"].tolist()
            sizes = np.array([len(x) for x in data], np.int64)
            whole = sizes % own.width == 0
            wide = memoryview(np.frombuffer(b"".join(x if ok else b"" for x, ok in zip(data, whole)), own.kind).astype("<u4").tobytes())
            ends = (np.cumsum(np.where(whole, sizes, 0)) // own.width * 4).tolist()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            sound = [hashlib.sha256(x).digest() == d for x, d in zip(data, batch["digest"].tolist())]
            yield pd.DataFrame({"digest": batch["digest"], "n": batch["n"], "crc": crcs, "sound": np.array(sound, bool) & whole & (sizes == batch["n"].to_numpy() * own.width)})

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("doc_id", "start", "n", "digests", "root", "crcs", "sizes", "sound")
        for batch in batches:
            rows = []
            for doc_id, start, n, digests, root, crcs, sizes, sound in zip(*(batch[c].tolist() for c in names)):
                digests = bytes(digests)
                found = merkle([digests[i : i + 32] for i in range(0, len(digests), 32)])
                whole = crcs is not None
                crc = join_crcs(list(zip(crcs.tolist(), sizes.tolist()))) if whole else None
                good = sound and whole and found == bytes(root) and len(crcs) * 32 == len(digests) and int(sizes.sum()) == n
                rows.append((doc_id, start, n, crc, len(digests) // 32, found.hex(), bool(good)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "merkle_root", "verified"]).astype({"ids_crc32": "Int64"})

    checked = store["chunks"].mapInPandas(check, "digest binary, n long, crc long, sound boolean")
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long, n_chunks long, merkle_root string, verified boolean"
    linked = _links(store, checked).join(F.broadcast(sound_parts(store)), "part")
    there = F.forall("pieces", lambda p: p["crc"].isNotNull())
    each = lambda name: F.when(there, F.transform("pieces", lambda p: p[name]))
    sound = F.col("kept") & F.forall("pieces", lambda p: F.coalesce(p["sound"], F.lit(False)))
    rows = linked.select("doc_id", "start", "n", "digests", "root", each("crc").alias("crcs"), each("n").alias("sizes"), sound.alias("sound"))
    return id_back(rows.mapInPandas(rebuild, schema))


def reconstruct(store: dict[str, DataFrame], tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): every document's ids rebuilt from its recipe and the chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = encoder(tokenizer_path).kind
        for batch in batches:
            ids = [np.frombuffer(b"".join(bytes(p["data"]) for p in pieces), kind).astype(np.int64).tolist() for pieces in batch["pieces"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return id_back(_links(store, store["chunks"].select("digest", "data")).select("doc_id", "pieces").mapInPandas(run, "doc_id string, ids array<int>"))

