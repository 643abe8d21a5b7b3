"""Removal of repeated byte strings by a column-wise suffix order over many short documents.

A byte goes when a MATCH-byte string that covers it also starts in a document with a smaller id.

The suffix order of a whole corpus has no bounded partition, so it is built over pieces that hold every
possible match. Each MATCH-byte window has an anchor, the K-byte string of least hash inside it, which its
content fixes; a piece is a run of windows with one anchor, MATCH to 2 MATCH - K bytes long. Equal windows
have equal anchors, so all pieces of an anchor that two documents share meet in one collection. There the
collection's Burrows-Wheeler transform is built column by column: round t inserts, for every piece at once,
the suffix of length t at the place that the last round's transform gives, and updates the longest common
prefixes beside it. Runs with a common prefix of MATCH or more are equal windows, and the least document
id of a run decides. Transform, prefixes, documents and lengths are columns that each round reads and writes in
sequence; beyond MEMORY_ENTRIES entries they are files in the shared folder, of which CHUNK entries are in memory.

Documents travel as compressed blocks of about BLOCK_BYTES. An anchor or a piece leaves a block once,
however often the block holds it, so a string in a third of all documents costs one entry a block. What stands
around such a string differs from document to document, and all of that has the string's anchors: the pieces of
an anchor of more than HOT_PIECES are cut into their windows, whose own hashes spread them over all parts.

Defined results: a null or empty text has no bytes and loses none; texts under MATCH bytes lose none; equal
ids are not smaller than each other, so repeated rows do not remove each other; a null id ranks after all
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import id_back, materialize, partitions_for, shared_root, text_rows
from .hashing import GOLDEN, equal_spans, loads, mix64, span_hashes

MATCH = 50
K = 20
BLOCK_BYTES = 8 << 20
#: Windows whose anchors are found at once; the arrays of a step stay in a processor's cache.
STEP = 1 << 15
#: Bytes of compressed blocks for each partition of anchors.
PART_BYTES = 11 << 18
#: Bytes of compressed blocks for each task that reads them, and parts for each task that judges them.
TASK_BYTES = 12 << 20
PARTS_A_TASK = 2
#: Bytes of pieces in one collection, unless a single anchor has more.
COLLECTION_BYTES = 1 << 20
#: Entries of a collection's order up to which its columns stay in memory, and those read of a file at once.
MEMORY_ENTRIES = 1 << 18
CHUNK = 1 << 18
#: Bytes at a window's head that must stand in another window too, or the window matches none and stays out of the order.
PROBE = 40
#: Distinct pieces of an anchor that a block's level stands for; an anchor of more pieces in all is hot.
LEVELS = (1, 15, 255, 4095)
HOT_PIECES = 1 << 16
LAST = np.iinfo(np.int64).max
KEY_BYTES = 5

BLOCK_SCHEMA = "block long, ids array<string>, sizes array<int>, data binary"


#: One of each for a worker's many small columns: making one takes as long as a column of some kB.
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _PACKER.compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _UNPACKER.decompress(data)


# Anchors and pieces of a block


def window_anchors(data: np.ndarray, match: int = MATCH, k: int = K) -> np.ndarray:
    """For each window of `match` bytes the place and the hash of its anchor: the hash's top 58 bits above
    the low 6 bits of the place. (match - k must be under 64.)"""
    n = len(data) - k + 1
    with np.errstate(over="ignore"):
        one = data.astype(np.uint64)
        two = one[:-1] | one[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        value = np.zeros(n, np.uint64)
        at, factor = 0, np.uint64(0x9E3779B97F4A7C15)
        for part, width in ((eight, 8), (four, 4), (two, 2), (one, 1)):
            while k - at >= width:
                value = (value + part[at : at + n]) * factor
                value ^= value >> np.uint64(29)
                at += width
        value = mix64(value) & ~np.uint64(63) | np.arange(n, dtype=np.uint64) & np.uint64(63)
    span = match - k + 1
    reach = 1
    while 2 * reach <= span:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(value[: len(value) - rest], value[rest:]) if rest else value


def pieces_of(data: np.ndarray, sizes: np.ndarray, match: int = MATCH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash, document) of the pieces of concatenated documents."""
    starts, counts, keys, owners = [], [], [], []
    ends = np.cumsum(sizes)
    n = len(data) - match + 1
    step = STEP
    # Where a document's windows begin and end; behind each end stand windows that reach into the next document.
    edges = np.unique(np.concatenate([ends - sizes, np.maximum(ends - sizes, ends - match + 1)]))
    for first in range(0, max(0, n), step):
        # Neighbouring steps may cut a piece in two; each window still lies in one piece.
        last = min(n, first + step)
        value = window_anchors(data[first : last + match - 1], match, k)
        fresh = np.zeros(last - first, bool)
        fresh[0] = True
        np.not_equal(value[1:], value[:-1], out=fresh[1:])
        low, high = np.searchsorted(edges, [first, last])
        fresh[edges[low:high] - first] = True
        head = np.flatnonzero(fresh)
        windows = np.diff(np.append(head, last - first))
        owner = np.searchsorted(ends, head + first, side="right")
        inside = head + first + match <= ends[owner]
        head = head[inside]
        starts.append(head + first)
        keys.append(value[head] >> np.uint64(6))
        owners.append(owner[inside])
        counts.append(windows[inside])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys), np.concatenate(owners)


def piece_names(data: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, match: int = MATCH) -> np.ndarray:
    """A hash of the bytes and the anchor of each piece."""
    with np.errstate(over="ignore"):
        return span_hashes(data, start, start + windows + match - 1) + key * GOLDEN


def piece_bytes(data: np.ndarray, start: np.ndarray, windows: np.ndarray, match: int = MATCH, k: int = K) -> np.ndarray:
    """The pieces as fixed records: their bytes, zeros behind them, and their number of windows last."""
    width = 2 * match - k
    grid = np.zeros((len(start), width + 1), np.uint8)
    if len(start):
        padded = np.concatenate([data, np.zeros(width, np.uint8)])
        column = np.arange(width)
        for at in range(0, len(start), 1 << 15):
            part = slice(at, at + (1 << 15))
            size = windows[part] + match - 1
            grid[part, :width] = padded[start[part, None] + column] * (column < size[:, None])
        grid[:, width] = windows
    return grid


def distinct(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first of each distinct record, number of the record of each row)."""
    n, width = grid.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = grid
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for column in wide.view(np.uint64).T:
            value = (value ^ column) * GOLDEN
            value ^= value >> np.uint64(29)
    _, first, number = np.unique(value, return_index=True, return_inverse=True)
    if not (grid == grid[first[number]]).all():  # two records under one hash: compare them whole
        _, first, number = np.unique(np.ascontiguousarray(grid).view(np.dtype((np.void, width))).ravel(), return_index=True, return_inverse=True)
    return first, number


# The column-wise construction


class Memory:
    """Columns of a small collection, with the interface of Files."""

    def __init__(self):
        self.held: dict[str, list[np.ndarray]] = {}

    def read(self, name: str, kind: np.dtype) -> Iterator[np.ndarray]:
        yield from self.held[name]

    def write(self, name: str) -> "MemoryColumn":
        self.held[name] = []
        return MemoryColumn(self.held[name])

    def drop(self, name: str) -> None:
        del self.held[name]

    def close(self) -> None:
        self.held.clear()


class MemoryColumn:
    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    def put(self, values: np.ndarray) -> None:
        self.parts.append(values)

    def close(self) -> None:
        pass


class Files:
    """Columns as files in a folder of the shared storage, read and written in sequence only, CHUNK entries at a time."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        self.root = f"{root}/columns-{uuid.uuid4().hex}"
        self.fs.create_dir(self.root)

    def read(self, name: str, kind: np.dtype) -> Iterator[np.ndarray]:
        with self.fs.open_input_stream(f"{self.root}/{name}") as source:
            while data := source.read(CHUNK * kind.itemsize):
                while len(data) % kind.itemsize or len(data) < CHUNK * kind.itemsize:
                    more = source.read(CHUNK * kind.itemsize - len(data))
                    if not more:
                        break
                    data += more
                yield np.frombuffer(data, kind)

    def write(self, name: str) -> "FileColumn":
        return FileColumn(self.fs.open_output_stream(f"{self.root}/{name}"))

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")

    def close(self) -> None:
        self.fs.delete_dir(self.root)


class FileColumn:
    def __init__(self, sink):
        self.sink = sink

    def put(self, values: np.ndarray) -> None:
        self.sink.write(np.ascontiguousarray(values).view(np.uint8).data)

    def close(self) -> None:
        self.sink.close()


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for each pair, ends included, by minima over powers of two."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, reach = values, 1
    for depth in range(int(level.max()) + 1 if len(level) else 0):
        here = np.flatnonzero(level == depth)
        out[here] = np.minimum(table[low[here]], table[high[here] - reach + 1])
        table = np.minimum(table[:-reach], table[reach:]) if len(table) > reach else table
        reach *= 2
    return out


def _prefix_minima(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """min(values[0..end]) for a few ends."""
    if not len(ends):
        return np.zeros(0, values.dtype)
    known, back = np.unique(ends, return_inverse=True)
    parts = np.minimum.reduceat(values[: int(known[-1]) + 1], np.append(0, known[:-1] + 1))
    return np.minimum.accumulate(parts)[back]


class Places:
    """One sequential reading of a column's symbols and prefixes: where the suffixes that the newest entries
    prolong stand in the next column, and with what common prefixes.

    Entry p stands for the suffix that its symbol prolongs; these are ordered by symbol, then by p. Between two
    entries of one symbol, the suffixes they prolong have one symbol more in common than the least prefix between."""

    def __init__(self, counts: np.ndarray, ends: int, cap: int):
        self.starts = np.cumsum(counts) - counts + ends  # of each symbol's entries in the next column
        self.starts[1:] -= counts[0]  # an entry with the end mark prolongs nothing
        self.ends, self.cap = ends, cap
        size = len(counts)
        self.seen = np.zeros(size, np.int64)
        self.least = np.full(size, 255, np.uint8)  # the least prefix since the symbol's last entry
        self.fresh = np.zeros(size, bool)  # whether that entry is one of the newest
        self.place: list[np.ndarray] = []  # of the newest entries' suffixes, -1 where there is none
        self.prefix: list[np.ndarray] = []
        self.changed: list[np.ndarray] = []  # entries behind a new one, and their common prefixes
        self.change: list[np.ndarray] = []

    def chunk(self, symbol: np.ndarray, prefix: np.ndarray, newest: np.ndarray, last: bool) -> None:
        """The next entries, and the places of the newest among them."""
        order = np.argsort(symbol, kind="stable")
        bounds = np.searchsorted(symbol[order], np.arange(len(self.seen) + 1, dtype=np.int64))
        order, bounds = order[bounds[1] :], bounds - bounds[1]
        new = np.zeros(len(symbol), bool)
        new[newest] = True
        own = new[order]
        behind = np.empty(len(order), bool)
        behind[1:] = own[:-1]
        kinds = np.flatnonzero(np.diff(bounds)[1:]) + 1
        first, tail = bounds[kinds], bounds[kinds + 1] - 1
        behind[first] = self.fresh[kinds]
        wanted = np.flatnonzero(own | behind)
        kind = symbol[order[wanted]].astype(np.int64)
        local = wanted - bounds[kind]
        rank = self.starts[kind] + self.seen[kind] + local
        joint = np.zeros(len(wanted), np.uint8)
        inner = np.flatnonzero(local > 0)
        joint[inner] = np.minimum(_range_minima(prefix, order[wanted[inner] - 1] + 1, order[wanted[inner]]), self.cap - 1) + 1
        outer = np.flatnonzero((local == 0) & (self.seen[kind] > 0))
        if len(outer):  # first entries of their symbols in this chunk, in the order of their symbols
            ahead = _prefix_minima(prefix, order[wanted[outer]])
            joint[outer] = np.minimum(np.minimum(self.least[kind[outer]], ahead), self.cap - 1) + 1
        mine = own[wanted]
        turn = np.argsort(order[wanted[mine]], kind="stable")
        going = symbol[newest] != 0
        at, common = np.full(len(newest), -1, np.int64), np.zeros(len(newest), np.uint8)
        at[going], common[going] = rank[mine][turn], joint[mine][turn]
        self.place.append(at)
        self.prefix.append(common)
        self.changed.append(rank[~mine])
        self.change.append(joint[~mine])
        if last:
            return
        self.least = np.minimum(self.least, prefix.min(initial=255))
        self.least[kinds] = 255
        inside = order[tail] + 1 < len(prefix)
        self.least[kinds[inside]] = _prefix_minima(prefix[::-1], len(prefix) - 2 - order[tail[inside]])
        self.fresh[kinds] = own[tail]
        self.seen[kinds] += tail - first + 1

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place and prefix of the newest entries' suffixes, in their entries' order; changed entries, their prefixes)."""
        changed, change = np.concatenate(self.changed), np.concatenate(self.change)
        turn = np.argsort(changed, kind="stable")
        return np.concatenate(self.place), np.concatenate(self.prefix), changed[turn], change[turn]


class ColumnOrder:
    """The suffix order of a collection, built by inserting one symbol of each document a round.

    Its columns in order: the transform (symbol 0 is the end mark, which ranks below all symbols and equals no
    other one), the common prefix with the entry before, counted up to `cap`, the length of the suffix and its
    document, as records of one file. Equal suffixes keep the order of their documents. A round reads the records
    of the last one in sequence, writes them with the new entries merged in, and on the way finds the places of the
    next round's. In memory are the documents' bytes, the newest entry of each, and CHUNK records."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, cap: int = MATCH, store: Memory | Files | None = None):
        self.store = store or Memory()
        alphabet = np.unique(data)
        code = np.zeros(256, np.uint16)
        code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.narrow = len(alphabet) < 255
        short = not len(sizes) or sizes.max() < 256
        self.kind = np.dtype([("symbol", "<u2"), ("prefix", "u1"), ("length", "u1" if short else "<u4"), *([] if short else [("spare", "u1")]), ("document", "<i4")])
        self._build(code[data], np.asarray(sizes, np.int64), len(alphabet) + 1, cap)

    def chunks(self) -> Iterator[np.ndarray]:
        """The records, CHUNK at a time."""
        return self.store.read(f"order-{self.turn}", self.kind)

    def close(self) -> None:
        self.store.close()

    def _build(self, coded: np.ndarray, sizes: np.ndarray, symbols: int, cap: int) -> None:
        m, ends = len(sizes), np.cumsum(sizes)

        def before(document: np.ndarray, length: int) -> np.ndarray:
            """The symbol ahead of the suffix of this length, 0 at a document's start."""
            at = ends[document] - length - 1
            inside = sizes[document] > length
            return np.where(inside, coded[np.where(inside, at, 0)], 0) if len(coded) else np.zeros(len(document), np.uint16)

        counts = np.zeros(symbols, np.int64)
        place, document, size = np.arange(m), np.arange(m), 0
        prefix, changed, change = np.zeros(m, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for length in range(int(sizes.max(initial=0)) + 1):
            fresh = np.zeros(len(place), self.kind)
            fresh["symbol"], fresh["prefix"], fresh["document"], fresh["length"] = before(document, length), prefix, document, length
            counts += np.bincount(fresh["symbol"], minlength=symbols)
            places = Places(counts, m, cap)
            self._merge(size, place, fresh, changed, change, length, places)
            size += len(place)
            at, prefix, changed, change = places.found()
            live = at >= 0
            turn = np.argsort(at[live], kind="stable")
            place, document, prefix = at[live][turn], document[live][turn], prefix[live][turn]
            if not len(place):
                break

    def _merge(self, size: int, place: np.ndarray, fresh: np.ndarray, changed: np.ndarray, change: np.ndarray, length: int, places: Places) -> None:
        """Write the records of this round: the `size` old entries with the fresh ones at their places."""
        old = self.chunks() if size else iter([np.zeros(0, self.kind)])
        self.turn = length
        whole = np.dtype("<u8") if self.kind.itemsize == 8 else self.kind  # plain numbers move faster than records
        sink = self.store.write(f"order-{length}")
        try:
            ahead = place - np.arange(len(place))  # old entries before each place
            low = 0
            for part in old:
                high = low + len(part)
                a = int(np.searchsorted(ahead, low)) if low else 0
                b = len(place) if high == size else int(np.searchsorted(ahead, high))
                out_low, total = low + a, high - low + b - a
                own = place[a:b] - out_low
                kept = np.ones(total, bool)
                kept[own] = False
                merged = np.empty(total, self.kind)
                merged.view(whole)[kept], merged.view(whole)[own] = part.view(whole), fresh[a:b].view(whole)
                c, d = np.searchsorted(changed, [out_low, out_low + total])
                merged["prefix"][changed[c:d] - out_low] = change[c:d]
                sink.put(merged)
                symbol = merged["symbol"].astype(np.uint8) if self.narrow else np.ascontiguousarray(merged["symbol"])
                places.chunk(symbol, np.ascontiguousarray(merged["prefix"]), own, high == size)
                low = high
        finally:
            sink.close()
        if size:
            self.store.drop(f"order-{length - 1}")


def column_order(data: np.ndarray, sizes: np.ndarray, cap: int = MATCH, store: Memory | Files | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of a ColumnOrder as arrays: (symbol, prefix, document, length)."""
    order = ColumnOrder(data, sizes, cap, store)
    try:
        whole = np.concatenate([np.zeros(0, order.kind), *order.chunks()])
        return whole["symbol"], whole["prefix"], whole["document"], whole["length"]
    finally:
        order.close()


def _least_of_runs(order: ColumnOrder, match: int, rows: np.ndarray, size: np.ndarray, owners: np.ndarray, base: np.ndarray, out: np.ndarray) -> None:
    """Enter the least owner of each run of equal windows at all of its windows' places in out. A run is a
    neighbourhood in the order with common prefixes of `match` or more; the last one of a chunk is carried on."""
    open_places, open_least = np.zeros(0, np.int64), LAST
    for part in order.chunks():
        prefix, document, length = part["prefix"], part["document"], part["length"].astype(np.int64)
        whole = np.flatnonzero(length >= match)
        if not len(whole):
            continue
        # Between two windows stand no shorter suffixes with a common prefix of `match`, so theirs decide.
        first = prefix[whole] < match
        own = rows[document[whole]]
        places = base[own] + size[document[whole]] - length[whole]
        run = np.cumsum(first)  # 0 goes on with the open run
        bounds = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        least = np.minimum.reduceat(owners[own], bounds)
        if run[0] == 0:
            least[0] = min(int(least[0]), open_least)
            out[open_places] = least[0]
        out[places] = np.repeat(least, np.diff(np.append(bounds, len(run))))
        last = places[bounds[-1] :]
        open_places = np.concatenate([open_places, last]) if run[-1] == 0 else last
        open_least = int(least[-1])


def _heads_shared(data: np.ndarray, at: np.ndarray, probe: int) -> np.ndarray:
    """For each place in data whether its next `probe` bytes may stand at another of the places too, by a hash of them."""
    with np.errstate(over="ignore"):
        reach, value = 8, mix64(loads(data))
        while 2 * reach <= probe:
            value[:-reach] = mix64(value[:-reach] * GOLDEN ^ value[reach:])
            reach *= 2
        value = mix64(value[at] * GOLDEN ^ value[at + probe - reach])
    order = np.argsort(value)
    again = value[order[1:]] == value[order[:-1]]
    out = np.zeros(len(at), bool)
    out[order[1:]] = again
    out[order[:-1]] |= again
    return out


def trimmed(grid: np.ndarray, match: int = MATCH, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the part of each piece that can match another one: from the first to the
    last window whose head of `probe` bytes stands in another window too. The windows before and behind match none."""
    windows = grid[:, -1].astype(np.int64)
    size = windows + match - 1
    data = grid[:, :-1][np.arange(grid.shape[1] - 1) < size[:, None]]
    spread = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(spread)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(_heads_shared(data, (np.cumsum(size) - size)[spread] + inside, probe))
    piece = spread[hit]
    edge = np.append(True, piece[1:] != piece[:-1]) if len(hit) else np.zeros(0, bool)
    first, count = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    first[piece[edge]] = inside[hit[edge]]
    last = hit[np.append(edge[1:], True)] if len(hit) else hit
    count[piece[edge]] = inside[last] + 1 - inside[hit[edge]]
    return first, count


def least_owners(grid: np.ndarray, keys: np.ndarray, owners: np.ndarray, match: int = MATCH, folder: str | None = None) -> np.ndarray:
    """For distinct piece records: the least owner of each of their windows, piece by piece.

    An anchor with one distinct piece is a collection of one document: its windows are the piece's own. The other
    pieces are trimmed to the windows that can match another piece's, and the distinct records of these are ordered."""
    windows = grid[:, -1].astype(np.int64)
    base = np.cumsum(windows) - windows
    out = np.repeat(owners, windows)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[number] > 1)
    if not len(rows):
        return out
    first, count = trimmed(grid[rows], match)
    rows, first, count = rows[count > 0], first[count > 0], count[count > 0]
    width = grid.shape[1] - 1
    part = piece_bytes(grid[rows, :-1].ravel(), np.arange(len(rows)) * width + first, count, match, 2 * match - width)
    kept, which = distinct(np.concatenate([part, np.ascontiguousarray(keys[rows]).view(np.uint8).reshape(len(rows), 8)], axis=1))
    least = np.full(len(kept), LAST)
    np.minimum.at(least, which, owners[rows])
    found = ordered_owners(part[kept], keys[rows][kept], least, match, folder)
    own = np.cumsum(count[kept]) - count[kept]
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(base[rows] + first, count) + inside] = found[np.repeat(own[which], count) + inside]
    return out


def ordered_owners(grid: np.ndarray, keys: np.ndarray, owners: np.ndarray, match: int = MATCH, folder: str | None = None) -> np.ndarray:
    """least_owners by the column-wise order of the records.

    Records are taken in order of their anchors, in collections that never part an anchor; the columns of one
    with more than MEMORY_ENTRIES entries are files in `folder`."""
    windows = grid[:, -1].astype(np.int64)
    base = np.cumsum(windows) - windows
    out = np.repeat(owners, windows)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(keys, kind="stable")
    order = order[count[number[order]] > 1]
    sizes = windows[order] + match - 1
    turn = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, np.int64)
    heads = [0]
    total = np.concatenate([[0], np.cumsum(sizes)])
    for at in turn.tolist():
        if at and total[at] - total[heads[-1]] >= COLLECTION_BYTES:
            heads.append(at)
    for low, high in zip(heads, [*heads[1:], len(order)]):
        if low == high:
            continue
        rows, size = order[low:high], sizes[low:high]
        block = grid[rows, :-1]
        data = block[np.arange(block.shape[1]) < size[:, None]]
        order_of = ColumnOrder(data, size, match, Files(folder) if folder and len(data) + len(size) > MEMORY_ENTRIES else None)
        try:
            _least_of_runs(order_of, match, rows, size, owners, base, out)
        finally:
            order_of.close()
    return out


# The distributed stages


def cut_blocks(docs: DataFrame) -> DataFrame:
    """Documents as compressed blocks, in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"block": [number], "ids": [ids], "sizes": [[len(x) for x in texts]], "data": [squeeze(b"".join(texts))]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id if isinstance(doc_id, str) else None)
                texts.append(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
                total += len(texts[-1])
                if total >= BLOCK_BYTES:
                    yield row()
                    number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield row()

    return materialize(text_rows(docs).mapInPandas(run, BLOCK_SCHEMA), "blocks")


def _by_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows dealt by block to as many partitions as the table of blocks asks for."""
    return rows.repartition(partitions_for(blocks, TASK_BYTES), "block")


def _by_parts(rows: DataFrame, parts: int) -> DataFrame:
    """rows dealt by part, one or a few parts to each partition however many there are."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // PARTS_A_TASK), "part")


def _load(ids: list, sizes: list, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = np.array([LAST if x is None else int(x) for x in ids], np.int64)
    return owner, np.array(sizes, np.int64), np.frombuffer(unsqueeze(bytes(data)), np.uint8)


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, part numbers, bounds) of keys dealt to parts, in order of part and key."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    part = part[order]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, part[heads], np.append(heads, len(part))


def _anchor_sets(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct anchors, number of each piece's, whether two documents hold it)."""
    distinct_keys, number = np.unique(key, return_inverse=True)
    low = np.full(len(distinct_keys), LAST)
    high = np.full(len(distinct_keys), -1)
    np.minimum.at(low, number, owner)
    np.maximum.at(high, number, owner)
    return distinct_keys, number, low != high


def _levels(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, number: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each anchor 0 if one document holds it, else 1 for up to LEVELS[1] distinct pieces, 2 for up to LEVELS[2], 3 for more."""
    held = np.flatnonzero(many[number])
    _, first = np.unique(piece_names(raw, start[held], windows[held], key[held]), return_index=True)
    pieces = np.bincount(number[held[first]], minlength=len(many))
    return many * (1 + np.searchsorted(LEVELS[1:3], pieces)).astype(np.uint8)


def _pack_keys(keys: np.ndarray, parts: int) -> bytes:
    """KEY_BYTES bytes of each anchor beyond what its part says."""
    return np.ascontiguousarray((keys // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :KEY_BYTES] = raw
    return wide.view("<u8").ravel()


def _pack_two(values: np.ndarray) -> bytes:
    """Values 0 .. 3 as two rows of bits."""
    return np.packbits(np.stack([values & 1, values >> 1])).tobytes()


def _unpack_two(data: bytes, count: int) -> np.ndarray:
    low, high = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * count).reshape(2, count)
    return low | high << 1


def send_anchors(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ids, sizes, data in zip(batch["block"], batch["ids"], batch["sizes"], batch["data"]):
                _, sizes, raw = _load(ids, sizes, data)
                start, windows, key, owner = pieces_of(raw, sizes)
                keys, number, many = _anchor_sets(key, owner)
                level = _levels(raw, start, windows, key, number, many)
                order, part, bound = _by_part(keys, parts)
                keys, level = keys[order], level[order]
                yield pd.DataFrame(
                    {
                        "part": part, "block": np.full(len(part), block),
                        "keys": [_pack_keys(keys[a:b], parts) for a, b in zip(bound, bound[1:])],
                        "level": [_pack_two(level[a:b]) for a, b in zip(bound, bound[1:])],
                    }
                )

    return blocks.mapInPandas(run, "part int, block long, keys binary, level binary")


def shared_anchors(sent: DataFrame, parts: int) -> DataFrame:
    """For each block and part what is known of its anchors, in their order: 0 for one that no two documents
    share, 1 for a shared one, 2 for a hot one, of more than HOT_PIECES distinct pieces by the blocks' levels."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        raw = [_unpack_keys(x) for x in group["keys"]]
        keys = np.concatenate(raw)
        level = np.concatenate([_unpack_two(x, len(r)) for x, r in zip(group["level"], raw)])
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[number[level > 0]] = True
        pieces = np.bincount(number, weights=np.array(LEVELS, float)[level])
        state = (shared.astype(np.uint8) + (shared & (pieces > HOT_PIECES)))[number]
        ends = np.cumsum([len(r) for r in raw])
        return pd.DataFrame({"block": group["block"], "part": group["part"], "bits": [_pack_two(x) for x in np.split(state, ends[:-1])]})

    return _by_parts(sent, parts).groupBy("part").applyInPandas(run, "block long, part int, bits binary")


def _as_windows(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, key, document) of each window of some pieces as a piece of its own, under a hash of
    the whole window: what stands around a string that very many documents hold spreads over all parts."""
    total = np.cumsum(windows)
    spread = np.repeat(np.arange(len(windows)), windows)
    at = start[spread] + np.arange(len(spread)) - (total - windows)[spread]
    return at, np.ones(len(at), np.int64), span_hashes(raw, at, at + MATCH) >> np.uint64(6), owner[spread]


def _shared_pieces(ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, bits: dict[int, bytes], parts: int) -> tuple[np.ndarray, ...]:
    """A block's pieces with a shared anchor: (start, windows, anchor, document, number of its distinct piece),
    and of the distinct pieces, dealt to parts: (first place, part numbers, bounds). Those of hot anchors are cut
    into their windows. Pieces are found equal by a hash, and compared byte by byte."""
    start, windows, key, owner = pieces_of(raw, sizes)
    keys, number = np.unique(key, return_inverse=True)
    order, part, bound = _by_part(keys, parts)
    state = np.zeros(len(keys), np.uint8)
    for p, a, b in zip(part.tolist(), bound.tolist(), bound[1:].tolist()):
        state[order[a:b]] = _unpack_two(bits[p], b - a)
    own = state[number]
    kept = np.flatnonzero(own == 1)
    columns = [x[kept] for x in (start, windows, key, owner)]
    hot = np.flatnonzero(own == 2)
    if len(hot):
        columns = [np.concatenate(x) for x in zip(columns, _as_windows(raw, start[hot], windows[hot], owner[hot]))]
    start, windows, key, owner = columns
    _, first, which = np.unique(piece_names(raw, start, windows, key), return_index=True, return_inverse=True)
    words = loads(raw)
    same = (windows == windows[first][which]) & (key == key[first][which])
    if not same.all() or not equal_spans(words, start, words, start[first][which], windows + MATCH - 1).all():
        first, which = distinct(np.concatenate([piece_bytes(raw, start, windows), key.astype("<u8")[:, None].view(np.uint8)], axis=1))
    order, part, bound = _by_part(key[first], parts)
    back = np.empty(len(first), np.int64)
    back[order] = np.arange(len(first))
    return start, windows, key, owner, back[which], first[order], part, bound


def send_pieces(blocks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct pieces with a shared anchor, by part, with the least owner of each."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        bits = dict(zip(right["part"].tolist(), right["bits"]))
        for block, ids, sizes, data in zip(left["block"], left["ids"], left["sizes"], left["data"]):
            ids, sizes, raw = _load(ids, sizes, data)
            start, windows, key, owner, which, first, part, bound = _shared_pieces(ids, sizes, raw, bits, parts)
            grid = piece_bytes(raw, start[first], windows[first])
            least = np.full(len(first), LAST)
            np.minimum.at(least, which, ids[owner])
            for p, a, b in zip(part.tolist(), bound.tolist(), bound[1:].tolist()):
                rows.append((p, block, squeeze(grid[a:b].tobytes()), _pack_keys(key[first[a:b]], parts), squeeze(least[a:b].tobytes())))
        return pd.DataFrame(rows, columns=["part", "block", "a", "b", "c"])

    pairs = _by_block(blocks, blocks).groupBy("block").cogroup(_by_block(answers, blocks).groupBy("block"))
    return pairs.applyInPandas(run, "part int, block long, a binary, b binary, c binary")


def judge_pieces(sent: DataFrame, parts: int) -> DataFrame:
    """For each block and part the least owner of every window of its pieces, in their order."""
    width, folder = 2 * MATCH - K + 1, shared_root(sent.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        grids = [np.frombuffer(unsqueeze(x), np.uint8).reshape(-1, width) for x in group["a"]]
        counts = [len(x) for x in grids]
        grid = np.concatenate(grids)
        del grids
        first, number = distinct(grid)
        grid = grid[first]
        keys = np.concatenate([_unpack_keys(x) for x in group["b"]])[first]
        owners = np.full(len(first), LAST)
        np.minimum.at(owners, number, np.concatenate([np.frombuffer(unsqueeze(x), np.int64) for x in group["c"]]))
        least = least_owners(grid, keys, owners, folder=folder)
        windows = grid[:, -1].astype(np.int64)
        base = np.cumsum(windows) - windows
        out, at = [], 0
        for n in counts:
            own = number[at : at + n]
            size = windows[own]
            places = np.repeat(base[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append(squeeze(least[places].tobytes()))
            at += n
        return pd.DataFrame({"block": group["block"], "part": group["part"], "a": out})

    return _by_parts(sent, parts).groupBy("part").applyInPandas(run, "block long, part int, a binary")


def _removed(raw: np.ndarray, ids: np.ndarray, sizes: np.ndarray, start: np.ndarray, windows: np.ndarray, which: np.ndarray, least: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each byte of a block whether it goes; pieces are taken STEP / 2 at a time."""
    change = np.zeros(len(raw) + 1, np.int32)
    ends = np.cumsum(sizes)
    for low in range(0, len(start), STEP // 2):
        part = slice(low, low + STEP // 2)
        count = windows[part]
        spread = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(spread)) - (np.cumsum(count) - count)[spread]
        at = start[part][spread] + inside
        hit = at[least[base[which[part]][spread] + inside] < ids[np.searchsorted(ends, at, side="right")]]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + MATCH, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def settle(blocks: DataFrame, answers: DataFrame, judged: DataFrame, parts: int, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document; kept is its remaining bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        told = right["a"].notna()
        bits = dict(zip(right["part"][~told].tolist(), right["bits"][~told]))
        found = right[told].sort_values("part")["a"]
        for doc_ids, sizes, data in zip(left["ids"], left["sizes"], left["data"]):
            ids, sizes, raw = _load(doc_ids, sizes, data)
            gone = np.zeros(len(raw), bool)
            if len(found):
                start, windows, _, _, which, first, _, _ = _shared_pieces(ids, sizes, raw, bits, parts)
                least = np.concatenate([np.frombuffer(unsqueeze(x), np.int64) for x in found])
                size = windows[first]
                gone = _removed(raw, ids, sizes, start, windows, which, least, np.cumsum(size) - size)
            at = 0
            for doc_id, size in zip(doc_ids, sizes.tolist()):
                own_gone, own_raw = gone[at : at + size], raw[at : at + size]
                at += size
                n = int(own_gone.sum())
                spans = int(np.count_nonzero(own_gone[1:] & ~own_gone[:-1])) + int(own_gone[0]) if n else 0
                kept = own_raw[~own_gone].tobytes() if n else own_raw.tobytes()
                rows.append((doc_id, size, n, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        return pd.DataFrame(rows, columns=names)

    right = answers.unionByName(judged, allowMissingColumns=True)
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return id_back(_by_block(blocks, blocks).groupBy("block").cogroup(_by_block(right, blocks).groupBy("block")).applyInPandas(run, schema))


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Every document's bytes without those that repeat an earlier document's.

    One plan from the table of blocks: the exchange of the blocks serves both co-groups."""
    blocks = cut_blocks(docs)
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(blocks, PART_BYTES))
    answers = materialize(shared_anchors(send_anchors(blocks, parts), parts), "shared-anchors")
    judged = judge_pieces(send_pieces(blocks, answers, parts), parts)
    return settle(blocks, answers, judged, parts, texts)
