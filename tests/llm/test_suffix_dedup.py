import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup as S


@pytest.mark.parametrize("files", [False, True])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_order_transform_and_prefixes(files, chunk, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(1)
    for _ in range(25):
        docs = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 10))]
        data, sizes = np.frombuffer(b"".join(docs), np.uint8), np.array([len(d) for d in docs])
        symbol, prefix, owner, length = S.column_order(data, sizes, 8, S.Files(f"file://{tmp_path}") if files else None)
        found = [docs[d][len(docs[d]) - n :] if n else b"" for d, n in zip(owner, length)]
        assert found == sorted(found) and len(found) == sum(sizes) + len(docs)
        alphabet = np.unique(data)
        for i, (d, n) in enumerate(zip(owner, length)):
            ahead = docs[d][len(docs[d]) - n - 1] if n < len(docs[d]) else None
            assert (alphabet[symbol[i] - 1] if symbol[i] else None) == ahead
        for i in range(1, len(found)):
            a, b, k = found[i - 1], found[i], 0
            while k < min(len(a), len(b), 8) and a[k] == b[k]:
                k += 1
            assert prefix[i] == k


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_least_owners_from_files(chunk, tmp_path, monkeypatch):
    rng = random.Random(6)
    base = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(3)]
    pieces = sorted({x[a : a + rng.randint(50, 80 - a)] for x in base for a in (0, 3, 9, 20, 30) for _ in range(4)})
    grid = S.piece_bytes(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces[:-1])]), np.array([len(x) - 49 for x in pieces]))
    owners = np.array([rng.randrange(100) for _ in pieces])
    first = {}
    for x, o in zip(pieces, owners.tolist()):
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(first.get(x[i : i + 50], o), o)
    want = [first[x[i : i + 50]] for x in pieces for i in range(len(x) - 49)]
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "MEMORY_ENTRIES", 0)
    assert S.least_owners(grid, np.zeros(len(pieces), np.uint64), owners, folder=str(tmp_path)).tolist() == want
    assert not any(tmp_path.iterdir())
    monkeypatch.setattr(S, "MEMORY_ENTRIES", 1 << 20)
    assert S.least_owners(grid, np.zeros(len(pieces), np.uint64), owners).tolist() == want


def test_files_keep_a_few_chunks_in_memory(tmp_path, monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    sizes = np.full(60_000, 50)
    data = rng.integers(97, 101, int(sizes.sum())).astype(np.uint8)
    monkeypatch.setattr(S, "CHUNK", 1 << 15)
    tracemalloc.start()
    order = S.ColumnOrder(data, sizes, 50, S.Files(str(tmp_path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    entries = sum(map(len, order.chunks()))
    order.close()
    assert entries == len(data) + len(sizes)
    # One byte an entry for the documents; all columns together would be seven, and their order eight more.
    assert peak < 4 * len(data) + 200 * len(sizes) and not any(tmp_path.iterdir())


def test_windows_lie_in_one_piece_each():
    rng = random.Random(2)
    docs = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 1000)]
    data, sizes = np.frombuffer(b"".join(docs), np.uint8), np.array([len(d) for d in docs])
    start, windows, key, owner = S.pieces_of(data, sizes)
    covered = sorted(at for s, n in zip(start, windows) for at in range(s, s + n))
    base = np.cumsum(sizes) - sizes
    assert covered == [b + i for b, n in zip(base, sizes) for i in range(max(0, n - 49))]
    again = S.pieces_of(np.frombuffer(docs[5], np.uint8), sizes[5:])
    assert set(again[2]) == set(key[owner == 5]) and windows.max() <= S.MATCH - S.K + 1


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha) by plain search; a null id is later than all."""
    first, out = {}, []
    for doc_id, text in rows:
        own, data = float("inf") if doc_id is None else doc_id, (text or "").encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            first[w] = min(first.get(w, float("inf")), own)
    for doc_id, text in rows:
        own, data = float("inf") if doc_id is None else doc_id, (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < own:
                gone[i : i + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        out.append((str(doc_id), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(docs).collect())


def test_against_plain_search(spark, nasty, none):
    short = nasty.where("doc_id is null or doc_id not in (6, 7)")
    assert found(short) == brute([(r["doc_id"], r["text"]) for r in short.collect()])
    assert S.remove_repeats(none).count() == 0


def test_passages_copies_and_overlaps(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            cut = rng.randrange(len(passage) - 60)
            text = text[:40] + passage[cut : cut + rng.randint(30, 160)] + text[40:]
        rows.append((rng.randrange(10_000), text))
        if i % 7 == 0:
            rows.append((rng.randrange(10_000), text))
    rows.append((20_000, "ab" * 200))
    rows.append((20_001, "ab" * 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_hot_anchors_and_names_that_collide(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(25))
    rows = [(rng.randrange(500), " ".join(word() for _ in range(rng.randint(0, 30))) + line + " ".join(word() for _ in range(rng.randint(0, 30)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids, sizes, raw = np.arange(80), np.array([len(t.encode()) for _, t in rows]), np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    want = brute(rows)
    start, windows, key, owner = S.pieces_of(raw, sizes)
    keys, number, many = S._anchor_sets(key, owner)
    level = S._levels(raw, start, windows, key, number, many)
    assert set(level) == {0, 1, 2} and (S._unpack_two(S._pack_two(level), len(level)) == level).all()
    real_pieces, real_windows = S._shared_pieces, S._as_windows
    order, part, bound = S._by_part(keys, 3)
    for state in (1, 2):
        bits = {int(p): S._pack_two(np.full(b - a, state, np.uint8)) for p, a, b in zip(part, bound, bound[1:])}
        monkeypatch.setattr(S, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))  # every name collides
        start, windows, _, _, which, first, _, _ = real_pieces(ids, sizes, raw, bits, 3)
        text = [bytes(raw[s : s + w + 49]) for s, w in zip(start, windows)]
        assert all(text[i] == text[first[which[i]]] for i in range(len(text))) and len(set(text)) <= len(first)
        monkeypatch.undo()
    assert real_windows(raw, np.array([3]), np.array([4]), np.array([1]))[0].tolist() == [3, 4, 5, 6]
    assert found(docs) == want


def test_windows_of_hot_anchors_give_the_same_result(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(25))
    rows = [(i, " ".join(word() for _ in range(12)) + line + " ".join(word() for _ in range(12))) for i in range(40)]
    blocks = S.cut_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    known = S.materialize(S.shared_anchors(S.send_anchors(blocks, 4), 4), "test-anchors").collect()
    hot = []
    for r in known:
        hot.append((r["block"], r["part"], bytes(r["bits"])))
    sent = {(r["block"], r["part"]): len(bytes(r["keys"])) // S.KEY_BYTES for r in S.send_anchors(blocks, 4).collect()}
    swapped = [(b, p, bytearray(S._pack_two(np.where(S._unpack_two(x, sent[b, p]) > 0, 2, 0).astype(np.uint8)))) for b, p, x in hot]
    answers = S.materialize(spark.createDataFrame(swapped, "block long, part int, bits binary"), "test-hot")
    judged = S.judge_pieces(S.send_pieces(blocks, answers, 4), 4)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.settle(blocks, answers, judged, 4).collect())
    assert got == brute(rows)


def test_long_documents_and_kept_bytes(nasty):
    rows = {r["doc_id"]: r for r in S.remove_repeats(nasty.where("doc_id in (6, 7)"), texts=True).collect()}
    assert rows[6]["n_removed"] == 0 and rows[7]["n_removed"] == rows[7]["n_bytes"] and rows[7]["n_spans"] == 1 and bytes(rows[7]["kept"]) == b""


def test_only_windows_that_can_match_enter_the_order(monkeypatch):
    rng = random.Random(11)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    anchor, passage = text(20), text(60)
    pieces = [text(30) + anchor + text(30) for _ in range(200)]  # one anchor, no window in common
    pieces += [text(10) + passage + text(10), text(20) + passage, passage[5:] + text(10)]  # eleven and six windows in common
    grid = S.piece_bytes(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces[:-1])]), np.array([len(x) - 49 for x in pieces]))
    owners = np.arange(len(pieces))[::-1].copy()
    first = {}
    for x, o in zip(pieces, owners.tolist()):
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(first.get(x[i : i + 50], o), o)
    entered, real = [], S.ColumnOrder
    monkeypatch.setattr(S, "ColumnOrder", lambda data, sizes, *rest: entered.append(len(data)) or real(data, sizes, *rest))
    got = S.least_owners(grid, np.zeros(len(pieces), np.uint64), owners)
    assert got.tolist() == [first[x[i : i + 50]] for x in pieces for i in range(len(x) - 49)]
    assert 0 < sum(entered) <= 3 * 80  # of 16 225 bytes
