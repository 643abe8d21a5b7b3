import hashlib
import random
import re

import pytest

from corpusloom.llm import decontaminate as D
from tests.llm.conftest import prose

WORD = re.compile(D.WORD)


def split(text):
    return WORD.findall((text or "").translate(str.maketrans(D.UPPER, D.LOWER)))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit.update(range(k, k + size))
                    names |= own
        out.append((str(doc), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows_of(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in frame.collect())


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    items = [(k, prose(300 + k, rng.randint(11, 40))) for k in range(15)] + [(50, "Trois mots seuls"), (51, ""), (52, None), (None, prose(999, 12)), (53, "Trois mots seuls"), (54, prose(300, 11)), (55, "le le le le le le le le le le le le")]
    docs = []
    for k in range(60):
        text = prose(700 + k, rng.randint(0, 120))
        if k % 3 == 0:
            own = items[rng.randrange(15)][1].split(" ")
            cut = rng.randrange(len(own) - 9)
            text = text[:50] + ", " + " ".join(own[cut : cut + rng.randint(6, 20)]).upper() + ". " + text[50:]
        docs.append((k, text))
    docs += [(100, "on dit TROIS, mots; seuls. trois mots"), (101, None), (102, ""), (103, "le " * 15), (103, "le " * 15), (None, items[2][1])]
    return docs, items


def frames(spark, planted):
    docs, items = planted
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_against_plain_windows(spark, planted):
    assert rows_of(D.report(*frames(spark, planted))) == brute(*planted)


@pytest.mark.parametrize("name", ["BROADCAST_BYTES", "LITERAL_ANCHORS"])
def test_without_broadcast_or_literals(spark, planted, monkeypatch, name):
    monkeypatch.setattr(D, name, 0)
    assert rows_of(D.report(*frames(spark, planted))) == brute(*planted)


def test_plan_has_no_python(spark, planted):
    plan = D.report(*frames(spark, planted))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_removal(spark, planted):
    docs, items = frames(spark, planted)
    marked = {r[0] for r in brute(*planted) if r[5]}
    kept = {str(r["doc_id"]) for r in D.remove_documents(docs, items).collect()}
    assert kept == {str(d) for d, _ in planted[0]} - marked
    cut = {str(r["doc_id"]): r["text"] for r in D.remove_spans(docs, items).collect()}
    assert cut["100"] == "on dit . trois mots" and cut["101"] is None and cut["103"].strip() == ""
    before = {str(d): t for d, t in planted[0]}
    for doc, _, n_hit, _, _, hit in brute(*planted):
        assert len(split(cut[doc])) == len(split(before[doc])) - n_hit and (hit or cut[doc] == before[doc])


def test_defined_cases(spark, nasty, none, planted):
    _, items = frames(spark, planted)
    clash = items.selectExpr("item_id", "text", "'x' as doc_id", "'y' as anchor", "'z' as row")
    got = rows_of(D.report(nasty, clash))
    assert got == brute([(r["doc_id"], r["text"]) for r in nasty.collect()], planted[1])
    assert D.report(none, items).count() == 0
    assert not any(r["contaminated"] for r in D.report(nasty, items.limit(0)).collect())
    assert D.remove_documents(nasty, items).columns == nasty.columns == D.remove_spans(nasty, items).columns
    odd = nasty.selectExpr("*", "'i' as _id", "'k' as _key", "'r' as _runs", "n_chars as `a.b`")
    for out in (D.remove_documents(odd, items), D.remove_spans(odd, items)):
        assert out.columns == odd.columns and {(r["_id"], r["_key"], r["_runs"], r["n"]) for r in out.collect()} == {("i", "k", "r", "clash")}


def test_a_long_document_of_benchmark_words_alone(spark):
    """40 000 words that are all hit, in runs that a free word parts: linear in time, and each run is cut."""
    item = prose(77, 40)
    text = " libre ".join([item] * 1000)
    docs = spark.createDataFrame([(1, text), (1, "libre " + item), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = sorted(rows_of(D.report(docs, items)))
    assert [r[2] for r in rows if r[0] == "1"] in ([40, 40_000], [40_000, 40])
    cut = sorted((r["doc_id"], r["text"] or "") for r in D.remove_spans(docs, items).collect())
    assert cut == sorted([(1, " libre " * 999), (1, "libre "), (2, "")])
