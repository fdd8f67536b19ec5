import hashlib
import re

from quarry.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(documents, benchmark):
    grams = {}
    for item, text in benchmark:
        w = tokens(text)
        if not w:
            continue
        n = min(10, len(w))
        for p in range(len(w) - n + 1):
            grams.setdefault(tuple(w[p : p + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in documents:
        w, hit, items = tokens(text), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if found := grams.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "One two THREE four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"Before {PASSAGE.lower()}, after. Été ÉTÉ"),
    (2, "one two three four five six seven eight nine"),
    (3, None), (4, ""), (5, "..."), (None, PASSAGE), (7, "x short item, y"), (7, "x short item, y"),
    (8, (PASSAGE + " ") * 30 + "é short ITEM " + "w " * 5000), (9, "a" * 100_000),
]
ITEMS = [(1, PASSAGE), (10, f"more {PASSAGE}"), (2, "short item"), (3, None), (4, "!!"), (None, "nine"), (2, "short item")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, row string, key int")
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, w int")


def test_against_brute_force(spark):
    d, b = frames(spark, DOCS, ITEMS)
    got = op.contamination(d, b)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    d, b = frames(spark, DOCS, ITEMS)
    assert sorted(map(tuple, op.contamination(d, b).collect()), key=str) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    d, b = frames(spark, DOCS, [])
    assert not any(r["contaminated"] for r in op.contamination(d, b).collect())
    d, b = frames(spark, [], ITEMS)
    assert op.contamination(d, b).count() == 0


def test_removal(spark):
    d, b = frames(spark, DOCS, ITEMS)
    clean = {r["doc_id"] for r in op.decontaminate(d, b, remove="documents").collect()}
    assert clean == {3, 4, 5, 9}
    spans = op.decontaminate(d, b)
    assert spans.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in spans.collect()}
    assert texts[1] == "Before, after. Été ÉTÉ" and texts[3] is None and texts[7] == "x, y" and texts[2] == "one two three four five six seven eight"


def test_item_without_id(spark):
    d, b = frames(spark, [(1, PASSAGE)], [(None, PASSAGE)])
    got = op.contamination(d, b).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(12, 1, True)]


def test_removal_beyond_the_broadcast_bound(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    d, b = frames(spark, DOCS, ITEMS)
    assert {r["doc_id"] for r in op.decontaminate(d.repartition(3), b, remove="documents").collect()} == {3, 4, 5, 9}


def test_native(spark):
    d, b = frames(spark, DOCS, ITEMS)
    plan = op.contamination(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
