import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard_join as op
from quarry.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k=3, percent=90):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((docs[i][0] for i in m if docs[i][0] is not None), default=None) for g, m in groups.items()}
    return [(docs[i][0], len(sets[i]), least[find(i)] if sets[i] else docs[i][0]) for i in range(len(docs))]


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.6:  # a copy, near or exact
            w = (docs[rng.randrange(min(len(docs), 12))][1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w = w or ["x"]
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 60, 120]))]
            if kind > 0.8:
                w[rng.randrange(len(w)) :] += passage
        docs.append((i, " ".join(w)))
    return docs


FIXED = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b c " * 4000), (907, "A B C " * 4001), (None, "one"), (905, "one two"), (None, None), (801, "É b c d"), (802, "é b c d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed) + FIXED
    d = spark.createDataFrame([(i, t, "c", 7) for i, t in docs], "doc_id long, text string, f1 string, row int")
    got = op.jaccard_components(d)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs), key=str)


def links(docs, k, percent):
    sets = {frozenset(shingles(t, k)) for _, t in docs} - {frozenset()}
    return sets, {frozenset((a, b)) for a in sets for b in sets if a != b and 100 * len(a & b) >= percent * len(a | b)}


@pytest.mark.parametrize(("long", "frequent"), [(1024, 0.0), (1024, 1000.0), (3, 0.0), (2, 1000.0)])
def test_candidates_lose_no_link(monkeypatch, long, frequent):
    """Every linking pair of classes is a candidate: whatever matches sets ask for, in runs of any length, by small batches."""
    monkeypatch.setattr(op, "LONG", long)
    docs = corpus(3, 150)
    sets, want = links(docs, 5, 80)
    texts = {frozenset(shingles(t, 5)): t for _, t in docs}
    rows, name, bits = [], {}, {}
    for s in sets:
        tokens = next(op.shingle_sets(pa.array([texts[s]]), 5))
        f = op.fingerprint(tokens)
        name[f], bits[f] = s, op.folded(op.bitmap(tokens))
        place, match = op.prefix(tokens, np.full(op.BUCKETS, frequent), 80)
        assert match == (1 if frequent == 0 else min(op.MOST, -(-80 * len(tokens) // 100)))
        rows += [(int(t), *f, len(tokens), 8 * i + match) for i, t in enumerate(place.view(np.int64).tolist())]
    rows.sort(key=lambda r: (r[0], r[3], r[1], r[2]))
    kinds = {"token": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "n": pa.int32(), "at": pa.int32()}
    post = [pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in rows[i : i + 7]], t) for j, (c, t) in enumerate(kinds.items())}) for i in range(0, len(rows), 7)]
    shared = [r for b in op._shared(iter(post), 80) for r in b.to_pylist()]
    own = sorted((r for r in shared if r["kind"] == 0), key=lambda r: (r["token"], r["cell"], r["role"], r["n"], r["f1"], r["f2"]))
    order = {f: i for i, f in enumerate(name)}
    kinds |= {"cell": pa.int32(), "role": pa.int32(), "comp": pa.int64(), "bits": pa.binary()}
    full = [r | {"comp": order[r["f1"], r["f2"]], "bits": bits[r["f1"], r["f2"]]} for r in own]
    dealt = [pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in full[i : i + 5]], t) for c, t in kinds.items()}) for i in range(0, len(full), 5)]
    met = {}
    for r in (r for b in op._crossed(iter(dealt), 80) for r in b.to_pylist()):
        pair = frozenset((name[r["a1"], r["a2"]], name[r["b1"], r["b2"]]))
        assert len(pair) == 2 and met.get(pair, (0, r["need"]))[1] == r["need"]
        met[pair] = met.get(pair, (0, 0))[0] + 1, r["need"]
    got = {p for p, (n, need) in met.items() if n >= need}
    assert len(want) > 50 and want <= got
    if long < 10:
        assert max(r["cell"] for r in own) > 2
    stars = [r for r in shared if r["kind"] == 1]
    assert stars and len(stars) <= 2 * len(own)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [16, 64, 1024, 2048, 4096])
def test_structured_words_do_not_collide(n):
    a, b = thue_morse(n)
    one, two = op.shingle_sets(pa.array([a, b]), 3)
    assert one.tolist() != two.tolist()


def test_structured_words_do_not_link(spark):
    rows = [(2 * i + j, w) for i, n in enumerate((1024, 2048, 4096)) for j, w in enumerate(thue_morse(n))]
    got = op.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, 1, i) for i in range(6)]


def test_long_text_and_hot_shingle(spark):
    """One text of 10 MB, and a shingle that many unlinked texts hold."""
    rows = [(i, f"all of them {i} x{i} y{i}") for i in range(3000)] + [(9000, "long text here " * 700_000), (9001, "long text here " * 9)]
    got = {r["doc_id"]: r["component_id"] for r in op.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(3000)} | {9000: 9000, 9001: 9000 if shingles("long text here " * 9, 3) == shingles("long text here " * 4, 3) else 9001}


def test_prefixes_lengthen_with_frequency():
    tokens = np.arange(100, dtype=np.uint64) << np.uint64(46)
    rare, frequent = np.zeros(op.BUCKETS), np.zeros(op.BUCKETS)
    frequent[:100] = 1000.0
    assert op.prefix(tokens, rare)[1] == 1 and len(op.prefix(tokens, rare)[0]) == 11
    assert op.prefix(tokens, frequent)[1] > 1


def test_keep_one(spark):
    docs = corpus(4, 100) + FIXED
    d = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, block int, n string")
    got = op.keep_one(d)
    assert got.columns == d.columns
    want = brute(docs, 5, 80)
    kept = sorted((r["doc_id"] for r in got.collect()), key=str)
    stay = [i for i, n, c in want if n == 0] + sorted({c for i, n, c in want if n and c is not None})
    assert kept == sorted(stay, key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert op.jaccard_components(d).count() == 0 and op.keep_one(d).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (45, 50), (60, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 45: 40, 50: 40}


def test_components_of_any_graph(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 440)] + [(500 - i, 499 - i) for i in range(40)]
    least = {n: n for p in pairs for n in p if p[0] != p[1]}
    while any(least[a] != least[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    struct = [((a, -a), (b, -b)) for a, b in pairs]
    links = spark.createDataFrame(struct, "a struct<x: long, y: long>, b struct<x: long, y: long>")
    assert {r["node"]["x"]: r["component"]["x"] for r in components(links).collect()} == least


def test_components_of_stars_take_few_jobs(spark):
    """What the driver holds follows the jobs; stars need no round."""
    context = spark.sparkContext

    def jobs(links):
        context.setJobGroup(name := f"components {len(links)}", name)
        try:
            got = components(spark.createDataFrame(links, "a long, b long"))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        n = len(context.statusTracker().getJobIdsForGroup(name))
        return n, {r["node"]: r["component"] for r in got.collect()}

    n, got = jobs([(i, i % 3) for i in range(3, 90)])
    assert got == {i: i % 3 for i in range(90)} and n <= 5
    _, got = jobs([(i, i % 3) for i in range(3, 90)] + [(7, 0)])
    assert got == {i: 0 if i % 3 < 2 else 2 for i in range(90)}
