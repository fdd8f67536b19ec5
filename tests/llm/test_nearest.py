import numpy as np
from pyspark.sql import functions as F

from quarry.llm import nearest as op

SF = "/root/testdata/sf0.001"


def brute(ids, x, asked, k=5):
    x = np.asarray(x, float)
    out = {}
    for q in np.flatnonzero(asked):
        score = op.cosine(x, x[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = found(op.search(v, F.col("id") % 50 == 0))
    rows = v.orderBy("vec_id").collect()
    want = brute(np.array([r["vec_id"] for r in rows]), [r["embedding"] for r in rows], np.array([r["vec_id"] % 50 == 0 for r in rows]))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in near if i in exact)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_every_list_is_exact_but_for_chance(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[100:160] = x[0]  # ties
    d = spark.createDataFrame([(i, [float(c) for c in r], "s", 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, list string, d int")
    got = found(op.search(d, F.col("id") % 50 == 0, probes=10**9))
    want = brute(np.arange(400), x, np.arange(400) % 50 == 0)
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.98 * 40


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, []), (50, [1e200, 1e200]), (50, [1e200, 1e200])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(op.search(d, F.col("id") % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 50, 50, 2] and sorted(i for i, _ in got[50]) == [0, 0, 1, 1, 2, 2, 50, 50]  # each row of id 50 finds the other
    assert got[0][0][1] == 1.0 and abs(got[0][1][1] - 0.5**0.5) < 1e-15
    assert op.search(d.limit(0), F.col("id") % 50 == 0).count() == 0


def test_abandoning_loses_little(spark):
    """Scans of column blocks against brute force, with bounds that are carried on."""
    rng = np.random.default_rng(5)
    x = op._unit(rng.standard_normal((3000, 96))) @ op._rotation(96)
    q = x[:50] + 0.05 * rng.standard_normal((50, 96))
    gap = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.argsort(gap, axis=1)[:, :5]
    blocks = [x[:, lo : lo + op.STEP] for lo in range(0, 96, op.STEP)]
    for bound in (np.full(50, np.inf), np.sort(gap, axis=1)[:, 4] + 1e-9):
        a, b = op.scan(blocks, q, bound, np.full(50, -1), 5)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert sum((i, j) in got for i in range(50) for j in want[i].tolist()) >= 0.98 * 250 and len(got) <= 300


def test_probes_follow_clusters(spark):
    rng = np.random.default_rng(6)
    flat = op._unit(rng.standard_normal((4000, 32)))
    middle = rng.standard_normal((60, 32))
    clustered = op._unit(middle[rng.integers(0, 60, 4000)] + 0.05 * rng.standard_normal((4000, 32)))
    few, many = (op.probes_for(x, op.centroids(x, 63)) for x in (clustered, flat))
    assert few < 10 < 30 < many
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(clustered[:2000])]
    got = found(op.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0))
    want = brute(np.arange(2000), clustered[:2000], np.arange(2000) % 50 == 0)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 200


def test_slots(spark, monkeypatch):
    monkeypatch.setattr(op, "SLOT", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    d = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(op.search(d, F.col("id") % 50 == 0, probes=10**9)), brute(np.arange(200), x, np.arange(200) % 50 == 0)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 18
