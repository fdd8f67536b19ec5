import zlib

import numpy as np

from quarry.llm import toxicity as op

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op.toxicity(d, l).join(l, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    assert len(got) > 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    p = np.array([r["predicted"] for r in got])
    assert auc > 0.95 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.8
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_defined_cases(spark):
    rows = [(i, f"you are an idiot number {i} and a moron" if i % 3 == 0 else f"a fine day number {i} for all of us", "x", 1.0) for i in range(300)]
    rows += [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (None, "you idiot moron", "x", 1.0), (5, "again", "x", 1.0), (1002, "a fine day " * 20000, "x", 1.0), (1003, "you ID1OT! m*ron", "x", 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(7, 1, 0), (8, 1, None), (None, 1, 1), (1000, 0, 0)]
    got = op.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    known = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 5]
    assert np.mean([(r["doc_id"] % 3 == 0) == r["predicted"] for r in known]) > 0.97


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    got = op.toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r["score"] for r in got] == [0.0, 0.0]
    assert op.toxicity(d.limit(0), spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_folds_agree(spark):
    from pyspark.sql import functions as F

    d = spark.range(200).selectExpr("id AS doc_id", "1 AS toxic")
    got = {r["doc_id"]: r["fold"] for r in op._labelled(d).collect()}
    assert got == {i: op.fold_of(i) for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert d.where(op.held_out(F.col("doc_id"))).count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200))


def test_one_rule_at_every_size(spark):
    """With one label more the scores move a little, wherever the number of labels stands."""
    rows = [(i, f"you are an idiot number {i} and a moron" if i % 3 == 0 else f"a fine day number {i} for all of us") for i in range(2400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    few = [r["score"] for r in op.toxicity(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")).orderBy("doc_id").collect()]
    many = [r["score"] for r in op.toxicity(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2400)], "doc_id long, toxic int")).orderBy("doc_id").collect()]
    assert max(abs(a - b) for a, b in zip(few, many, strict=True)) < 0.1


def test_columns_and_text_once(spark):
    d = spark.createDataFrame([(1, "you idiot", 7), (2, None, 8)], "doc_id long, text string, row int")
    model = op.Model({}, None, None)
    assert [tuple(r) for r in op.scored(d, model, "row", "text").orderBy("row").collect()] == [(7, "you idiot", 0.0, 0), (8, None, 0.0, 0)]
    assert op.scored(d, model, "row", "text")._jdf.queryExecution().optimizedPlan().toString().count("text#") < 6


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    b = op.Boosted().fit(x, y)
    assert ((b.margin(x) > 0) == (y == 1)).mean() > 0.98
    at, p = op.isotonic(b.margin(x), y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= -1e-12).all()
