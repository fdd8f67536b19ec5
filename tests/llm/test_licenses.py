from quarry.llm import licenses as op
from tests.llm.test_decontamination import tokens

MIT = dict(op.TEMPLATES)["MIT"]


def brute(docs, templates):
    import math

    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = []
    for doc_id, text in docs:
        w, best = tokens(text), {}
        g = grams(w)
        for name, t in templates:
            have = grams(tokens(t))
            if not have:
                continue
            step = 2 ** math.ceil(math.log2(len(have) * 1.25))
            for j in range(0, max(1, len(g)), step):
                share = len(set(have) & set(g[j : j + 2 * step])) / len(set(have))
                if share >= 0.8:
                    best[name] = max(best.get(name, 0), share)
        out.append((doc_id, len(w), len(best), ",".join(sorted(best)), round(max(best.values(), default=0.0), 6)))
    return sorted(out, key=str)


def test_against_every_window(spark):
    near = MIT.split()
    near[30:33] = ["other", "words"]
    far = MIT.split()
    far[::6] = ["x"] * len(far[::6])
    docs = [(1, "lorem ipsum " * 300 + MIT + " dolor " * 50), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, "MIT License"), (7, "x\nReleased under the MIT License."), (None, "Licensed under the Apache License, Version 2.0."), (8, "a " * 30_000 + "Licensed under CC BY-NC 4.0."), (8, "a " * 30_000 + "Licensed under CC BY-NC 4.0.")]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, license string, start int")
    templates = [*op.TEMPLATES, ("short", "too few words"), ("none", None), (None, MIT), op.TEMPLATES[0]]
    t = spark.createDataFrame([(*x, "e") for x in templates], "license string, text string, scale string")
    got = op.licenses(d, t)
    assert got.columns == ["doc_id", "n_words", "n_licenses", "licenses", "contained"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, op.TEMPLATES)


def test_pivots_lose_no_candidate(spark):
    """Signing only windows that hold a pivot retrieves what signing all windows does."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i} " * i + MIT[i * 40 :]) for i in range(20)], "doc_id long, text string")
    known = op.prepared(op.default_templates(spark)).cache()
    every = known.select(F.explode("keys").alias("key"), "scale").groupBy("key").agg(F.collect_set("scale").alias("scales"))
    signed = known.select("license", "scale", F.explode(op._signature("keys")).alias("s")).select("license", "scale", "s.*")
    wide = op.windows(docs, every).where("scale is not null").withColumn("keys", op._keys("w"))
    want = wide.select("doc_id", "scale", "start", F.explode(op._signature("keys")).alias("s")).select("doc_id", "scale", "start", "s.*").join(signed, ["scale", "band", "least"]).select("doc_id", "start", "license").distinct()
    pivot = known.select("scale", F.explode("keys").alias("key")).select("scale", "key", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64("key", F.lit(b)).alias("least")) for b in range(op.BANDS)))).alias("s")).select("scale", "key", "s.*")
    pivot = pivot.join(signed.select("scale", "band", "least").distinct(), ["scale", "band", "least"], "left_semi").groupBy("key").agg(F.collect_set("scale").alias("scales"))
    few = op.windows(docs, pivot).where("scale is not null").withColumn("keys", op._keys("w"))
    got = few.select("doc_id", "scale", "start", F.explode(op._signature("keys")).alias("s")).select("doc_id", "scale", "start", "s.*").join(signed, ["scale", "band", "least"]).select("doc_id", "start", "license").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_empty(spark):
    d = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    assert op.licenses(d.limit(0), op.default_templates(spark)).count() == 0
    assert [r["n_licenses"] for r in op.licenses(d, op.default_templates(spark).limit(0)).collect()] == [0]
