"""Substring dedup by words and suffix dedup by bytes against brute force."""

import hashlib
import random

import pytest

from quarry.llm import repeats, substring_dedup, suffix_dedup


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "é", "the", "of"] + [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 30, 60]))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [rng.choice(words) for _ in range(rng.randrange(0, 30))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    docs += [(70, docs[5][1]), (71, docs[5][1]), (71, docs[5][1]), (None, docs[5][1]), (None, docs[6][1]), (72, None), (73, ""), (74, "x " * 13), (75, "ab" * 400), (76, "ab" * 300), (77, "z" * 100), (78, "z" * 101)]
    docs += [(80, "lorem ipsum dolor " * 2000), (0, docs[5][1])]
    rng.shuffle(docs)
    return docs


def key(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def brute_words(docs):
    lists = [(t or "").encode().split() for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, lists, strict=True):
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(docs, lists, strict=True):
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < key(i):
                gone |= set(range(p, p + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs):
    texts = [(t or "").encode() for _, t in docs]
    first = {}
    for (i, _), t in zip(docs, texts, strict=True):
        for p in range(len(t) - 99):
            g = t[p : p + 100]
            first[g] = min(first.get(g, (key(i), p)), (key(i), p))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] < (key(i), p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for p in range(len(t)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", 5) for i, t in docs], "doc_id long, text string, h string, row int").repartition(3)


@pytest.mark.parametrize("hot", [5000, 3])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(1)
    got = substring_dedup.digests(frame(spark, docs))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(docs)


@pytest.mark.parametrize("hot", [5000, 3])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(2)
    got = suffix_dedup.digests(frame(spark, docs))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(docs)


def test_outputs(spark):
    docs = corpus(1)
    words = {(r["doc_id"], hashlib.sha256(" ".join((r["text"] or "").split()).encode()).hexdigest()) for r in substring_dedup.deduplicated(frame(spark, docs)).collect()}
    assert words == {(r[0], r[3]) for r in brute_words(docs)}
    kept = {(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.deduplicated(frame(spark, docs)).collect()}
    assert kept == {(r[0], r[4]) for r in brute_bytes(docs)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.digests(none).count() == 0 and suffix_dedup.digests(none).count() == 0


def test_chunks_of_long_texts(monkeypatch):
    import numpy as np

    grams = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    valid = np.ones(392, bool)
    valid[100:108] = False  # where two texts meet
    owner = lambda r: {q: p for p, a, b in zip(*r, strict=True) for q in range(a, b + 1)}
    whole = owner(repeats.anchors(grams, 9, valid))
    monkeypatch.setattr(repeats, "CHUNK", 37)
    assert owner(repeats.anchors(grams, 9, valid)) == whole and len(whole) == 384


def test_loser_tree():
    rng = random.Random(3)
    for _ in range(200):
        runs, keys = [], []
        for _ in range(rng.randrange(1, 9)):
            run = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))), 0, rng.randrange(5), 0) for _ in range(rng.randrange(12)))
            runs.append(suffix_dedup.front_coded(run))
            keys += [r[0] for r in run]
        out = list(suffix_dedup.merged([suffix_dedup.decoded(b) for b in runs]))
        assert [r[1] for r in out] == sorted(keys)
        assert all(b[0] == suffix_dedup.common_prefix(a[1], b[1]) for a, b in zip(out, out[1:], strict=False))


def test_many_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FAN", 3)
    runs = [suffix_dedup.front_coded([(bytes([i, j]), 0, i, j) for j in range(3)]) for i in range(20)]
    assert [r[1] for r in suffix_dedup.merge_all(runs)] == [bytes([i, j]) for i in range(20) for j in range(3)]
