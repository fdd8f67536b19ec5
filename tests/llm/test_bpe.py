import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(5)
TEXTS = [None, "", "a<|endoftext|>b", "<|endoftext|>" * 2, "don't  you\n\n\tgo  ", "a" * 4000, "ab " * 3000, "日本語 テキスト 😀😀 ́é", "x\r\n\x0b\x0c\x1c\x85 z"]
TEXTS += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "1", "²", "é", "ß", "'s", "中", "🙂", "\t", ".", "_", "the"]) for _ in range(rng.randrange(80))) for _ in range(60)]


def test_round_trip_equals_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i if i else None, x, "c", 1) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], "c", 1)]
    got = op.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"), PATH)
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cache", [2, 1000])
def test_small_caches(cache):
    e = op.Encoder(op.Vocabulary(PATH), cache)
    t = Tokenizer.from_file(PATH)
    for x in TEXTS[1:]:
        ids = e.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids and e.decode(ids) == x


def test_tokens_and_back(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    tokens = op.tokenized(d, PATH, "doc_id")
    assert tokens.columns == ["doc_id", "n_tokens", "ids"]
    assert {r["doc_id"]: r["text"] for r in op.decoded(tokens, PATH, "doc_id").collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert op.tokenized(d.limit(0), PATH, "doc_id").count() == 0
