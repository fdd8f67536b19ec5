import corpus_pipeline
from quarry.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "bpe"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name != "bpe":
            assert docs.columns == columns
        n = docs.count()
        assert n == before if name in ("secrets", "bpe") else before * 0.6 < n < before
        before = n
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
