"""Findings that go back to rows by block, and where the shared folder is."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import aligned, common


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_findings_meet_their_rows(spark, table):
    docs = aligned.keyed(table, F.col("doc_id"))
    path = aligned.by_block(docs.where("doc_id % 7 = 0").select("block", "row", (F.col("doc_id") * 10).alias("found")), "test")

    def run(batches):
        import pyarrow as pa

        for batch, found in aligned.located(batches, path):
            rows = batch.column("row").to_numpy()
            value = dict(zip(found.column("row").to_pylist(), found.column("found").to_pylist(), strict=True)) if found is not None else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "found": pa.array([value.get(r) for r in rows.tolist()], pa.int64())})

    got = dict(map(tuple, docs.mapInArrow(run, "doc_id long, found long").collect()))
    assert got == {i: 10 * i if i % 7 == 0 else None for i in range(40_000)}


def test_keys_do_not_depend_on_splits(spark, table):
    key = lambda: {r["doc_id"]: (r["block"], r["row"]) for r in aligned.keyed(table, F.col("doc_id")).collect()}
    before = key()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert key() == before and len(set(before.values())) == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_what_is_no_scan_is_written_first(spark, table):
    assert aligned.is_scan(table) and aligned.is_scan(table.where("doc_id > 5").select("text"))
    for df in (table.repartition(2), table.join(table.select("doc_id"), "doc_id"), spark.range(3), table.select(F.explode(F.array("doc_id", "doc_id")))):
        assert not aligned.is_scan(df)
    twice = aligned.keyed(table.select(F.explode(F.array("doc_id", "doc_id")).alias("x")), F.col("x")).collect()
    assert len({(r["block"], r["row"]) for r in twice}) == 80_000


def test_missing_folder_is_an_error(spark, table):
    path = aligned.by_block(aligned.keyed(table).limit(5), "gone")
    aligned.Findings(path)
    shutil.rmtree(path.removeprefix("file://"))
    with pytest.raises(FileNotFoundError):
        aligned.Findings(path)
    with pytest.raises(ValueError, match="names no file system"):
        aligned.file_system("/a/path/without/scheme")


def test_shared_folder(spark):
    assert common.qualified(spark, "/some/where") == "file:///some/where"
    assert common.qualified(spark, "file:/some/where") == "file:///some/where"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")  # a default that is not the local one
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert common.qualified(spark, "/in/there") == "viewfs://store/in/there"
    finally:
        conf.set("fs.defaultFS", old or "file:///")


def test_no_folder_of_the_driver_on_a_cluster():
    class Context:
        master = "spark://elsewhere:7077"
        _conf = {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_word_hashes():
    import pyarrow as pa

    texts = ["a bb", None, "", " \t", "ccc a", "x" * 200 + " bb"]
    data, offsets = common.buffer_of(pa.array(texts))
    starts, ends, first = common.words_of(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bb", "ccc", "a", "x" * 200, "bb"]
    assert first.tolist() == [0, 2, 2, 2, 2, 4, 6]
    h = common.word_hashes(data, starts, ends).tolist()
    assert h[0] == h[3] and h[1] == h[5] and len(set(h)) == 4
    assert not set(h) & set(common.word_hashes(data, starts, ends, 1).tolist())
    assert np.array_equal(common.words_of(*common.buffer_of(pa.array([], pa.string())))[2], [0])
