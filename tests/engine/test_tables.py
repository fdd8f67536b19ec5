import pytest
from pyspark.sql import functions as F

from quarry import functions as fn
from quarry.operators import multidex, resolve
from quarry.sources import dex
from tests.engine import images


def test_files(tables, folder):
    rows = {(r["path"].rsplit("/", 1)[1], r["entry_name"]): r for r in tables.files.collect()}
    assert rows["zero.dex", None]["parse_error"].startswith("invalid magic") and rows["tiny.dex", None]["parse_error"].startswith("buffer too small")
    assert "section string_ids" in rows["bounds.dex", None]["parse_error"] and rows["torn.apk", None]["parse_error"].startswith("zip error")
    entries = sorted((r["dex_ord"], e) for (p, e), r in rows.items() if p == "multi.apk")
    assert entries == [(0, "assets/x.dex"), (1, "classes.dex"), (2, "classes10.dex"), (3, "classes2.dex")]
    h = rows["mini.dex", None]["header"]
    assert h["version"] == 35 and h["file_size"] == len(images.mini().bytes()) == rows["mini.dex", None]["size"]


def test_sections(one):
    t, made = one("mini"), images.mini()
    assert [r["value"] for r in t.strings.orderBy("string_idx").collect()] == made.strings
    assert [r["descriptor"] for r in resolve.type_desc(t).orderBy("type_idx").collect()] == made.types
    assert [r["signature"] for r in resolve.proto_desc(t).orderBy("proto_idx").collect()] == made.protos
    got = [(r["class"], r["name"], r["signature"]) for r in resolve.method_desc(t).orderBy("method_idx").collect()]
    assert got == made.methods
    assert sorted((r["class"], r["type"], r["name"]) for r in resolve.field_desc(t).collect()) == sorted(made.fields)
    c = resolve.class_desc(t).first()
    assert (c["descriptor"], c["super_descriptor"], c["source_file"], c["method_count"]) == ("LMini;", "Ljava/lang/Object;", "Mini.java", 2)
    assert t.annotation_items.count() == t.annotation_sets.count() == t.annotation_dirs.count() == 1
    assert [bytes(r["value"]) for r in t.encoded_arrays.collect()] == [bytes([1, 0x04, 7])]
    assert t.call_sites.first()["call_site_off"] == 16 and t.method_handles.first()["handle_type"] == 4
    assert sorted((r["kind"], r["access_flags"]) for r in t.encoded_fields.collect()) == [("instance", 1), ("static", 2)]
    assert [r["pc"] for r in t.instructions.orderBy("pc").collect()] == [0, 2] and t.decode_errors.count() == 0
    assert resolve.overview(t).first()["string_count"] == len(made.strings)
    assert [r["method_idx"] for r in resolve.class_methods(t).orderBy("ord").collect()] == sorted(made.method[m] for m in made.methods if m[0] == "LMini;")
    o = {r["name"]: (r["pretty"], r["descriptor"]) for r in resolve.method_desc(t).collect()}
    assert o["run"] == ("LMini;->run", "LMini;->run()V")


def test_section_bytes(spark, folder, one):
    t = one("mini")
    files = spark.read.format("binaryFile").load(str(folder / "mini.dex"))
    data = images.mini().bytes()
    got = {r["type_code"]: bytes(r["bytes"]) for r in t.section_bytes(files).collect()}
    h = t.files.first()["header"]
    assert got[2] == data[h["type_ids_off"] : h["type_ids_off"] + 4 * h["type_ids_size"]]


def test_compat_loses_annotations(spark, tmp_path):
    from quarry.format.writer import Class, Image
    from quarry.tables import DexTables

    (tmp_path / "a.dex").write_bytes(Image([Class("LA;", annotations=[(1, "LNote;")], data=False)]).bytes())
    assert DexTables.load(spark, str(tmp_path)).annotation_dirs.count() == 1
    assert DexTables.load(spark, str(tmp_path), compat=True).annotation_dirs.count() == 0


def test_data_source(spark, folder):
    dex.register(spark)
    got = spark.read.format("dex").option("table", "strings").load(str(folder / "mini.dex"))
    assert sorted(r["value"] for r in got.collect()) == sorted(images.mini().strings)
    with pytest.raises(Exception, match="unknown table"):
        spark.read.format("dex").option("table", "nope").load(str(folder)).count()


def test_multidex(tables):
    assert multidex.find(multidex.class_entries(tables), "LMini;").count() == 3
    assert multidex.find(multidex.method_entries(tables), "LMini;->run()V").count() == 3
    assert multidex.find(multidex.method_entries(tables), "Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;)Ljavax/crypto/Cipher;").count() == 0  # not defined here
    assert multidex.find(multidex.type_entries(tables), "LMini;").count() == 3 and multidex.find(multidex.type_entries(tables, compat=True), "LMini;").count() == 6
    pool = multidex.index(multidex.string_entries(tables)).where("key = 'Mini.java'").first()
    assert len(pool["entries"]) == 3


def test_scalar_functions(spark):
    d = spark.createDataFrame([("aabb",), ("",), (None,), ("x" * 64,), ("  é" * 40,), ("password=",), ("Description",)], "v string")
    r = {x["v"]: x for x in d.select("v", fn.shannon_entropy(F.col("v")).alias("e"), fn.preview_literal(F.col("v")).alias("p"), fn.classify_secret(F.col("v")).alias("c"), fn.weak_algorithm(F.col("v")).alias("w")).collect()}
    assert r["aabb"]["e"] == 1.0 and r[""]["e"] == 0.0 and r[None]["e"] is None and r["x" * 64]["p"] == "x" * 64
    cut = r["  é" * 40]["p"]
    assert cut.endswith("…") and len(cut[:-1].encode()) <= 64 and cut.startswith("é") and len(cut[:-1].encode()) > 60
    assert r["password="]["c"] == "password_assignment" and r["Description"]["w"] == "DES"
    n = spark.createDataFrame([(0, 1), (300, 0x20401), (2**31, 0x10008)], "n long, f long")
    got = n.select(fn.uleb128(fn.uleb128_encode("n")).alias("n"), fn.access_flag_names(F.col("f")).alias("a"), fn.access_flag_names(F.col("f"), compat=True).alias("c")).collect()
    assert [x["n"] for x in got] == [0, 300, 2**31] and got[1]["a"] == ["PUBLIC", "ABSTRACT", "DECLARED_SYNCHRONIZED"] and "INTERFACE" in got[1]["c"] and got[2]["a"] == ["STATIC", "CONSTRUCTOR"]
    b = spark.createDataFrame([(bytes([1, 2, 3, 4, 0x7F]),)], "b binary")
    assert tuple(b.select(fn.le_u16(F.col("b"), 1), fn.le_u32(F.col("b"), 0), fn.sleb128(F.substring("b", 5, 1)), fn.mutf8_decode(F.lit(b"a\xc0\x80b"))).first()) == (0x302, 0x4030201, -1, "a\0b")
