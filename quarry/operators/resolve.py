"""Lookups across tables: what indexes name. Chains of equi-joins on (dex_id, index); Catalyst broadcasts small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.tables import DexTables

UNKNOWN, NO_SIGNATURE = "<unknown>", "()V"


def signature(params: Column, result: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(params, ""), F.lit(")"), result)


def type_desc(t: DexTables) -> DataFrame:
    """(dex_id, type_idx, descriptor); the descriptor is null where its string is missing."""
    s = t.strings.select("dex_id", F.col("string_idx").alias("descriptor_idx"), F.col("value").alias("descriptor"))
    return t.types.join(s, ["dex_id", "descriptor_idx"], "left").select("dex_id", "type_idx", "descriptor")


def proto_desc(t: DexTables) -> DataFrame:
    """(dex_id, proto_idx, signature); a prototype that can't be resolved has the signature ()V."""
    types = type_desc(t)
    params = t.type_lists.join(types, ["dex_id", "type_idx"], "left").groupBy("dex_id", F.col("offset").alias("parameters_off")).agg(F.array_sort(F.collect_list(F.struct("pos", "descriptor"))).alias("p"))
    results = types.select("dex_id", F.col("type_idx").alias("return_type_idx"), F.col("descriptor").alias("result"))
    p = t.protos.join(results, ["dex_id", "return_type_idx"], "left").join(params, ["dex_id", "parameters_off"], "left")
    none = F.array().cast("array<string>")
    known = F.when(F.col("parameters_off") == 0, none).when(~F.exists("p", lambda x: x["descriptor"].isNull()), F.col("p.descriptor"))
    return p.select("dex_id", "proto_idx", F.coalesce(signature(known, F.col("result")), F.lit(NO_SIGNATURE)).alias("signature"))


def owners(t: DexTables) -> DataFrame:
    """(dex_id, method_idx, class_idx, access_flags, code_off): where a method is defined; the last of repeated ones counts."""
    order = F.struct("class_idx", (F.col("kind") == "virtual").alias("v"), "pos")
    last = t.encoded_methods.groupBy("dex_id", "method_idx").agg(F.max_by(F.struct("class_idx", "access_flags", "code_off"), order).alias("o"))
    return last.select("dex_id", "method_idx", "o.*")


def class_desc(t: DexTables) -> DataFrame:
    """(dex_id, class_idx, descriptor, super_descriptor, access_flags, source_file, method_count)."""
    types = type_desc(t)
    parents = types.select("dex_id", F.col("type_idx").alias("super_type_idx"), F.col("descriptor").alias("super_descriptor"))
    sources = t.strings.select("dex_id", F.col("string_idx").alias("source_file_idx"), F.col("value").alias("source_file"))
    count = t.encoded_methods.groupBy("dex_id", "class_idx").agg(F.count("*").alias("method_count"))
    out = t.classes.join(types, ["dex_id", "type_idx"], "left").join(parents, ["dex_id", "super_type_idx"], "left").join(sources, ["dex_id", "source_file_idx"], "left").join(count, ["dex_id", "class_idx"], "left")
    return out.select("dex_id", "class_idx", "descriptor", "super_descriptor", "access_flags", "source_file", F.coalesce("method_count", F.lit(0)).alias("method_count"))


def method_desc(t: DexTables) -> DataFrame:
    """(dex_id, method_idx, class, name, signature, owner_class_idx, owner, pretty, descriptor, access_flags).

    class is what the method's reference names; owner is the class that defines it here, null for external methods;
    descriptor (owner->name signature) is null for those too; pretty has <unknown> in place of a missing owner.
    """
    types, strings = type_desc(t), t.strings.select("dex_id", F.col("string_idx").alias("name_idx"), F.col("value").alias("n"))
    classes = types.select("dex_id", F.col("type_idx").alias("class_type_idx"), F.col("descriptor").alias("c"))
    own = owners(t).join(t.classes.select("dex_id", "class_idx", F.col("type_idx").alias("own_type")), ["dex_id", "class_idx"])
    own = own.join(types.select("dex_id", F.col("type_idx").alias("own_type"), F.col("descriptor").alias("owner")), ["dex_id", "own_type"], "left").select("dex_id", "method_idx", F.col("class_idx").alias("owner_class_idx"), "owner", "access_flags")
    m = t.methods.join(classes, ["dex_id", "class_type_idx"], "left").join(strings, ["dex_id", "name_idx"], "left").join(proto_desc(t), ["dex_id", "proto_idx"], "left").join(own, ["dex_id", "method_idx"], "left")
    name, sig = F.coalesce("n", F.lit(UNKNOWN)), F.coalesce("signature", F.lit(NO_SIGNATURE))
    return m.select(
        "dex_id", "method_idx", F.coalesce("c", F.lit(UNKNOWN)).alias("class"), name.alias("name"), sig.alias("signature"), "owner_class_idx", "owner",
        F.concat(F.coalesce("owner", F.lit(UNKNOWN)), F.lit("->"), name).alias("pretty"), F.concat("owner", F.lit("->"), name, sig).alias("descriptor"), "access_flags",
    )


def field_desc(t: DexTables) -> DataFrame:
    """(dex_id, field_idx, class, type, name)."""
    types = type_desc(t)
    named = lambda key, to: types.select("dex_id", F.col("type_idx").alias(key), F.col("descriptor").alias(to))
    strings = t.strings.select("dex_id", F.col("string_idx").alias("name_idx"), F.col("value").alias("name"))
    f = t.fields.join(named("class_type_idx", "class"), ["dex_id", "class_type_idx"], "left").join(named("type_idx", "type"), ["dex_id", "type_idx"], "left").join(strings, ["dex_id", "name_idx"], "left")
    return f.select("dex_id", "field_idx", "class", "type", "name")


def class_methods(t: DexTables) -> DataFrame:
    """(dex_id, class_idx, ord, method_idx): a class's methods, direct ones first."""
    from pyspark.sql import Window

    order = Window.partitionBy("dex_id", "class_idx").orderBy((F.col("kind") == "virtual").cast("int"), "pos")
    return t.encoded_methods.select("dex_id", "class_idx", (F.row_number().over(order) - 1).alias("ord"), "method_idx")


def overview(t: DexTables) -> DataFrame:
    """A row for each image: version and counts, from its header and tables."""
    counts = [F.coalesce(F.size(n), F.lit(0)).cast("long").alias(f"{n[:-1] if n != 'classes' else 'class'}_count") for n in ("strings", "types", "protos", "fields", "methods", "classes")]
    return t.images.select("dex_id", "path", "entry_name", F.col("header.version").alias("version"), F.col("header.file_size").alias("file_size"), *counts, "parse_error")


def top_classes(t: DexTables, n: int = 10) -> DataFrame:
    """The n classes with the most methods; of equals the first."""
    return class_desc(t).orderBy(F.desc("method_count"), "dex_id", "class_idx").limit(n)


def filter_classes(classes: DataFrame, needle: str) -> DataFrame:
    """Classes whose descriptor holds the needle, whatever the case; a blank needle keeps all."""
    text = needle.strip().lower()
    return classes.where(F.contains(F.lower("descriptor"), F.lit(text))) if text else classes
