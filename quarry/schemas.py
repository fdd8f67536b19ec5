"""Schemas of all tables. Unsigned numbers are widened; keys of a table within a file are named *_idx or offset."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"INT": IntegerType, "BIGINT": LongType, "STRING": StringType, "BINARY": BinaryType}


def struct(fields: str) -> StructType:
    """A schema from "name TYPE, ..." without a session; ARRAY<type> and STRUCT<fields> nest."""
    out, depth, at = StructType(), 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = fields[at:i].strip().partition(" ")
            out.add(StructField(name.rstrip(":"), _type(kind.strip())))
            at = i + 1
    return out


def _type(kind: str) -> DataType:
    if kind.startswith("ARRAY<"):
        return ArrayType(_type(kind[6:-1]))
    return struct(kind[7:-1]) if kind.startswith("STRUCT<") else _TYPES[kind]()


_DDL = {
    "map_items": "type_code INT, size BIGINT, offset BIGINT",
    "strings": "string_idx BIGINT, data_off BIGINT, value STRING, decode_error STRING",
    "types": "type_idx BIGINT, descriptor_idx BIGINT",
    "protos": "proto_idx BIGINT, shorty_idx BIGINT, return_type_idx BIGINT, parameters_off BIGINT",
    "fields": "field_idx BIGINT, class_type_idx BIGINT, type_idx BIGINT, name_idx BIGINT",
    "methods": "method_idx BIGINT, class_type_idx BIGINT, proto_idx BIGINT, name_idx BIGINT",
    "classes": "class_idx BIGINT, type_idx BIGINT, access_flags BIGINT, super_type_idx BIGINT, interfaces_off BIGINT, source_file_idx BIGINT, annotations_off BIGINT, class_data_off BIGINT, static_values_off BIGINT",
    "encoded_fields": "class_idx BIGINT, kind STRING, pos INT, field_idx BIGINT, access_flags BIGINT",
    "encoded_methods": "class_idx BIGINT, kind STRING, pos INT, method_idx BIGINT, access_flags BIGINT, code_off BIGINT",
    "code_items": "method_idx BIGINT, registers_size INT, ins_size INT, outs_size INT, tries_size INT, debug_info_off BIGINT, insns_size BIGINT, insns BINARY",
    "try_items": "method_idx BIGINT, try_pos INT, start_addr BIGINT, insn_count INT, handler_off INT",
    "catch_handlers": "method_idx BIGINT, handler_pos INT, handler_rel_off BIGINT, pos INT, type_idx BIGINT, addr BIGINT",
    "type_lists": "offset BIGINT, pos INT, type_idx BIGINT",
    "annotation_dirs": "class_idx BIGINT, class_annotations_off BIGINT",
    "annotation_members": "class_idx BIGINT, kind STRING, pos INT, idx BIGINT, annotations_off BIGINT",
    "annotation_set_refs": "offset BIGINT, pos INT, annotations_off BIGINT",
    "annotation_sets": "offset BIGINT, pos INT, annotation_off BIGINT",
    "annotation_items": "offset BIGINT, visibility INT, annotation BINARY",
    "encoded_arrays": "offset BIGINT, value BINARY",
    "call_sites": "call_site_idx BIGINT, call_site_off BIGINT",
    "method_handles": "mh_idx BIGINT, handle_type INT, field_or_method_idx BIGINT",
}

HEADER = "magic BINARY, version INT, checksum BIGINT, signature BINARY, file_size BIGINT, header_size BIGINT, endian_tag BIGINT, link_size BIGINT, link_off BIGINT, map_off BIGINT, string_ids_size BIGINT, string_ids_off BIGINT, type_ids_size BIGINT, type_ids_off BIGINT, proto_ids_size BIGINT, proto_ids_off BIGINT, field_ids_size BIGINT, field_ids_off BIGINT, method_ids_size BIGINT, method_ids_off BIGINT, class_defs_size BIGINT, class_defs_off BIGINT, data_size BIGINT, data_off BIGINT"

TABLES = {name: struct(ddl) for name, ddl in _DDL.items()}

#: A file: its header, what went wrong with it, and its tables as arrays.
FILE = f"dex_id BIGINT, path STRING, entry_name STRING, dex_ord INT, size BIGINT, header STRUCT<{HEADER}>, link_data BINARY, parse_error STRING"
IMAGES = struct(FILE + "".join(f", {name} ARRAY<STRUCT<{ddl}>>" for name, ddl in _DDL.items()))

DECODED = struct(
    "dex_id BIGINT, method_idx BIGINT, pc BIGINT, ord INT, opcode INT, name STRING, format STRING, units BIGINT, registers ARRAY<INT>, literal BIGINT, offset BIGINT, "
    "ref_kind STRING, ref_idx BIGINT, ref2_kind STRING, ref2_idx BIGINT, range_start INT, range_count INT, verification_error INT, quick_kind STRING, quick_index INT, "
    "switch_kind STRING, switch_first_key BIGINT, switch_keys ARRAY<INT>, switch_targets ARRAY<INT>, array_width INT, array_size BIGINT, array_data BINARY, error STRING"
)

FINDING = struct(
    "dex_id BIGINT, pass INT, rule INT, seq1 BIGINT, seq2 BIGINT, seq3 BIGINT, id STRING, kind STRING, severity STRING, "
    "location STRUCT<class_descriptor STRING, method_name STRING, signature STRING, method_idx BIGINT, pc BIGINT>, message STRING, extra STRING"
)
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]
