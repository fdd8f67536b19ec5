"""Reads one DEX image into rows of its tables. A damaged image raises DexError; nothing is allocated by a declared size."""

from __future__ import annotations

import struct
from collections.abc import Callable

from quarry.format import errors, leb128, mutf8

HEADER_SIZE = 0x70
VERSIONS = (35, 37, 38, 39, 40, 41)
NO_INDEX = 0xFFFFFFFF
#: Fields of the header after magic, checksum and signature, each 32 bits (fixed by the format).
HEADER = "file_size header_size endian_tag link_size link_off map_off string_ids_size string_ids_off type_ids_size type_ids_off proto_ids_size proto_ids_off field_ids_size field_ids_off method_ids_size method_ids_off class_defs_size class_defs_off data_size data_off".split()
#: Section types of the map (fixed by the format).
TYPE_LIST, SET_REF_LIST, ANNOTATION_SET, ANNOTATION_ITEM, ENCODED_ARRAY, CALL_SITE, METHOD_HANDLE = 0x1001, 0x1002, 0x1003, 0x2004, 0x2005, 0x0007, 0x0008
#: Nested values beyond this depth count as damage.
DEPTH = 64


class Reader:
    """A place in a buffer, with bounds."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, size: int, section: str) -> bytes:
        end = self.at + size
        if end > len(self.data):
            raise errors.out_of_bounds(section, self.at, size)
        out, self.at = self.data[self.at : end], end
        return out

    def u8(self, section: str) -> int:
        return self.take(1, section)[0]

    def u16(self, section: str) -> int:
        return int.from_bytes(self.take(2, section), "little")

    def u32(self, section: str) -> int:
        return int.from_bytes(self.take(4, section), "little")

    def uleb(self, section: str) -> int:
        value, self.at = leb128.read_unsigned(self.data, self.at, section)
        return value

    def sleb(self, section: str) -> int:
        value, self.at = leb128.read_signed(self.data, self.at, section)
        return value


def header(data: bytes) -> dict:
    if len(data) < HEADER_SIZE:
        raise errors.too_small(HEADER_SIZE, len(data))
    if data[:4] != b"dex\n":
        raise errors.invalid_magic(data[:8])
    digits = data[4:7]
    if not digits.isascii():
        raise errors.malformed("dex header", "version is not ascii digits")
    if not digits.isdigit():
        raise errors.malformed("dex header", "version is not numeric")
    numbers = struct.unpack_from("<20I", data, 32)
    out = {"magic": data[:8], "version": int(digits), "checksum": struct.unpack_from("<I", data, 8)[0], "signature": data[12:32], **dict(zip(HEADER, numbers, strict=True))}
    if out["version"] not in VERSIONS:
        raise errors.unsupported_version(out["version"])
    return out


def _ids(data: bytes, h: dict, name: str, layout: str) -> list[tuple]:
    """Rows of an id table of fixed width."""
    row = struct.Struct(layout)
    reader = Reader(data, h[f"{name}_off"])
    return list(row.iter_unpack(reader.take(row.size * h[f"{name}_size"], name))) if h[f"{name}_size"] else []


def _map_items(data: bytes, h: dict) -> list[tuple[int, int, int]]:
    if not h["map_off"]:
        return []
    r = Reader(data, h["map_off"])
    count = r.u32("code_item")
    items = []
    for _ in range(count):
        kind = r.u16("code_item")
        r.at += 2
        items.append((kind, r.u32("code_item"), r.u32("code_item")))
    return sorted(items, key=lambda x: x[2])


def _string(data: bytes, at: int) -> str:
    if at > len(data):
        raise errors.out_of_bounds("string_data_item", at, 1)
    length, at_text = leb128.read_unsigned(data, at, "string_data_item")
    end = data.find(b"\0", at_text)
    if end < 0:
        raise errors.mutf8(at)
    if end - at_text < length:
        raise errors.malformed("string_data_item", "declared length larger than payload")
    try:
        return mutf8.decode(data[at_text:end])
    except ValueError:
        raise errors.mutf8(at) from None


def _members(r: Reader, count: int, what: str, code: bool) -> list[tuple]:
    """(pos, idx, flags[, code_off]) of a class's fields or methods, whose indexes are stored as differences."""
    out, index = [], 0
    for pos in range(count):
        index += r.uleb(what)
        row = (r.uleb(what), r.uleb(what)) if code else (r.uleb(what),)
        if index > NO_INDEX:
            raise errors.malformed(what, f"{'method' if code else 'field'} index overflow")
        out.append((pos, index, *row))
    return out


def _code(data: bytes, offset: int, from_list_start: bool) -> dict:
    r = Reader(data, offset)
    registers, ins, outs, tries = (r.u16("code_item") for _ in range(4))
    debug, units = r.u32("code_item"), r.u32("code_item")
    out = {"registers_size": registers, "ins_size": ins, "outs_size": outs, "tries_size": tries, "debug_info_off": debug, "insns_size": units, "insns": r.take(2 * units, "code_item"), "tries": [], "handlers": []}
    if not tries:
        return out
    r.at += 2 * (units % 2)
    for pos in range(tries):
        start = r.u32("code_item")
        out["tries"].append({"try_pos": pos, "start_addr": start, "insn_count": r.u16("code_item"), "handler_off": r.u16("code_item")})
    base = r.at
    count = r.uleb("encoded_catch_handler_list")
    if not from_list_start:
        base = r.at
    for handler in range(count):
        relative = r.at - base
        size = r.sleb("encoded_catch_handler")
        row = {"handler_pos": handler, "handler_rel_off": relative}
        for pos in range(abs(size)):
            kind = r.uleb("encoded_type_addr_pair")
            out["handlers"].append(row | {"pos": pos, "type_idx": kind, "addr": r.uleb("encoded_type_addr_pair")})
        if size <= 0:
            out["handlers"].append(row | {"pos": abs(size), "type_idx": None, "addr": r.uleb("encoded_catch_handler")})
    return out


def _skip_value(r: Reader, depth: int = 0) -> None:
    if depth > DEPTH:
        raise errors.malformed("encoded_value", "nested too deeply")
    head = r.u8("encoded_value")
    kind = head & 0x1F
    if kind == 0x1C:
        _skip_array(r, depth + 1)
    elif kind == 0x1D:
        _skip_annotation(r, depth + 1)
    elif kind < 0x1E:
        r.take((head >> 5) + 1, "encoded_value")


def _skip_array(r: Reader, depth: int = 0) -> None:
    for _ in range(r.uleb("encoded_array")):
        _skip_value(r, depth)


def _skip_annotation(r: Reader, depth: int = 0) -> None:
    r.uleb("encoded_annotation")
    for _ in range(r.uleb("encoded_annotation")):
        r.uleb("annotation_element")
        _skip_value(r, depth)


def _raw(r: Reader, skip: Callable[[Reader], None]) -> bytes:
    start = r.at
    skip(r)
    return r.data[start : r.at]


def _directory(data: bytes, offset: int) -> tuple[int | None, list[tuple[str, int, int, int]]]:
    """(offset of the class's annotations or None, its members as (kind, pos, idx, offset))."""
    r = Reader(data, offset)
    own, *sizes = (r.u32("code_item") for _ in range(4))
    members = [(kind, pos, r.u32("code_item"), r.u32("code_item")) for kind, n in zip(("field", "method", "parameter"), sizes, strict=True) for pos in range(n)]
    return own or None, members


def _sections(data: bytes, items: list[tuple[int, int, int]]) -> dict[str, list[dict]]:
    """Optional sections, by the map. Items at one offset count once, the last one."""
    lists: dict[int, list[int]] = {}
    refs: dict[int, list[int]] = {}
    sets: dict[int, list[int]] = {}
    annotations: dict[int, tuple[int, bytes]] = {}
    arrays: dict[int, bytes] = {}
    sites, handles = [], []
    for kind, size, offset in items:
        r = Reader(data, offset)
        if kind not in (TYPE_LIST, SET_REF_LIST, ANNOTATION_SET, ANNOTATION_ITEM, ENCODED_ARRAY, CALL_SITE, METHOD_HANDLE):
            continue
        for _ in range(size):
            start = r.at
            if kind == TYPE_LIST:
                n = r.u32("type_list")
                lists[start] = [r.u16("type_item") for _ in range(n)]
                r.take(2 * (n % 2), "type_list")
            elif kind == SET_REF_LIST:
                refs[start] = [r.u32("annotation_set_ref_item") for _ in range(r.u32("annotation_set_ref_list"))]
            elif kind == ANNOTATION_SET:
                sets[start] = [r.u32("annotation_off_item") for _ in range(r.u32("annotation_set_item"))]
            elif kind == ANNOTATION_ITEM:
                annotations[start] = (r.u8("annotation_item"), _raw(r, _skip_annotation))
            elif kind == ENCODED_ARRAY:
                arrays[start] = _raw(r, _skip_array)
            elif kind == CALL_SITE:
                sites.append(r.u32("call_site_id_item"))
            else:
                kind_ = r.u16("method_handle_item")
                r.u16("method_handle_item")
                handles.append((kind_, r.u32("method_handle_item")))
    flat = lambda x, name: [{"offset": o, "pos": i, name: v} for o, vs in x.items() for i, v in enumerate(vs)]
    return {
        "type_lists": flat(lists, "type_idx"), "annotation_set_refs": flat(refs, "annotations_off"), "annotation_sets": flat(sets, "annotation_off"),
        "annotation_items": [{"offset": o, "visibility": v, "annotation": a} for o, (v, a) in annotations.items()],
        "encoded_arrays": [{"offset": o, "value": v} for o, v in arrays.items()],
        "call_sites": [{"call_site_idx": i, "call_site_off": o} for i, o in enumerate(sites)],
        "method_handles": [{"mh_idx": i, "handle_type": k, "field_or_method_idx": m} for i, (k, m) in enumerate(handles)],
    }


def read(data: bytes, compat: bool = False) -> dict:
    """All tables of an image by name, as lists of rows, and its header and link_data.

    compat: handler offsets count from behind the handler list's size instead of from its start, and classes without
    class data lose their annotations.
    """
    h = header(data)
    items = _map_items(data, h)
    strings = []
    for i, (offset,) in enumerate(_ids(data, h, "string_ids", "<I")):
        value = error = None
        try:
            value = _string(data, offset)
        except errors.DexError as e:
            error = str(e)
        strings.append({"string_idx": i, "data_off": offset, "value": value, "decode_error": error})
    types = [{"type_idx": i, "descriptor_idx": d} for i, (d,) in enumerate(_ids(data, h, "type_ids", "<I"))]
    protos = [{"proto_idx": i, "shorty_idx": s, "return_type_idx": r, "parameters_off": p} for i, (s, r, p) in enumerate(_ids(data, h, "proto_ids", "<III"))]
    fields = [{"field_idx": i, "class_type_idx": c, "type_idx": t, "name_idx": n} for i, (c, t, n) in enumerate(_ids(data, h, "field_ids", "<HHI"))]
    methods = [{"method_idx": i, "class_type_idx": c, "proto_idx": p, "name_idx": n} for i, (c, p, n) in enumerate(_ids(data, h, "method_ids", "<HHI"))]
    none = lambda x: None if x == NO_INDEX else x
    classes, own_fields, own_methods, code, directories, members = [], [], [], {}, [], []
    for i, (kind, flags, parent, interfaces, source, notes, body, values) in enumerate(_ids(data, h, "class_defs", "<8I")):
        classes.append({"class_idx": i, "type_idx": kind, "access_flags": flags, "super_type_idx": none(parent), "interfaces_off": interfaces, "source_file_idx": none(source), "annotations_off": notes, "class_data_off": body, "static_values_off": values})
        if body:
            r = Reader(data, body)
            sizes = [r.uleb("class_data") for _ in range(4)]
            for what, n in zip(("static", "instance"), sizes[:2], strict=True):
                own_fields += [{"class_idx": i, "kind": what, "pos": p, "field_idx": f, "access_flags": a} for p, f, a in _members(r, n, "encoded_field", False)]
            for what, n in zip(("direct", "virtual"), sizes[2:], strict=True):
                for p, m, a, c in _members(r, n, "encoded_method", True):
                    if m >= len(methods):
                        raise errors.invalid_index("method_ids", m)
                    own_methods.append({"class_idx": i, "kind": what, "pos": p, "method_idx": m, "access_flags": a, "code_off": c})
                    if c:  # of repeated methods the last one with code counts
                        code[m] = _code(data, c, not compat)
        if notes and (body or not compat):
            own, found = _directory(data, notes)
            directories.append({"class_idx": i, "class_annotations_off": own})
            members += [{"class_idx": i, "kind": k, "pos": p, "idx": x, "annotations_off": o} for k, p, x, o in found]
    link = Reader(data, h["link_off"]).take(h["link_size"], "link_data") if h["link_size"] else None
    tries = [{"method_idx": m, **t} for m, c in code.items() for t in c["tries"]]
    handlers = [{"method_idx": m, **x} for m, c in code.items() for x in c["handlers"]]
    return {
        "header": h, "link_data": link, "map_items": [{"type_code": k, "size": s, "offset": o} for k, s, o in items],
        "strings": strings, "types": types, "protos": protos, "fields": fields, "methods": methods, "classes": classes,
        "encoded_fields": own_fields, "encoded_methods": own_methods,
        "code_items": [{"method_idx": m, **{k: v for k, v in c.items() if k not in ("tries", "handlers")}} for m, c in sorted(code.items())],
        "try_items": tries, "catch_handlers": handlers, "annotation_dirs": directories, "annotation_members": members, **_sections(data, items),
    }
