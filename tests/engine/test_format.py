import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.format import decoder, image, leb128, mutf8
from quarry.format.errors import DexError
from quarry.format.opcodes import OPCODES, Opcode
from quarry.operators.rules import is_ssl_override
from tests.engine import images


def rows(hexes):
    data = bytes.fromhex(hexes)
    return list(decoder.decode(data, len(data) // 2))


def test_opcode_table():
    assert len(OPCODES) == 256 and sum(o.units is not None for o in OPCODES) == 248
    assert [o.opcode for o in OPCODES if o.units is None] == [0x3E, 0x3F, 0x40, 0x41, 0x42, 0x43, 0x79, 0x7A]
    some = {0x00: "nop", 0x1A: "const-string", 0x6E: "invoke-virtual", 0x90: "add-int", 0xB0: "add-int/2addr", 0xD1: "rsub-int", 0xE2: "ushr-int/lit8", 0xF7: "iput-object-quick", 0xFF: "const-method-type"}
    assert {k: OPCODES[k].name for k in some} == some


def test_inline_code():
    (r,) = rows("fa 21 34 12 43 65 78 56")
    assert (r["registers"], r["ref_kind"], r["ref_idx"], r["ref2_kind"], r["ref2_idx"]) == ([3, 4], "method", 0x1234, "proto", 0x5678)
    (r,) = rows("fb 03 00 01 20 00 00 02")
    assert (r["range_start"], r["range_count"], r["ref_idx"], r["ref2_idx"], r["registers"]) == (0x20, 3, 0x100, 0x200, [])
    r, p = rows("2b 00 03 00 00 00 00 01 01 00 11 00 00 00 02 00 00 00")
    assert (r["switch_kind"], r["switch_first_key"], r["switch_targets"]) == ("packed", 0x11, [2]) and (p["format"], p["opcode"], p["pc"]) == ("PackedSwitchPayload", 0, 3)
    r = rows("2b 00 03 00 00 00 00 01 02 00 01 00 00 00 10 00 00 00 20 00 00 00")[0]
    assert (r["switch_first_key"], r["switch_targets"]) == (1, [0x10, 0x20])
    a, b, _ = rows("fe 01 02 00 ff 02 03 00 0e 00")
    assert (a["ref_kind"], a["ref_idx"], b["ref_kind"], b["ref_idx"]) == ("method_handle", 2, "proto", 3)
    (r,) = rows("fc 10 01 00 32 10 00 00"[:17])
    assert (r["registers"], r["ref_kind"], r["ref_idx"]) == ([2], "call_site", 1)
    (r,) = rows("fd 02 02 00 20 00")
    assert (r["ref_kind"], r["ref_idx"], r["range_start"], r["range_count"]) == ("call_site", 2, 0x20, 2)
    for bad, what in (("2b 00 03 00 00 00 00 02 01 00" + " 00" * 8, "packed-switch is malformed: payload ident mismatch"), ("26 00 ff ff 00 00 0e 00 00 00", "payload is malformed: payload offset out of range"), ("3e 00", "unknown opcode 0x3e at pc 0"), ("6e 00", "code_item is malformed: instruction extends past end of insns")):
        with pytest.raises(DexError, match=what):
            rows(bad)


def test_formats_no_opcode_has():
    r = decoder.operands(bytes.fromhex("00 05 34 12"), 0, 0, Opcode(0, "x", "20bc"))
    assert (r["verification_error"], r["ref_kind"], r["ref_idx"]) == (5, "type", 0x1234)
    r = decoder.operands(bytes.fromhex("00 21 34 12 32 10"), 0, 0, Opcode(0, "x", "35mi"))
    assert (r["quick_kind"], r["quick_index"], r["registers"]) == ("InlineCache", 0x1234, [2, 3])
    r = decoder.operands(bytes.fromhex("00 03 34 12 20 00"), 0, 0, Opcode(0, "x", "3rmi"))
    assert (r["quick_kind"], r["range_start"], r["range_count"]) == ("InlineCache", 0x20, 3)


def test_literals_and_payloads():
    values = [r["literal"] for r in rows("12 f1 13 00 ff 7f 15 00 01 00 14 00 ff ff ff ff 18 00 01 00 00 00 00 00 00 80 19 00 ff ff")]
    assert values == [-1, 0x7FFF, 0x10000, -1, -(2**63) + 1, -(1 << 48)]
    r = rows("26 00 03 00 00 00 00 03 02 00 03 00 00 00 01 00 02 00 03 00")
    assert (r[0]["array_width"], r[0]["array_size"], r[0]["array_data"]) == (2, 3, bytes([1, 0, 2, 0, 3, 0])) and r[1]["format"] == "ArrayPayload"
    r = rows("2c 00 03 00 00 00 00 02 01 00 07 00 00 00 09 00 00 00")[0]
    assert (r["switch_kind"], r["switch_keys"], r["switch_targets"]) == ("sparse", [7], [9])


@given(st.integers(0, 2**32 - 1))
def test_unsigned_numbers(x):
    data = leb128.unsigned(x)
    assert leb128.read_unsigned(data + b"\x80", 0, "x") == (x, len(data))


@given(st.integers(-(2**31), 2**31 - 1))
def test_signed_numbers(x):
    data = leb128.signed(x)
    assert leb128.read_signed(data, 0, "x") == (x, len(data))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\x80" * 5 + b"\x01"])
def test_bad_numbers(data):
    for read in (leb128.read_unsigned, leb128.read_signed):
        with pytest.raises(DexError, match="invalid leb128 encoding while parsing x"):
            read(data, 0, "x")


@given(st.text())
def test_strings(x):
    assert mutf8.decode(mutf8.encode(x)) == x and b"\0" not in mutf8.encode(x)


@pytest.mark.parametrize("data", [b"\xed\xa0\x80", b"\xff", b"\xc3"])
def test_bad_strings(data):
    with pytest.raises(ValueError):
        mutf8.decode(data)


def test_errors_of_images():
    for data, what in ((b"dex", "buffer too small: expected at least 112 bytes, got 3"), (bytes(0x70), "invalid magic bytes"), (b"dex\n036\0" + bytes(0x68), "unsupported dex version 36"), (b"dex\nx35\0" + bytes(0x68), "version is not numeric")):
        with pytest.raises(DexError, match=what):
            image.read(data)
    good = images.mini().bytes()
    bad = bytearray(good)
    bad[0x3C:0x40] = (len(good) + 0x100).to_bytes(4, "little")
    with pytest.raises(DexError, match="section string_ids"):
        image.read(bytes(bad))


@given(st.integers(0, 900), st.integers(0, 255))
def test_damage_never_escapes(at, value):
    data = bytearray(images.mini().bytes())
    data[at % len(data)] = value
    try:
        image.read(bytes(data))
    except DexError:
        pass


def test_ssl_override():
    assert is_ssl_override(*images.SSL) and not is_ssl_override("onReceivedError", images.SSL[1])
