"""The opcode dimension, built from the regularities of the instruction set, and the operand layouts of its formats."""

from __future__ import annotations

from dataclasses import dataclass

#: Units of 16 bits and operands of each format. An operand is where:how, places in bytes from the instruction's start.
#: lo and hi are the halves of byte 1. r: register, l: literal (shifted left by the number after <), o: branch offset,
#: f: reference, g: second reference, q: quickened index, list: registers of a call, range: count and first register.
LAYOUTS = {
    "10x": (1, ""), "10t": (1, "o:i8@1"), "11n": (1, "r:lo l:shi"), "11x": (1, "r:u8@1"), "12x": (1, "r:lo r:hi"),
    "20bc": (2, "verify f:u16@2"), "20t": (2, "o:i16@2"), "21s": (2, "r:u8@1 l:i16@2"), "21ih": (2, "r:u8@1 l:i16@2<16"),
    "21lh": (2, "r:u8@1 l:i16@2<48"), "21t": (2, "r:u8@1 o:i16@2"), "21c": (2, "r:u8@1 f:u16@2"), "22x": (2, "r:u8@1 r:u16@2"),
    "22t": (2, "r:lo r:hi o:i16@2"), "22c": (2, "r:lo r:hi f:u16@2"), "22cs": (2, "r:lo r:hi f:u16@2"), "22s": (2, "r:lo r:hi l:i16@2"),
    "22b": (2, "r:u8@1 r:u8@2 l:i8@3"), "23x": (2, "r:u8@1 r:u8@2 r:u8@3"), "30t": (3, "o:i32@2"), "31i": (3, "r:u8@1 l:i32@2"),
    "31c": (3, "r:u8@1 f:u32@2"), "31t": (3, "r:u8@1 o:i32@2 payload"), "32x": (3, "r:u16@2 r:u16@4"), "35c": (3, "list f:u16@2"),
    "35mi": (3, "list q:InlineCache"), "35ms": (3, "list q:VtableIndex"), "3rc": (3, "range f:u16@2"), "3rmi": (3, "range q:InlineCache"),
    "3rms": (3, "range q:VtableIndex"), "45cc": (4, "list f:u16@2 g:u16@6"), "4rcc": (4, "range f:u16@2 g:u16@6"), "51l": (5, "r:u8@1 l:i64@2"),
}

#: Labels of reference kinds, by type code (fixed values).
REFERENCES = ["string", "type", "field", "method", "proto", "call_site", "method_handle"]


@dataclass(frozen=True)
class Opcode:
    opcode: int
    name: str
    format: str  # "Unresolved" where undefined
    ref_kind: str | None = None
    ref2_kind: str | None = None

    @property
    def units(self) -> int | None:
        return LAYOUTS[self.format][0] if self.format in LAYOUTS else None

    @property
    def label(self) -> str:
        """The format's name as it is shown."""
        return self.format if self.format not in LAYOUTS else f"Format{self.format}"


def _rows():
    """(name, format, kinds) of opcodes 0 to 255 in order; None where undefined."""
    values = ["", "-wide", "-object", "-boolean", "-byte", "-char", "-short"]
    whole = "add sub mul div rem and or xor shl shr ushr".split()
    arithmetic = [f"{op}-{t}" for t in ("int", "long") for op in whole] + [f"{op}-{t}" for t in ("float", "double") for op in whole[:5]]
    compare = "eq ne lt ge gt le".split()
    calls = "virtual super direct static interface".split()
    yield "nop", "10x"
    for kind in ("", "-wide", "-object"):
        yield f"move{kind}", "12x"
        yield f"move{kind}/from16", "22x"
        yield f"move{kind}/16", "32x"
    for name in ("move-result", "move-result-wide", "move-result-object", "move-exception"):
        yield name, "11x"
    yield "return-void", "10x"
    for kind in ("", "-wide", "-object"):
        yield f"return{kind}", "11x"
    yield from [("const/4", "11n"), ("const/16", "21s"), ("const", "31i"), ("const/high16", "21ih")]
    yield from [("const-wide/16", "21s"), ("const-wide/32", "31i"), ("const-wide", "51l"), ("const-wide/high16", "21lh")]
    yield from [("const-string", "21c", "string"), ("const-string/jumbo", "31c", "string"), ("const-class", "21c", "type")]
    yield from [("monitor-enter", "11x"), ("monitor-exit", "11x"), ("check-cast", "21c", "type"), ("instance-of", "22c", "type"), ("array-length", "12x")]
    yield from [("new-instance", "21c", "type"), ("new-array", "22c", "type"), ("filled-new-array", "35c", "type"), ("filled-new-array/range", "3rc", "type")]
    yield from [("fill-array-data", "31t"), ("throw", "11x"), ("goto", "10t"), ("goto/16", "20t"), ("goto/32", "30t"), ("packed-switch", "31t"), ("sparse-switch", "31t")]
    for kind in ("cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"):
        yield kind, "23x"
    for op in compare:
        yield f"if-{op}", "22t"
    for op in compare:
        yield f"if-{op}z", "21t"
    yield from [None] * 6
    for op in ("aget", "aput"):
        for v in values:
            yield op + v, "23x"
    for op, layout in (("iget", "22c"), ("iput", "22c"), ("sget", "21c"), ("sput", "21c")):
        for v in values:
            yield op + v, layout, "field"
    for c in calls:
        yield f"invoke-{c}", "35c", "method"
    yield "return-void-no-barrier", "10x"
    for c in calls:
        yield f"invoke-{c}/range", "3rc", "method"
    yield from [None] * 2
    for op in ("neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double"):
        yield op, "12x"
    types = ["int", "long", "float", "double"]
    for a in types:
        for b in types:
            if a != b:
                yield f"{a}-to-{b}", "12x"
    for b in ("byte", "char", "short"):
        yield f"int-to-{b}", "12x"
    for op in arithmetic:
        yield op, "23x"
    for op in arithmetic:
        yield f"{op}/2addr", "12x"
    small = ["add-int/{}", "rsub-int/{}", *(f"{op}-int/{{}}" for op in whole[2:8])]
    for op in small:
        yield "rsub-int" if op.startswith("rsub") else op.format("lit16"), "22s"
    for op in [*small, *(f"{op}-int/{{}}" for op in whole[8:])]:
        yield op.format("lit8"), "22b"
    for op in ("iget", "iput", "sget", "sput"):
        yield f"{op}-volatile", "22c" if op[0] == "i" else "21c", "field"
    for op in ("iget-object", "iget-wide", "iput-wide", "sget-wide"):
        yield f"{op}-volatile", "22c" if op[0] == "i" else "21c", "field"
    for v in values[3:]:
        yield f"iput{v}-quick", "22cs"
    for v in [*values[3:], *values[1:3]]:
        yield f"iget{v}-quick", "22cs"
    for v in values[:3]:
        yield f"iput{v}-quick", "22cs"
    yield from [("invoke-virtual-quick", "35ms"), ("invoke-virtual-quick/range", "3rms")]
    yield from [("invoke-polymorphic", "45cc", "method", "proto"), ("invoke-polymorphic/range", "4rcc", "method", "proto")]
    yield from [("invoke-custom", "35c", "call_site"), ("invoke-custom/range", "3rc", "call_site"), ("const-method-handle", "21c", "method_handle"), ("const-method-type", "21c", "proto")]


OPCODES = [Opcode(i, *row) if row else Opcode(i, "UNDEFINED", "Unresolved") for i, row in enumerate(_rows())]
#: Rows that stand for payload data between instructions, by the high byte of their first unit.
PAYLOADS = {1: ("PACKED_SWITCH_PAYLOAD", "PackedSwitchPayload"), 2: ("SPARSE_SWITCH_PAYLOAD", "SparseSwitchPayload"), 3: ("FILL_ARRAY_DATA_PAYLOAD", "ArrayPayload")}
NOT_CODE = ["PackedSwitchPayload", "SparseSwitchPayload", "ArrayPayload", "Unresolved"]
