"""Errors of images, as text that becomes a column."""

from __future__ import annotations


class DexError(ValueError):
    """A reading error; its text is the value of parse_error and decode_error columns."""


def too_small(expected: int, actual: int) -> DexError:
    return DexError(f"buffer too small: expected at least {expected} bytes, got {actual}")


def invalid_magic(magic: bytes) -> DexError:
    return DexError(f"invalid magic bytes {list(magic)}")


def unsupported_version(version: int) -> DexError:
    return DexError(f"unsupported dex version {version}")


def out_of_bounds(section: str, offset: int, size: int) -> DexError:
    return DexError(f"section {section} (offset {offset}, size {size}) is out of bounds")


def malformed(context: str, message: str) -> DexError:
    return DexError(f"{context} is malformed: {message}")


def invalid_index(table: str, index: int) -> DexError:
    return DexError(f"index {index} is out of range for {table}")


def leb128(context: str) -> DexError:
    return DexError(f"invalid leb128 encoding while parsing {context}")


def mutf8(offset: int) -> DexError:
    return DexError(f"invalid mutf8 data in string at offset {offset}")


def unknown_opcode(opcode: int, pc: int) -> DexError:
    return DexError(f"unknown opcode {opcode:#04x} at pc {pc}")
