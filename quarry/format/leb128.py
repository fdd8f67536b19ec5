"""LEB128 numbers of 32 bits: at most five bytes, read from a buffer at a place."""

from __future__ import annotations

from quarry.format import errors

MOST = 5


def read_unsigned(data: bytes, at: int, context: str) -> tuple[int, int]:
    """(value, place after it). Bits above 32 are dropped."""
    value = 0
    for i, byte in enumerate(data[at : at + MOST]):
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            return value & 0xFFFFFFFF, at + i + 1
    raise errors.leb128(context)


def read_signed(data: bytes, at: int, context: str) -> tuple[int, int]:
    value = 0
    for i, byte in enumerate(data[at : at + MOST]):
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            bits = 7 * (i + 1)
            if bits < 32 and byte & 0x40:
                value -= 1 << bits
            value &= 0xFFFFFFFF
            return value - (1 << 32) if value >> 31 else value, at + i + 1
    raise errors.leb128(context)


def unsigned(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def signed(value: int) -> bytes:
    out = bytearray()
    while not -64 <= value < 64:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value & 0x7F)
    return bytes(out)
