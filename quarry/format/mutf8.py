"""Modified UTF-8: NUL is C0 80, and characters beyond 16 bits are two encoded surrogates."""

from __future__ import annotations


def decode(data: bytes) -> str:
    """The text; ValueError where the bytes aren't modified UTF-8 or hold a lone surrogate."""
    if data.isascii():
        return data.decode("ascii")
    units = data.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    # Pairs of surrogates become characters; a lone one can't be encoded and raises.
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le")


def encode(text: str) -> bytes:
    units = text.encode("utf-16-le", "surrogatepass")
    chars = [chr(int.from_bytes(units[i : i + 2], "little")) for i in range(0, len(units), 2)]
    return "".join(chars).encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")


def length(text: str) -> int:
    """Length in 16-bit units, as images declare it."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2
