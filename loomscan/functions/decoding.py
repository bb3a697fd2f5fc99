"""Bytes of source files to text: byte-order marks, guesses for UTF-32 and UTF-16, UTF-8 or Latin-1."""

from __future__ import annotations

import codecs

_MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (codecs.BOM_UTF8, "utf-8-sig"))
_SPACES = ((b"\0\0\0 ", "utf-32-be"), (b" \0\0\0", "utf-32-le"), (b"\0 ", "utf-16-be"), (b" \0", "utf-16-le"))


def encoding_of(data: bytes) -> str:
    """Codec for a file. Without a mark: an aligned wide space decides, then the first byte that isn't ASCII."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    for space, name in _SPACES:
        if len(data) % len(space) == 0 and (at := data.find(space)) >= 0 and at % len(space) == 0:
            return name
    at = next((k for k, b in enumerate(data) if b > 127), None)
    if at is None:
        return "ascii"
    first = data[at]
    more = 1 if 0xC0 <= first < 0xE0 else 2 if 0xE0 <= first < 0xF0 else 3 if 0xF0 <= first < 0xF4 else 0
    tail, after = data[at + 1 : at + 1 + more], data[at + 1 + more : at + 2 + more]
    well = more and len(tail) == more and all(0x80 <= b < 0xC0 for b in tail)
    return "utf-8" if well and (not after or after[0] < 128 or 0xC0 <= after[0] < 0xF4) else "latin-1"


def decode(data: bytes) -> str:
    """Text with line feeds as line ends; what can't be decoded becomes U+FFFD."""
    return data.decode(encoding_of(data), "replace").replace("\r\n", "\n").replace("\r", "\n")
