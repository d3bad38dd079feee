"""String tables: records of text, either plain UTF-16 or packed symbols."""

from __future__ import annotations

from collections.abc import Iterator

# What the packed symbols 1 to 31 stand for; greater ones count from the record's base character.
SPECIAL = "0123456strnum()[]<>%#/:-'\" ,.!\n"

RECORD = "ord int, offset long, length int, base_char int, range_bits int, mode string, confirmed boolean, text string"


def unpack(payload: bytes, base: int, bits: int) -> str:
    """Packed symbols, lowest bits first, up to the first 0. Symbols wider than 32 bits don't occur."""
    if not 0 < bits <= 32:
        return ""
    value, out = int.from_bytes(payload, "little"), []
    for k in range(8 * len(payload) // bits + 1):
        s = value >> (k * bits) & ((1 << bits) - 1)
        if not s:
            break
        code = ord(SPECIAL[s - 1]) if s < 32 else s - 32 + base
        out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
    return "".join(out)


def records(data: bytes) -> Iterator[tuple]:
    """Rows of RECORD; none if the magic is another. A record that is too short or reaches past the end stops the walk."""
    if data[:4] != b"strs":
        return
    at, k = 4, 0
    while at + 6 <= len(data):
        size = int.from_bytes(data[at : at + 2], "little")
        if size < 6 or at + size > len(data):
            return
        base, bits, payload = int.from_bytes(data[at + 2 : at + 4], "little"), data[at + 4], data[at + 6 : at + size]
        plain = base == 0 and bits == 16 and len(payload) % 2 == 0
        text = payload.decode("utf-16-le", "replace") if plain else unpack(payload, base, bits)
        yield k, at, size, base, bits, "raw-utf16" if plain else "packed", plain, text
        at, k = at + size, k + 1


def write_table(texts: list[str]) -> bytes:
    """A table of plain records, for fixtures."""
    out = [b"strs"]
    for t in texts:
        raw = t.encode("utf-16-le")
        out.append((len(raw) + 6).to_bytes(2, "little") + b"\0\0\x10\0" + raw)
    return b"".join(out)
