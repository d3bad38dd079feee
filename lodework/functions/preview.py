"""How a blob is best shown: the first kind whose condition holds, in this order."""

from __future__ import annotations

from collections.abc import Callable

from .classify import looks_like_text
from .media import clips, dds_header, texture_header
from .packfile import chunks

# Magics of pictures that a codec of the system decodes.
PICTURES = (b"\x89PNG", b"\xff\xd8\xff", b"BM")


def _container(data: bytes) -> bytes:
    return data[8:12] if data.startswith(b"PF") and len(data) >= 12 else b""


def _has_chunk(data: bytes, name: str) -> bool:
    return bool(_container(data)) and any(c[1] == name for c in chunks(data, "extract"))


def _sounds(data: bytes) -> bool:
    return _container(data) in (b"ASND", b"ABNK", b"AMSP") or data[:4] in (b"asnd", b"OggS") or not _container(data) and bool(clips(data))


CASCADE: tuple[tuple[str, Callable[[bytes], bool]], ...] = (
    ("image", lambda d: bool(texture_header(d) or dds_header(d)) or d.startswith(PICTURES)),
    ("strings", lambda d: d.startswith(b"strs")),
    ("audio", _sounds),
    ("atlas", lambda d: _container(d) == b"PIMG"),
    ("content", lambda d: _container(d) == b"cntc"),
    ("map", lambda d: _has_chunk(d, "prp2")),
    ("model", lambda d: _has_chunk(d, "GEOM")),
    ("text", looks_like_text),
)


def preview_kind(data: bytes) -> str:
    return next((kind for kind, holds in CASCADE if holds(data)), "none")
