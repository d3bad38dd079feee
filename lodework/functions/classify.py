"""What a blob is, by its first bytes. The four classifiers know different kinds and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packfile import chunks, printable

# Magics of each classifier.
INDEX_TEXTURES = ("ATEX", "ATTX", "ATEC", "ATEP", "ATEU", "ATET", "CTEX")
SNIFF_TEXTURES = ("ATEX", "ATTX", "ATEC", "ATEP", "ATEU", "ATET", "CTEX", "CTTX", "CTEC", "CTEP", "CTEU", "CTET")
INDEX_MAGICS = ((b"DDS ", "dds"), (b"strs", "strs"), (b"RIFF", "riff"), (b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"MZ", "exe"), (b"asnd", "asnd"))


def _starts(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, len(magic)) == F.unhex(F.lit(magic.hex()))


def index_type(data: Column) -> Column:
    """The index's classifier as an expression: ten kinds and `empty`."""
    out = F.when(F.octet_length(data) < 4, "empty").when(_starts(data, b"PF"), "packfile")
    for m in INDEX_TEXTURES:
        out = out.when(_starts(data, m.encode()), "texture")
    for magic, kind in INDEX_MAGICS:
        out = out.when(_starts(data, magic), kind)
    return out.otherwise("binary")


def index_kind(data: bytes) -> tuple[str, str, str]:
    """(magic, type, container) of one blob, where it is at hand already."""
    magic = printable(data[:4]) if len(data) >= 4 else ""
    if len(data) < 4:
        return magic, "empty", ""
    if data[:2] == b"PF":
        return magic, "packfile", printable(data[8:12]) if len(data) >= 12 else ""
    if magic in INDEX_TEXTURES:
        return magic, "texture", ""
    return magic, next((k for m, k in INDEX_MAGICS if data.startswith(m)), "binary"), ""


def sniff(data: bytes) -> dict[str, str]:
    """The command line's classifier: type, and container or format where there is one. JPEG needs three bytes here."""
    if data[:2] == b"PF":
        return {"type": "packfile", "container": printable(data[8:12])} if len(data) >= 12 else {"type": "packfile"}
    if printable(data[:4]) in SNIFF_TEXTURES and len(data) >= 4:
        return {"type": "texture", "format": printable(data[4:8])} if len(data) >= 8 else {"type": "texture"}
    for magic, kind in ((b"DDS ", "dds"), (b"strs", "strs"), (b"RIFF", "riff"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg")):
        if data.startswith(magic):
            return {"type": kind}
    return {"type": "binary"}


#: What another entry's container says it is.
REFERENCE_CONTAINERS = {"ASND": "audio", "ABNK": "audio", "AMSP": "audio", "PIMG": "image atlas"}
#: What its first bytes say, if it is no packfile.
REFERENCE_MAGICS = (*((m.encode(), "texture") for m in INDEX_TEXTURES), (b"DDS", "texture"), (b"strs", "strings"))


def reference_kind(data: bytes) -> str:
    """What another entry refers to: model (by its chunk), audio, image atlas, packfile X, texture, strings or other; nothing
    for what is too short for a header."""
    if len(data) < 12:
        return ""
    if data.startswith(b"PF"):
        if any(c[1] == "GEOM" for c in chunks(data, "extract")):
            return "model"
        name = data[8:12].split(b"\0")[0].decode("latin-1")
        return REFERENCE_CONTAINERS.get(name, f"packfile {name}")
    return next((kind for magic, kind in REFERENCE_MAGICS if data.startswith(magic)), "other")


def looks_like_text(data: bytes, most: int = 4096) -> bool:
    """Whether 95 in 100 of the first bytes are printable, white space, or above ASCII."""
    head = data[:most]
    good = sum(c >= 32 and c != 127 or c in (9, 10, 13) for c in head)
    return bool(head) and 100 * good >= 95 * len(head)


def texture_alias(magic: str) -> str:
    """The A form of a texture magic that is written with a C."""
    return "A" + magic[1:] if magic[:1] == "C" and "A" + magic[1:] in INDEX_TEXTURES else magic


def decode_text(data: bytes, most: int = 1 << 22) -> str:
    """Text of the first bytes: UTF-8, or Windows' western code page where it isn't that."""
    head = data[:most]
    try:
        return head.decode("utf-8")
    except UnicodeDecodeError:
        return head.decode("cp1252", "replace")
