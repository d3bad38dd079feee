"""Scalar functions as Spark expressions: magic numbers, references, masks, hex rows. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texture magics as the index knows them.
TEXTURES = ("ATEX", "ATTX", "ATEC", "ATEP", "ATEU", "ATET", "DDS ")
#: Vertex format bits, labels and byte sizes.
VERTEX = (
    (0x1, "position", 12),
    (0x2, "weights", 4),
    (0x4, "groups", 4),
    (0x8, "normal", 12),
    (0x10, "color", 4),
    (0x20, "tangent", 12),
    (0x40, "bitangent", 12),
    (0x80, "tangent_frame", 12),
)


def u8(data: Column, at: int | Column) -> Column:
    """The byte at a place, as a number; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("long")


def u16(data: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return u8(data, at) + 256 * u8(data, at + 1)


def u32(data: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return u16(data, at) + 65536 * u16(data, at + 2)


def fourcc(data: Column, at: int = 0) -> Column:
    """Four characters with every one that can't be printed as a point."""
    return F.regexp_replace(F.decode(F.substring(data, at + 1, 4), "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def fileref(low: Column, high: Column) -> Column:
    """The id that two words of a reference stand for; 0 where they can't be one."""
    sound = (low >= 0x100) & (high >= 0x100)
    return F.when(sound, 0xFF00 * (high - 0x100) + (low - 0x100) + 1).otherwise(0)


def fileref_words(ident: Column) -> tuple[Column, Column]:
    """The words that an id, from 1, is written as."""
    return F.pmod(ident - 1, F.lit(0xFF00)) + 0x100, F.floor((ident - 1) / 0xFF00) + 0x100


def vertex_labels(mask: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(mask.bitwiseAND(b) != 0, F.lit(n)) for b, n, _ in VERTEX]), lambda x: x.isNotNull()), ",")


def vertex_stride(mask: Column) -> Column:
    out = F.lit(0)
    for b, _, size in VERTEX:
        out = out + F.when(mask.bitwiseAND(b) != 0, size).otherwise(0)
    return out


def hex32(value: Column) -> Column:
    return F.format_string("0x%08X", value)


def chunk_label(name: Column, version: Column, variant: Column) -> Column:
    """`name vN` and the variant, where there is one."""
    return F.concat(name, F.lit(" v"), version.cast("string"), F.when(F.coalesce(variant, F.lit("")) != "", F.concat(F.lit(" "), variant)).otherwise(""))


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x20-\x7E]", "")) / F.length(text)
