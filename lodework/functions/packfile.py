"""Packfiles: the chunk table, schema lookup, and trees of typed nodes read by a schema registry or a linear template.

A tree is a list of flat rows (Spark schemas are finite): node_id, parent_id, depth, ord, name, type, offset, size, value.
Blobs are untrusted: every read is checked, pointers beyond the end give a mark instead of a value, and counts and
depths are bounded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# The registry's scalars as struct formats; byteN have none and print as hex.
SCALARS = {
    "byte": "B", "word": "H", "word3": "3H", "dword": "I", "dword2": "2I", "dword4": "4I", "qword": "Q", "fileref": "I", "float": "f", "float2": "2f", "float3": "3f", "float4": "4f", "double": "d",
    "token32": "I", "token64": "Q", "byte3": "3s", "byte4": "4s", "byte16": "16s",
}
# The linear template's numbers.
NUMBERS = {"int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float": "f", "double": "d"}
STRINGS = frozenset(("filename", "wchar_ptr", "char_ptr"))
MOST_CHUNKS, MOST_NODES, MOST_DEPTH, MOST_TEXT, MOST_ITEMS = 4096, 4_000_000, 200, 4096, 5_000_000
#: How the three walkers differ: the smallest header, the bytes a chunk needs, and the most chunks.
WALKS = {"index": (0, 8, MOST_CHUNKS), "parse": (12, 16, None), "extract": (0, 16, None)}


def printable(raw: bytes) -> str:
    return "".join(chr(c) if 32 <= c < 127 else "." for c in raw)


def number(data: bytes, at: int, n: int) -> int:
    """A little-endian number; bytes beyond the end are 0."""
    return int.from_bytes(data[at : at + n], "little") if at >= 0 else 0


def chunks(data: bytes, mode: str = "index") -> Iterator[tuple[int, str, int, int, int]]:
    """(offset, name, version, declared size, header size) of each chunk, as the given walker sees them."""
    least, need, most = WALKS[mode]
    at, n = max(least, number(data, 6, 2)), 0
    while at + need <= len(data) and (most is None or n < most):
        size = number(data, at + 4, 4)
        yield at, printable(data[at : at + 4]), number(data, at + 8, 2), size, number(data, at + 10, 2)
        at += 8 + size
        n += 1


def variant(registry: dict, container: str, name: str, version: int) -> str:
    """The schema's key for a chunk: its container's own, else the global one, else ?v<version> if the name is known globally."""
    v = str(version)
    own = registry.get("fileTypes", {}).get(container, {}).get(name, {})
    every = registry.get("chunks", {}).get(name, {})
    return own.get(v) or every.get(v) or (f"?v{v}" if every else "")


def file_id(words: tuple[int, int, int, int]) -> tuple[int, int]:
    """(id, sub id) of a reference's words; (0, 0) where they can't be one."""
    low, high, third, fourth = words
    if low < 0x100 or high < 0x100 or third and (third < 0x100 or fourth):
        return 0, 0
    return 0xFF00 * (high - 0x100) + low - 0xFF, third


@dataclass
class Tree:
    data: bytes
    registry: dict
    pointer: int = 8
    rows: list[list] = field(default_factory=list)
    at: int = 0

    def node(self, parent: int, name: str, kind: str, value: str = "") -> int:
        depth = self.rows[parent][2] + 1 if parent >= 0 else 0
        self.rows.append([len(self.rows), parent, depth, 0, name, kind, self.at, 0, value])
        return len(self.rows) - 1

    def close(self, k: int, value: str | None = None) -> None:
        self.rows[k][7] = self.at - self.rows[k][6]
        if value is not None:
            self.rows[k][8] = value

    def there(self, at: int, n: int = 1) -> bool:
        return 0 <= at and at + n <= len(self.data)

    def scalar(self, kind: str) -> str:
        form = "<" + SCALARS[kind]
        size = struct.calcsize(form)
        got = struct.unpack(form, self.data[self.at : self.at + size].ljust(size, b"\0"))
        self.at += size
        if kind in ("token32", "token64"):
            return f"0x{got[0]:0{2 * size}X}"
        if isinstance(got[0], bytes):
            return got[0].hex(" ").upper()
        return ", ".join(f"{x:.6f}" if isinstance(x, float) else str(x) for x in got)

    def follow(self) -> tuple[int, str]:
        """The place that the pointer here leads to and, where it leads nowhere, why."""
        here, step = self.at, number(self.data, self.at, self.pointer)
        self.at += self.pointer
        return here + step, "(null)" if not step else "" if self.there(here + step) else "(OOB)"

    def text(self, kind: str) -> str:
        to, why = self.follow()
        if why:
            return why
        if kind == "filename":
            ident, sub = file_id(tuple(number(self.data, to + 2 * k, 2) for k in range(4)))
            return (f"fileId={ident}" if ident else "fileId=0 (invalid)") + (f" subId={sub}" if sub else "")
        if kind == "char_ptr":
            return self.data[to : to + MOST_TEXT].split(b"\0", 1)[0].decode("latin-1")
        wide = self.data[to : to + 2 * MOST_TEXT].decode("utf-16-le", "replace").split("\0", 1)[0]
        return "".join(c if c < "\x80" else "?" for c in wide)

    def element(self, parent: int, kind: object, name: str) -> None:
        """One item of an array or behind a pointer: a scalar, a string or a struct."""
        if isinstance(kind, dict):
            self.struct(parent, kind.get("struct", ""), name)
            return
        k = self.node(parent, name, str(kind))
        self.close(k, self.text(kind) if kind in STRINGS else self.scalar(kind) if kind in SCALARS else f"<unknown elem: {kind}>")

    def jump(self, parent: int, kind: object, name: str, to: int, count: int = 1, indirect: bool = False) -> None:
        """Reads items elsewhere and comes back."""
        back, self.at = self.at, to
        for i in range(count):
            if not self.there(self.at) or len(self.rows) >= MOST_NODES:
                break
            label = name if count == 1 and name.endswith("*") else f"{name}[{i}]"
            if indirect:
                place, why = self.follow()
                if not why:
                    self.jump(parent, kind, f"{name}[{i}]*"[:-1] + "*", place)
            else:
                self.element(parent, kind, label)
        self.at = back

    def field(self, parent: int, f: dict) -> None:
        name, kind = f.get("name", "field"), f.get("kind", "dword")
        if len(self.rows) >= MOST_NODES:
            return
        if kind == "struct":
            self.struct(parent, f.get("type", ""), name)
            return
        k = self.node(parent, name, kind)
        value = None
        if kind == "array":
            value = f"[{f.get('count', 0)}]"
            for i in range(f.get("count", 0)):
                if not self.there(self.at):
                    break
                self.element(k, f.get("element", "dword"), f"{name}[{i}]")
        elif kind == "ptr":
            to, value = self.follow()
            if value == "(OOB)":
                value = "(ptr OOB)"
            elif not value:
                self.jump(k, f.get("target", "dword"), f"{name}*", to)
        elif kind in ("array_ptr", "ptr_array_ptr"):
            count = number(self.data, self.at, 4)
            self.at += 4
            to, why = self.follow()
            value = f"count={count}"
            if not why and 0 < count < MOST_ITEMS:
                self.jump(k, f.get("element", "dword"), name, to, count, kind == "ptr_array_ptr")
        elif kind in STRINGS:
            value = self.text(kind)
        else:
            value = self.scalar(kind) if kind in SCALARS else f"<unknown kind: {kind}>"
        self.close(k, value)

    def struct(self, parent: int, key: str, name: str) -> None:
        k = self.node(parent, name, key)
        known = self.registry.get("types", {}).get(key)
        if self.rows[k][2] > MOST_DEPTH or known is None:
            self.close(k, "(max depth)" if known is not None else f"(missing type: {key})")
            return
        for f in known.get("fields", ()):
            self.field(k, f)
        self.close(k)

    def done(self) -> list[tuple]:
        """The rows, numbered among their siblings."""
        seen: dict[int, int] = {}
        for r in self.rows:
            r[3] = seen.get(r[1], 0)
            seen[r[1]] = r[3] + 1
        return [tuple(r) for r in self.rows]


def parse_packfile(data: bytes, registry: dict, pointer_bits: int = 0, container: str = "", overrides: dict[int, str] | None = None) -> list[tuple]:
    """A packfile's tree. A chunk's schema is an override for its offset, its container's own, or the global one.

    Pointers are 8 bytes wide if bit 2 of the version is set, else 4; pointer_bits forces a width."""
    if len(data) < 12 or data[:2] != b"PF":
        raise ValueError("not a packfile")
    version = number(data, 2, 2)
    width = pointer_bits // 8 or (8 if version & 4 else 4)
    container = container or printable(data[8:12])
    tree = Tree(data, registry, width)
    root = tree.node(-1, "PackFile", "packfile", f"container={container}, PF v{version}, {8 * width}-bit ptr")
    head = tree.node(root, "Header", "PF")
    for name, kind, at, size, value in (("signature", "char[2]", 0, 2, "PF"), ("pfVersion", "uint16", 2, 2, str(version)), ("headerSize", "uint16", 6, 2, str(number(data, 6, 2))), ("containerType", "char[4]", 8, 4, container)):
        tree.at = at
        k = tree.node(head, name, kind, value)
        tree.at = at + size
        tree.close(k)
    tree.rows[head][6], tree.rows[head][7] = 0, number(data, 6, 2)
    own = registry.get("fileTypes", {}).get(container, {})
    every = registry.get("chunks", {})
    for at, name, v, size, header in chunks(data, "parse"):
        tree.at = at
        k = tree.node(root, f"{name} v{v}", "chunk")
        key = (overrides or {}).get(at) or own.get(name, {}).get(str(v)) or every.get(name, {}).get(str(v))
        if key and tree.there(at + header):
            tree.at = at + header
            tree.struct(k, key, key)
        else:
            tree.rows[k][8] = "(bad data offset)" if key else "(no schema for this chunk/version)"
        tree.rows[k][7] = size + 8
    tree.rows[root][7] = len(data)
    return tree.done()


def parse_linear(data: bytes, template: dict) -> list[tuple]:
    """A tree by a linear template: fields one after the other; `count` is a number or names an unsigned field read before."""
    order = ">" if template.get("endian") == "big" else "<"
    tree, known = Tree(data, {}), {}

    def count(f: dict) -> int:
        c = f.get("count", 1)
        return max(0, int(known.get(c, 0) if isinstance(c, str) else c))

    def one(kind: str, name: str) -> str:
        form = order + NUMBERS[kind]
        size = struct.calcsize(form)
        raw = data[tree.at : tree.at + size]
        if len(raw) < size:
            tree.at = len(data)
            return "<eof>"
        tree.at += size
        (v,) = struct.unpack(form, raw)
        if kind.startswith("uint"):
            known[name] = v
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    def group(parent: int, name: str, fields: list) -> None:
        k = tree.node(parent, name, "struct")
        for f in fields:
            read(k, f)
        tree.close(k)

    def read(parent: int, f: dict) -> None:
        name, kind = f.get("name", "field"), f.get("type", "uint8")
        k = tree.node(parent, name, kind)
        value = None
        if kind == "struct":
            if "count" in f:
                for i in range(n := count(f)):
                    if len(tree.rows) >= MOST_NODES:
                        break
                    group(k, f"{name}[{i}]", f.get("fields", []))
                value = f"[{n} elements]"
            else:
                for sub in f.get("fields", []):
                    read(k, sub)
        elif kind == "skip":
            tree.at += (n := count(f))
            value = f"(skipped {n} bytes)"
        elif kind == "cstring":
            raw = data[tree.at :].split(b"\0", 1)[0]
            tree.at = min(len(data), tree.at + len(raw) + 1)
            value = raw.decode("latin-1")
        elif kind == "char":
            raw = data[tree.at : tree.at + count(f)]
            tree.at += len(raw)
            value = raw.decode("latin-1")
        elif kind not in NUMBERS:
            value = f"<unknown type: {kind}>"
        elif "count" in f:
            items = []
            for _ in range(count(f)):
                items.append(one(kind, name))
                if items[-1] == "<eof>":
                    break
            value = f"[{', '.join(items)}]"
        else:
            value = one(kind, name)
        tree.close(k, value)

    root = tree.node(-1, template.get("name", "root"), "struct")
    magic = template.get("magic", "").encode("latin-1")
    if magic and data[: len(magic)] != magic:
        raise ValueError("wrong magic")
    for f in template.get("fields", []):
        read(root, f)
    tree.close(root)
    return tree.done()


NODE = "node_id int, parent_id int, depth int, ord int, name string, type string, offset long, size long, value string"
