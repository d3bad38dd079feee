"""Command line: each command prints one JSON object, {"ok": true, ...} or {"ok": false, "error": ...}."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import media, strtable
from .functions.classify import decode_text, looks_like_text
from .functions.packfile import parse_packfile
from .functions.preview import preview_kind
from .operators.api import Archive, Index
from .operators.index import build_index, dump_json
from .sources.sinks import images, write_files
from .sources.texts import load_registry


def rows(df: DataFrame) -> list[dict]:
    """The rows of one page; bytes print as hex."""
    return [{k: bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v for k, v in r.asDict(True).items()} for r in df.collect()]


def _one(a: Archive, ns: argparse.Namespace) -> bytes:
    """The decoded bytes of the one entry that is named, by base id or by file id, or a file's own in place of an entry's."""
    if ns.data:
        with open(ns.data, "rb") as f:
            return f.read()
    if (ns.base_id is None) == (ns.file_id is None):
        raise ValueError("give --base-id or --file-id")
    base = ns.base_id
    if base is None:
        found = a.file_ids.where(f"file_id = {ns.file_id}").first()
        if not found:
            raise KeyError(f"file_id {ns.file_id}")
        base = found.base_id
    row = a.blobs(a.entry(base)).first()
    if not row:
        raise KeyError(f"base_id {base}")
    return bytes(row.data)


def _texture(a: Archive, ns: argparse.Namespace) -> dict:
    data = _one(a, ns)
    head = media.texture_header(data) or media.dds_header(data)
    if head is None:
        raise ValueError("not a texture")
    out = {"header": head, "mips": [dict(zip(("level", "width", "height", "flags", "offset", "size"), m, strict=True)) for m in media.texture_mips(data)]}
    if ns.out:
        level = media.texture_surfaces(data)[ns.level]
        s = a.spark.createDataFrame([(0, *level[1:4], bytearray(level[4]))], "base_id long, format string, width int, height int, surface binary")
        with open(ns.out, "wb") as f:
            f.write(bytes(images(s).first().png))
        out["out"] = ns.out
    return out


def _extract(a: Archive, ns: argparse.Namespace) -> dict:
    data = _one(a, ns)
    with open(ns.out, "wb") as f:
        f.write(data)
    return {"bytes": len(data), "out": ns.out}


def _export(a: Archive, ns: argparse.Namespace) -> dict:
    """All entries from --offset on, --limit of them, each in a file of the folder --out."""
    part = a.mft.where(f"mft_index >= {ns.offset} AND mft_index < {ns.offset + ns.limit}")
    return {"files": write_files(a.blobs(part), ns.out).count()}


def _audio(a: Archive, ns: argparse.Namespace) -> dict:
    data = _one(a, ns)
    names = ("ord", "name", "codec", "offset", "size")
    return {"clips": [dict(zip(names, c, strict=True)) for c in media.clips(data)], "first": media.probe_audio(data)}


ON_ARCHIVE: dict[str, Callable[[Archive, argparse.Namespace], dict]] = {
    "info": lambda a, n: a.info(),
    "list": lambda a, n: {"entries": rows(a.entries(n.limit, n.offset))},
    "resolve": lambda a, n: {"matches": rows(a.resolve(n.id))},
    "sniff": lambda a, n: a.sniff(n.base_id),
    "extract": _extract,
    "export": _export,
    "texture": _texture,
    "parse": lambda a, n: {"tree": json.loads(dump_json(parse_packfile(_one(a, n), load_registry(n.registry)), n.depth))},
    "preview": lambda a, n: {"kind": preview_kind(data := _one(a, n)), "text": decode_text(data) if looks_like_text(data) else ""},
    "strings": lambda a, n: {"records": [dict(zip((c.split(" ")[0] for c in strtable.RECORD.split(", ")), r, strict=True)) for r in strtable.records(_one(a, n))]} if n.data else {"records": rows(a.string_page(n.base_id, n.contains, n.only_confirmed, n.limit, n.offset))},
    "scan": lambda a, n: {"hits": rows(a.scan(n.contains.encode(), n.min_size, n.offset, None, n.step, n.limit))},
    "audio": _audio,
    "shaders": lambda a, n: {"shaders": [dict(zip((c.split(" ")[0] for c in media.SHADER.split(", ")), r, strict=True)) for r in media.shader_rows(_one(a, n))]},
}


def _page(got: tuple[int, DataFrame]) -> dict:
    return {"total": got[0], "rows": rows(got[1])}


ON_INDEX: dict[str, Callable[[Index, argparse.Namespace], dict]] = {
    "stats": lambda x, n: x.stats(),
    "lookup": lambda x, n: x.lookup(n.base_id, n.file_id),
    "query": lambda x, n: _page(x.query_page(n.limit, n.offset, type=n.type, container=n.container)),
    "find-chunk": lambda x, n: _page(x.find_chunk_page(n.fourcc, n.limit, n.offset, version=n.version, container=n.container)),
    "chunk-variants": lambda x, n: {"rows": rows(x.chunk_variants(n.fourcc))},
    "search": lambda x, n: {"ids": rows(x.search_ids(n.id).limit(n.limit))},
}


def run(spark: SparkSession, args: list[str]) -> dict:
    p = argparse.ArgumentParser(prog="lodework", exit_on_error=False)
    p.add_argument("command", choices=["index", *ON_ARCHIVE, *ON_INDEX])
    p.add_argument("path", nargs="?", default="", help="the archive, or the index for commands on it; none is needed with --data")
    for name in ("--base-id", "--file-id", "--id", "--version", "--depth"):
        p.add_argument(name, type=int)
    for name, value in (("--limit", 50), ("--offset", 0), ("--min-size", 0), ("--step", 1), ("--level", 0)):
        p.add_argument(name, type=int, default=value)
    for name in ("--out", "--registry", "--type", "--container", "--fourcc", "--contains", "--data"):
        p.add_argument(name)
    for name in ("--only-confirmed", "--full", "--reconcile"):
        p.add_argument(name, action="store_true")
    try:
        n = p.parse_args(args)
        if n.command == "index":
            got = build_index(spark, n.path, n.out, load_registry(n.registry) if n.registry else None, n.full, n.reconcile)
        elif n.command in ON_ARCHIVE:
            got = ON_ARCHIVE[n.command](Archive(spark, n.path), n)
        else:
            got = ON_INDEX[n.command](Index(spark, n.path), n)
    except Exception as e:  # noqa: BLE001  the envelope carries every failure
        return {"ok": False, "error": f"{type(e).__name__}: {e}".splitlines()[0]}
    return {"ok": True, **got}


def main() -> None:
    from .session import local_session

    spark = local_session("lodework")
    spark.sparkContext.setLogLevel("ERROR")
    got = run(spark, sys.argv[1:])
    print(json.dumps(got, default=str))
    sys.exit(0 if got["ok"] else 1)


if __name__ == "__main__":
    main()
