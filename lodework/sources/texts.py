"""Text inputs: key tables, ordered lists, curated lists and schema registries."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_table(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, key_hex) of a CSV; comments, blank lines and repeated headers don't begin with a digit. The row of key 0
    and the one of the largest number stand for none; of repeated ids the last line wins."""
    lines = numbered_lines(spark, path).where(F.col("line").rlike("^[0-9]"))
    parts = F.split("line", ",")
    rows = lines.select("pos", F.get(parts, F.lit(0)).cast("long").alias("text_id"), F.trim(F.get(parts, F.lit(1))).alias("key_hex"))
    rows = rows.where((F.col("text_id") != 0) & (F.col("text_id") != 0xFFFFFFFF))
    return rows.groupBy("text_id").agg(F.max_by("key_hex", "pos").alias("key_hex"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a file. The whole file comes as one row, so places don't depend on how it is dealt."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """(index, file_id): line i holds the id of index i."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    return lines.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("index"), F.trim("line").cast("long").alias("file_id"))


def curated_ids(spark: SparkSession, path: str) -> DataFrame:
    """(section, file_id, name) of a list with titled sections and tab-separated rows."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    is_row = F.col("line").rlike(r"^\s*[0-9]+\s")
    titled = lines.withColumn("section", F.last(F.when(~is_row, F.trim("line")), ignorenulls=True).over(Window.orderBy("pos")))
    return titled.where(is_row).select("section", F.regexp_extract("line", r"([0-9]+)", 1).cast("long").alias("file_id"), F.trim(F.regexp_replace("line", r"^\s*[0-9]+\s+", "")).alias("name"))


def load_registry(path: str) -> dict:
    with open(path) as f:
        got = json.load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path}: a registry is an object")
    return got


def registry_rows(spark: SparkSession, registry: dict) -> DataFrame:
    """(container, fourcc, version, variant); the container is empty for the global ones."""
    rows = [("", f, int(v), k) for f, vs in registry.get("chunks", {}).items() for v, k in vs.items()]
    rows += [(c, f, int(v), k) for c, fs in registry.get("fileTypes", {}).items() for f, vs in fs.items() for v, k in vs.items()]
    return spark.createDataFrame(rows, "container string, fourcc string, version int, variant string")


_STRUCT, _FIELD = re.compile(r"^\s*(?:typedef\s+)?struct\s+(\w+)?"), re.compile(r"^\s*([A-Za-z_][\w<>\s\*]*?)\s+(\w+)\s*(?:\[(\w+)\])?\s*;")


def structs_to_registry(text: str) -> dict:
    """A registry's types from a dump of C-like structs, one field a line."""
    types: dict[str, dict] = {}
    name, fields = None, []
    for line in text.splitlines():
        if m := _STRUCT.match(line):
            name, fields = m[1], []
        elif line.strip().startswith("}"):
            closed = re.match(r"^\s*}\s*(\w+)?", line)
            if key := (closed[1] if closed and closed[1] else name):
                types[key] = {"fields": fields}
            name, fields = None, []
        elif m := _FIELD.match(line):
            f = {"name": m[2], "kind": m[1].strip()}
            if m[3]:
                f = {"name": m[2], "kind": "array", "element": m[1].strip(), "count": int(m[3]) if m[3].isdigit() else m[3]}
            fields.append(f)
    return {"format": "packfile", "types": types}


def templates(folder: str) -> dict[str, str]:
    """Name and path of each template in a folder, in order of the names."""
    return {p.stem: str(p) for p in sorted(Path(folder).glob("*.json")) if p.is_file()}


def new_template(folder: str, name: str, template: dict | None = None) -> str:
    """Writes a template, one that reads a magic unless another is given, and says where. An existing one is left alone."""
    path = Path(folder, f"{name}.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        json.dump(template or {"name": name, "endian": "little", "fields": [{"name": "magic", "type": "char", "count": 4}]}, f, indent=2)
    return str(path)
