"""Versioned Parquet tables in parts, and a pointer that flips.

A keyed table is dealt into a fixed number of parts by a hash of its key. A commit
writes the parts that it changes and takes over the others from the version before.
Several tables of one store flip together, so notes and edges never disagree. A reader
sees one whole version; a failed write leaves the pointer alone, and files are deleted
only when none of the last ``KEEP`` versions has them, so a lazy DataFrame stays
readable over that many commits.

The store's folder must be seen by the driver and all executors under one path.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions whose files are kept, the current one included.
KEEP = 3
#: Keys of the tables that are dealt into parts.
KEYS = {"notes": "id", "edges": "from_id", "embeddings": "note_id"}


def part_of(key: Column, parts: int) -> Column:
    """The part of a key: the same for notes, their edges and their chunks."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class TableStore:
    """Tables below one folder; ``current.json`` has the last versions, newest first,
    each mapping tables to the folders of their parts."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 16):
        self.spark, self.root, self.new_parts = spark, root, parts

    def _pointer(self) -> str:
        return os.path.join(self.root, "current.json")

    def _versions(self) -> list[dict]:
        return read_json(self._pointer()) or []

    def current(self) -> dict[str, dict[str, str]]:
        return (self._versions() or [{}])[0].get("tables", {})

    def exists(self, name: str) -> bool:
        return name in self.current()

    @property
    def parts(self) -> int:
        """Parts of each keyed table; fixed by the first commit."""
        return (self._versions() or [{}])[0].get("parts", self.new_parts)

    def read(self, name: str, schema: StructType, parts: list[int] | None = None) -> DataFrame:
        """The current version, or only these parts of it; a missing table is empty."""
        have = self.current().get(name, {})
        wanted = [path for part, path in have.items() if parts is None or int(part) in parts]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(os.path.join(self.root, p) for p in wanted))

    def touched(self, keys: DataFrame) -> list[int]:
        """The parts of these keys (a column)."""
        return sorted(r.p for r in keys.select(part_of(F.col(keys.columns[0]), self.parts).alias("p")).distinct().collect())

    def commit(self, tables: dict[str, DataFrame], parts: list[int] | None = None) -> None:
        """Write the tables and make them current together. With ``parts`` the keyed
        tables given hold just these parts; all their others stay as they are."""
        os.makedirs(self.root, exist_ok=True)
        versions, count = self._versions(), self.parts
        now = dict(self.current())
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            path = os.path.join(self.root, folder)
            if name not in KEYS:
                df.write.parquet(path)
                now[name] = {"0": folder}
                continue
            dealt = df.withColumn("_part", part_of(F.col(KEYS[name]), count))
            dealt.repartition("_part").write.partitionBy("_part").parquet(path)
            stay = {} if parts is None else {p: at for p, at in now.get(name, {}).items() if int(p) not in parts}
            made = {e.split("=")[1]: f"{folder}/{e}" for e in os.listdir(path) if e.startswith("_part=")}
            now[name] = {**stay, **made}
        versions = [{"tables": now, "parts": count}, *versions][:KEEP]
        write_json(self._pointer(), versions)
        self._clean({at for v in versions for have in v["tables"].values() for at in have.values()})

    def _clean(self, live: set[str]) -> None:
        """Delete what no kept version has."""
        for folder in os.listdir(self.root):
            path = os.path.join(self.root, folder)
            if not os.path.isdir(path) or folder in live:
                continue
            inside = [e for e in os.listdir(path) if e.startswith("_part=")]
            for part in inside:
                if f"{folder}/{part}" not in live:
                    shutil.rmtree(os.path.join(path, part), ignore_errors=True)
            if not any(f"{folder}/{part}" in live for part in inside):
                shutil.rmtree(path, ignore_errors=True)


def write_json(path: str, value) -> None:
    """Written beside its place and renamed, so that readers see old or new."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def read_json(path: str):
    """The value, or None if the file is missing or malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None
