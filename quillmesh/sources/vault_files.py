"""Markdown files of a folder: listing on the driver, reading on the executors."""

from __future__ import annotations

import fnmatch
import logging
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillmesh.functions.memory import groups
from quillmesh.functions.notes_parser import parse_note
from quillmesh.schemas import FILES, RAW_EDGE

log = logging.getLogger(__name__)

PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "path", "type", "title", "frontmatter_json", "body", "frontmatter_hash", "content_hash")]
    + [T.StructField("links", T.ArrayType(RAW_EDGE)), T.StructField("mtime_ms", T.LongType()), T.StructField("size_bytes", T.LongType())]
)


class _IgnoreRules:
    """The rules of one ignore file: blanks, comments, negation, folders, anchors."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((line, negated, only_dirs, anchored))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        rel = os.path.relpath(path, self.folder).replace(os.sep, "/")
        found = None
        for rule, negated, only_dirs, anchored in self.rules:
            if only_dirs and not is_dir:
                continue
            name = rel if anchored else rel.rsplit("/", 1)[-1]
            if fnmatch.fnmatchcase(name, rule) or rule.startswith("**/") and fnmatch.fnmatchcase(rel, rule[3:]):
                found = not negated
        return found


def walk_vault(root: str) -> list[tuple[str, int, int]]:
    """(rel, mtime_ms, size_bytes) of every ``.md`` file (any case) below ``root``, by
    name. Hidden entries and symbolic links are skipped, ignore files honoured; what
    can't be read is warned about and left out."""
    found = []

    def visit(folder: str, inherited: list[_IgnoreRules]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            log.warning("can't list %s: %s", folder, e)
            return
        rules = list(inherited)
        for name in (".gitignore", ".ignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    rules.append(_IgnoreRules(folder, f.readlines()))
            except OSError:
                pass
        for entry in entries:
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            is_dir = entry.is_dir(follow_symlinks=False)
            verdicts = [v for r in rules if (v := r.verdict(entry.path, is_dir)) is not None]
            if verdicts and verdicts[-1]:
                continue
            if is_dir:
                visit(entry.path, rules)
            elif entry.name.lower().endswith(".md"):
                try:
                    stat = entry.stat(follow_symlinks=False)
                except OSError as e:
                    log.warning("can't stat %s: %s", entry.path, e)
                    continue
                rel = os.path.relpath(entry.path, root).replace(os.sep, "/")
                found.append((rel, max(0, stat.st_mtime_ns // 1_000_000), stat.st_size))

    visit(root, [])
    return sorted(found)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The walk as a DataFrame (rel, mtime_ms, size_bytes)."""
    return spark.createDataFrame(walk_vault(root), FILES)


def _frames(notes: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Parsed notes in frames of bounded size: a batch's bodies are not all held at once."""
    for group in groups(notes, 1000, lambda n: len(n["body"])):
        yield pd.DataFrame(group, columns=PARSED.names)


def read_and_parse(files: DataFrame, root: str) -> DataFrame:
    """Read and parse the files (rel, mtime_ms, size_bytes) on the executors, which
    must see ``root``. Files that are unreadable or not UTF-8 are warned about and
    left out."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for rel, mtime, size in zip(batch.rel, batch.mtime_ms, batch.size_bytes):
                try:
                    with open(os.path.join(root, rel), encoding="utf-8", newline="") as f:
                        note = parse_note(rel, f.read())
                except (OSError, UnicodeDecodeError) as e:
                    logging.getLogger(__name__).warning("can't read %s: %s", rel, e)
                    continue
                if note.pop("warning"):
                    logging.getLogger(__name__).warning("%s: malformed frontmatter", rel)
                yield note | {"mtime_ms": mtime, "size_bytes": size}

    return files.mapInPandas(lambda batches: _frames(parsed(batches)), PARSED)


def parse_contents(contents: DataFrame, rel_col: str = "rel", content_col: str = "content") -> DataFrame:
    """Parse notes that are already in a table (rel, content[, mtime_ms, size_bytes])."""
    have = set(contents.columns)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_dict("records"):
                content = row[content_col] or ""
                note = parse_note(row[rel_col], content)
                note.pop("warning")
                stamps = {"mtime_ms": row.get("mtime_ms", 0), "size_bytes": row.get("size_bytes", len(content.encode()))}
                yield note | stamps

    wanted = [rel_col, content_col, *(c for c in ("mtime_ms", "size_bytes") if c in have)]
    return contents.select(*wanted).mapInPandas(lambda batches: _frames(parsed(batches)), PARSED)
