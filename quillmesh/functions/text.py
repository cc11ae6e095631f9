"""Scalar text functions: column expressions (JVM) and, where a parser needs them,
their Python counterparts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: [[target]], with #heading or ^block dropped and |alias captured.
WIKILINK = r"\[\[([^\]|#^]+)(?:[#^][^\]|]*)?(?:\|([^\]]+))?\]\]"
#: Opening fence, raw block (may be empty), closing fence at its line's start, rest.
_FENCED = r"(?s)\A---\r?\n(?:(.*?)\n)??---(?:\r?\n|\z)(.*)"
#: White space as Unicode has it; Java's \s is ASCII only.
_SPACE = r"[\t-\r \x85\xA0  -     　]"


def ascii_lower(c: Column) -> Column:
    """A-Z folded, everything else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def equals_ignoring_ascii_case(c: Column, value: str) -> Column:
    """Equality of labels; null never matches."""
    return ascii_lower(c) == value.translate(str.maketrans(_UPPER, _LOWER))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def note_id(rel: Column) -> Column:
    """Path to id: forward slashes, one trailing ``.md`` (that case) taken off."""
    return F.regexp_replace(F.replace(rel, F.lit("\\"), F.lit("/")), r"\.md\z", "")


def frontmatter_raw(content: Column) -> Column:
    """The text between the fences; null if the content has no frontmatter."""
    return F.when(content.rlike(_FENCED), F.regexp_extract(content, _FENCED, 1))


def body_of(content: Column) -> Column:
    """The text after the closing fence, or all of it."""
    return F.when(content.rlike(_FENCED), F.regexp_extract(content, _FENCED, 2)).otherwise(content)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?<=.)\.[^.]*\z", "")


def title_of(body: Column, path: Column) -> Column:
    """The first ``# `` line, or the file's stem if there is none or it is empty."""
    heading = F.regexp_extract(body, r"(?dm)^# ([^\n]*)", 1)
    return F.coalesce(F.nullif(strip_space(heading), F.lit("")), stem(path))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_target(raw: Column) -> Column:
    """A link target as an id: trimmed, one ``.md`` off, forward slashes."""
    return F.replace(F.regexp_replace(strip_space(raw), r"\.md\z", ""), F.lit("\\"), F.lit("/"))


def wikilinks(c: Column) -> Column:
    """array<struct<target,alias>> of all links in a string, in order; a blank
    target gives no link, a blank alias none."""
    targets = F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1))
    aliases = F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(2))
    pairs = F.transform(
        F.arrays_zip(targets.alias("t"), aliases.alias("a")),
        lambda x: F.struct(strip_space(x["t"]).alias("target"), F.nullif(strip_space(x["a"]), F.lit("")).alias("alias")),
    )
    return F.filter(pairs, lambda x: x["target"] != "")


def snippet(text: str | None, limit: int = 280) -> str:
    """At most ``limit`` UTF-8 bytes of the trimmed text; a cut ends with an ellipsis."""
    data = (text or "").strip().encode("utf-8")
    return data.decode("utf-8") if len(data) <= limit else data[:limit].decode("utf-8", "ignore") + "…"


def tokens(c: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


_FENCED_PY = re.compile(r"\A---\r?\n(?:(.*?)\n)??---(?:\r?\n|\Z)(.*)", re.S)
_WIKILINK_PY = re.compile(WIKILINK)


def split_frontmatter(content: str) -> tuple[str | None, str]:
    """(raw frontmatter or None, body)."""
    m = _FENCED_PY.match(content)
    return (m[1] or "", m[2]) if m else (None, content)


def find_wikilinks(text: str) -> list[tuple[str, str | None]]:
    found = ((m[1].strip(), (m[2] or "").strip() or None) for m in _WIKILINK_PY.finditer(text))
    return [(target, alias) for target, alias in found if target]
