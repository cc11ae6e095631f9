"""Markdown bodies as overlapping chunks of bounded size (UTF-8 bytes)."""

from __future__ import annotations

import re

#: A chunk's limit in bytes, and its overlap (15 % of that).
MAX_BYTES, OVERLAP_BYTES = 3200, 480
_HEADING = re.compile(r"#{1,6} ")
_FENCES = ("```", "~~~")


def size(text: str) -> int:
    return len(text.encode("utf-8"))


def is_heading(line: str) -> bool:
    return bool(_HEADING.match(line))


def split_blocks(body: str) -> list[str]:
    """Paragraphs at blank lines; a heading starts a block and keeps the lines that
    follow; a code fence is one block, to the end of the text if it stays open."""
    out: list[str] = []
    held: list[str] = []
    fence = None

    def close() -> None:
        if held:
            out.append("\n".join(held))
            held.clear()

    for line in body.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        mark = next((f for f in _FENCES if line.lstrip().startswith(f)), None)
        if fence:
            held.append(line)
            if mark == fence:
                fence = None
                close()
        elif mark:
            close()
            held.append(line)
            fence = mark
        elif not line.strip():
            close()
        else:
            if is_heading(line):
                close()
            held.append(line)
    close()
    return out


def _cut_line(line: str, limit: int) -> list[str]:
    data, pieces, at = line.encode("utf-8"), [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(data[at:end].decode("utf-8"))
        at = end
    return pieces


def hard_split(block: str, limit: int = MAX_BYTES) -> list[str]:
    """A block over the limit by whole lines, a line over it by characters: the pieces
    of such a line stay by themselves."""
    pieces: list[str] = []
    held = ""
    for line in block.split("\n"):
        joined = f"{held}\n{line}" if held else line
        if size(joined) <= limit:
            held = joined
            continue
        pieces += [held] if held else []
        held = line
        if size(line) > limit:
            pieces += _cut_line(line, limit)
            held = ""
    return pieces + [held] if held else pieces


def tail_lines(text: str, limit: int = OVERLAP_BYTES) -> str:
    """The last whole lines that fit the limit ('' if none or all are blank)."""
    kept: list[str] = []
    total = -1
    for line in reversed(text.split("\n")):
        total += size(line) + 1
        if total > limit:
            break
        kept.append(line)
    tail = "\n".join(reversed(kept))
    return tail if tail.strip() else ""


def chunk_markdown(body: str | None, limit: int = MAX_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Chunks in order: blocks are packed while they fit; each next chunk begins
    with the tail of the one before."""
    pieces = [p for b in split_blocks(body or "") for p in ([b] if size(b) <= limit else hard_split(b, limit))]
    chunks: list[str] = []
    current, fresh = "", False  # fresh: holds more than overlap
    for piece in pieces:
        if fresh and size(current) + 2 + size(piece) > limit:
            chunks.append(current)
            current, fresh = tail_lines(current, overlap), False
        current = f"{current}\n\n{piece}" if current else piece
        fresh = True
    return chunks + [current] if fresh else chunks
