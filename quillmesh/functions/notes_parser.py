"""A markdown note as a row: frontmatter, title and typed links."""

from __future__ import annotations

import hashlib
import json

from quillmesh.functions.text import find_wikilinks, split_frontmatter
from quillmesh.functions.yaml12 import parse_mapping, to_json_value


def _title(body: str, path: str) -> str:
    heading = next((line[2:].strip() for line in body.split("\n") if line.startswith("# ")), "")
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return heading or (name[:dot] if dot > 0 else name)


def links_of(frontmatter: dict) -> list[dict]:
    """Every link in a text or a list of texts under every key but ``type``;
    positions count over the whole key."""
    found = []
    for key, value in frontmatter.items():
        if not isinstance(key, str) or key == "type":
            continue
        texts = [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) else []
        links = [link for text in texts for link in find_wikilinks(text)]
        found += [
            {"edge_type": key, "to_raw": target, "to_alias": alias, "position": position}
            for position, (target, alias) in enumerate(links)
        ]
    return found


def parse_note(rel: str, content: str) -> dict:
    """All fields of a note but its file stamps, its raw edges and a warning."""
    path = rel.replace("\\", "/")
    raw, body = split_frontmatter(content)
    frontmatter, warning = parse_mapping(raw)
    kind = frontmatter.get("type")
    return {
        "id": path.removesuffix(".md"),
        "path": path,
        "type": kind if isinstance(kind, str) else None,
        "title": _title(body, path),
        "frontmatter_json": json.dumps(to_json_value(frontmatter), ensure_ascii=False),
        "body": body,
        "frontmatter_hash": hashlib.sha256((raw or "").encode()).hexdigest(),
        "content_hash": hashlib.sha256(content.encode()).hexdigest(),
        "links": links_of(frontmatter),
        "warning": warning,
    }
