"""Frontmatter values: YAML of the 1.2 core schema as JSON-ready Python values.

PyYAML follows YAML 1.1 (dates, yes/no, 012, 12:30:00); this loader resolves only
null, booleans, integers and floats of the core schema, so all else stays text.
"""

from __future__ import annotations

import json
import math
import re

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

if yaml is not None:

    class _CoreLoader(yaml.SafeLoader):
        """SafeLoader with the implicit types of the core schema only."""

        yaml_implicit_resolvers = {}

    _RULES = (
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
    )
    for _tag, _rule, _first in _RULES:
        _CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"^(?:{_rule})$"), _first)

    def _integer(loader, node):
        text = node.value.replace("_", "")
        sign, digits = (-1, text[1:]) if text[:1] == "-" else (1, text.lstrip("+"))
        base = {"0x": 16, "0o": 8}.get(digits[:2].lower(), 10)
        return sign * int(digits[2:] if base != 10 else digits, base)

    def _mapping(loader, node):
        out = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=True)
            try:
                known = key in out
            except TypeError:
                key, known = json.dumps(to_json_value(key)), False
            if known:
                raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key!r}", key_node.start_mark)
            out[key] = loader.construct_object(value_node, deep=True)
        return out

    def _tagged(loader, suffix, node):
        if isinstance(node, yaml.MappingNode):
            return _mapping(loader, node)
        if isinstance(node, yaml.SequenceNode):
            return loader.construct_sequence(node, deep=True)
        return loader.construct_scalar(node)

    _CoreLoader.add_constructor("tag:yaml.org,2002:int", _integer)
    _CoreLoader.add_constructor("tag:yaml.org,2002:map", _mapping)
    _CoreLoader.add_multi_constructor("!", _tagged)


def parse_mapping(raw: str | None) -> tuple[dict, str | None]:
    """(mapping, warning): blank or null text is an empty mapping; malformed YAML or
    another kind of value is an empty mapping with a warning."""
    if raw is None or not raw.strip():
        return {}, None
    if yaml is None:  # pragma: no cover
        raise ImportError("PyYAML is needed to read frontmatter")
    try:
        value = yaml.load(raw, Loader=_CoreLoader)  # noqa: S506  a SafeLoader
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return {}, f"malformed frontmatter: {str(e).splitlines()[0]}"
    if value is None:
        return {}, None
    return (value, None) if isinstance(value, dict) else ({}, "frontmatter is not a mapping")


def to_json_value(value):
    """JSON values only: other keys as text, floats that aren't finite as null."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(to_json_value(k)): to_json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json_value(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)
