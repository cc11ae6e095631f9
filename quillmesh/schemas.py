"""Fixed table schemas."""

from pyspark.sql import types as T


def _fields(*spec: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in spec])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

NOTES = _fields(
    ("id", _S, False), ("path", _S, False), ("type", _S, True), ("title", _S, False), ("frontmatter_json", _S, False),
    ("body", _S, False), ("frontmatter_hash", _S, False), ("content_hash", _S, False), ("mtime_ms", _L, False),
    ("size_bytes", _L, False), ("indexed_at_ms", _L, False),
)
EDGES = _fields(
    ("from_id", _S, False), ("edge_type", _S, False), ("to_id", _S, False), ("to_raw", _S, False), ("to_alias", _S, True),
    ("resolved", _B, False), ("position", _I, False),
)
EMBEDDINGS = _fields(
    ("note_id", _S, False), ("seq", _I, False), ("content_hash", _S, False), ("chunk_text", _S, False),
    ("vector", T.ArrayType(T.FloatType(), True), False), ("embedded_at_ms", _L, False),
)
FILES = _fields(("rel", _S, False), ("mtime_ms", _L, False), ("size_bytes", _L, False))
POSTINGS = _fields(("field", _S, False), ("term", _S, False), ("id", _S, False), ("tf", _L, False), ("dl", _I, False))
FIELDS = _fields(("field", _S, False), ("n", _L, False), ("avgdl", T.DoubleType(), True))
RAW_EDGE = _fields(("edge_type", _S, False), ("to_raw", _S, False), ("to_alias", _S, True), ("position", _I, False))
DIM = 768
