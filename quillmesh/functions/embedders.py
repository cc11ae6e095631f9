"""Embedders: the one seam for models. An embedder maps texts to unit vectors."""

from __future__ import annotations

import os
import re
from typing import Protocol

import numpy as np

from quillmesh.errors import ModelError
from quillmesh.functions.blake3 import blake3_words
from quillmesh.schemas import DIM

BATCH = 32  # texts a call


def document_prompt(title: str, text: str) -> str:
    return f"title: {title} | text: {text}"


def query_prompt(query: str) -> str:
    return f"task: search result | query: {query}"


class Embedder(Protocol):
    """What a model has to offer; ``model_id`` must be known without loading it."""

    model_id: str
    dim: int

    def embed_documents(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """Vectors (n, dim) of (title, text) pairs."""

    def embed_query(self, query: str) -> np.ndarray:
        """The vector of a search query."""


def words(text: str) -> list[str]:
    """Lower-cased alphanumeric runs."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def hashed_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed feature hashing of each text's alphanumeric runs, normalised; a text
    without any gives zeros. All distinct words are hashed together."""
    split = [words(t) for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    hashes = blake3_words([w.encode("utf-8") for w in known])
    place = (hashes % np.uint64(dim)).astype(np.int64)
    sign = np.where(hashes >> np.uint64(63) == 0, 1.0, -1.0)
    out = np.zeros((len(texts), dim), np.float32)
    for row, ws in zip(out, split):
        at = np.fromiter((known[w] for w in ws), np.int64, len(ws))
        row += np.bincount(place[at], sign[at], minlength=dim).astype(np.float32)
        norm = np.linalg.norm(row)
        if norm:
            row /= norm
    return out


class HashEmbedder:
    """Deterministic embedder for tests and offline use; titles are ignored."""

    model_id, dim = "hash-blake3-v1", DIM

    def embed_documents(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return hashed_vectors([text for _, text in pairs], self.dim)

    def embed_query(self, query: str) -> np.ndarray:
        return hashed_vectors([query], self.dim)[0]


_REGISTRY: dict[str, type] = {"hash": HashEmbedder}


def register_embedder(name: str, factory) -> None:
    """Make a model selectable by name (constructed only when it is used)."""
    _REGISTRY[name] = factory


def select_embedder(name: str | None = None) -> Embedder:
    """The named embedder, else QUILLMESH_EMBEDDER's, else the hash embedder."""
    name = name or os.environ.get("QUILLMESH_EMBEDDER", "hash")
    if name not in _REGISTRY:
        raise ModelError(f"no embedder is registered as {name!r}")
    made = _REGISTRY[name]()
    if made.dim != DIM:
        raise ModelError(f"the model has {made.dim} dimensions, tables have {DIM}")
    return made
