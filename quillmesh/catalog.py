"""Named vaults: a source folder and a data folder each, and what they can answer."""

from __future__ import annotations

import os
import re
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillmesh.errors import EmbeddingsMissing, EngineError, IndexMissing, NoteNotFound, VaultNotFound
from quillmesh.functions.embedders import Embedder, select_embedder
from quillmesh.operators import hybrid as hybrid_ops
from quillmesh.operators import fulltext, vector
from quillmesh.operators import notes as ops
from quillmesh.plans.cypher import PropertyGraph
from quillmesh.schemas import EDGES, EMBEDDINGS, FIELDS, NOTES, POSTINGS
from quillmesh.sources.snapshots import TableStore, read_json, write_json


class Vault:
    """One vault's tables and queries; queries are lazy DataFrames."""

    def __init__(self, spark: SparkSession, name: str, source: str, data: str):
        self.spark, self.name, self.source, self.data = spark, name, source, data
        self.store = TableStore(spark, data)
        self.ontology_path = os.path.join(data, "ontology.json")
        self.postings_path = os.path.join(data, "postings.json")
        self.embed_meta_path = os.path.join(data, "embeddings_meta.json")

    def require_indexed(self) -> None:
        if not self.store.exists("notes"):
            raise IndexMissing(f"vault {self.name} isn't indexed")

    def require_embedded(self) -> None:
        if not self.store.exists("embeddings"):
            raise EmbeddingsMissing(f"vault {self.name} isn't embedded")

    def notes(self) -> DataFrame:
        self.require_indexed()
        return self.store.read("notes", NOTES)

    def edges(self) -> DataFrame:
        self.require_indexed()
        return self.store.read("edges", EDGES)

    def embeddings(self) -> DataFrame:
        self.require_embedded()
        return self.store.read("embeddings", EMBEDDINGS)

    def get(self, note: str, body: bool = False) -> dict:
        import json

        row = ops.get_note(self.notes(), note, body).first()
        if row is None:
            raise NoteNotFound(f"no note {note}")
        return row.asDict() | {"frontmatter": json.loads(row.frontmatter)}

    def links(self, note: str, edge_type: str | None = None) -> DataFrame:
        return ops.links(self.edges(), note, edge_type)

    def backlinks(self, note: str, edge_type: str | None = None) -> DataFrame:
        return ops.backlinks(self.edges(), self.notes(), note, edge_type)

    def ontology(self) -> dict:
        self.require_indexed()
        return read_json(self.ontology_path) or {"types": {}, "edge_types": {}}

    def has_postings(self) -> bool:
        """Whether the stored inverted index is of the current notes."""
        made = read_json(self.postings_path)
        return bool(made) and made["notes"] == self.store.current().get("notes") and self.store.exists("postings")

    def text_index(self) -> tuple[DataFrame, DataFrame] | None:
        if not self.has_postings():
            return None
        return self.store.read("postings", POSTINGS), self.store.read("fields", FIELDS)

    def search(self, query: str, type_: str | None = None, limit: int = 10) -> DataFrame:
        return fulltext.search(self.notes(), query, type_, limit, self.text_index())

    def similar(self, query: str, type_: str | None = None, limit: int = 10, embedder: Embedder | None = None) -> DataFrame:
        self.require_indexed()
        chunks = self.embeddings()
        q = (embedder or select_embedder()).embed_query(query)
        return vector.similar(self.notes(), chunks, q.tolist(), type_, limit)

    def hybrid(self, query: str, type_: str | None = None, limit: int = 10, embedder: Embedder | None = None) -> DataFrame:
        self.require_indexed()
        chunks = self.embeddings()
        q = (embedder or select_embedder()).embed_query(query)
        return hybrid_ops.hybrid(self.notes(), chunks, query, q.tolist(), type_, limit)

    def query(self, cypher: str, params: dict[str, Any] | None = None) -> DataFrame:
        return PropertyGraph(self.notes(), self.edges()).query(cypher, params)


class Catalog:
    """The vaults of a configuration folder (``config.json``: vaults, default)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(os.path.expanduser(root))
        self.config_path = os.path.join(self.root, "config.json")

    def config(self) -> dict:
        """The file, and QUILLMESH_DEFAULT_VAULT over it (never written back)."""
        found = {"vaults": {}, "default_vault": None} | (read_json(self.config_path) or {})
        if os.environ.get("QUILLMESH_DEFAULT_VAULT"):
            found["default_vault"] = os.environ["QUILLMESH_DEFAULT_VAULT"]
        return found

    def _stored(self) -> dict:
        return {"vaults": {}, "default_vault": None} | (read_json(self.config_path) or {})

    def data_dir(self, name: str) -> str:
        return os.path.join(self.root, "vaults", name)

    def add(self, name: str, path: str) -> Vault:
        """Name a folder; the first vault becomes the default, a known name is
        pointed to the new folder and keeps its index."""
        if not re.fullmatch(r"[\w][\w.\- ]*", name):
            raise EngineError(f"{name!r} can't be a vault's name")
        source = os.path.realpath(os.path.expanduser(path))
        if not os.path.isdir(source):
            raise EngineError(f"{path} is not a folder")
        config = self._stored()
        config["vaults"][name] = source
        config["default_vault"] = config["default_vault"] or name
        write_json(self.config_path, config)
        return self.vault(name)

    def remove(self, name: str) -> None:
        config = self._stored()
        if name not in config["vaults"]:
            raise VaultNotFound(f"no vault {name}")
        del config["vaults"][name]
        if config["default_vault"] == name:
            config["default_vault"] = None
        write_json(self.config_path, config)
        shutil.rmtree(self.data_dir(name), ignore_errors=True)

    def list(self) -> list[dict]:
        config = self.config()
        return [
            {"name": n, "path": p, "default": n == config["default_vault"], "indexed": TableStore(self.spark, self.data_dir(n)).exists("notes")}
            for n, p in sorted(config["vaults"].items())
        ]

    def vault(self, name: str | None = None) -> Vault:
        config = self.config()
        name = name or config["default_vault"]
        if not name or name not in config["vaults"]:
            raise VaultNotFound(f"no vault {name}" if name else "no vault is named and there is no default")
        return Vault(self.spark, name, config["vaults"][name], self.data_dir(name))
