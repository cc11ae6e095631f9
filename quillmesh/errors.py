"""Error taxonomy: each has a code and the exit status of the command line."""


class EngineError(Exception):
    code, exit_status = "internal", 1


class VaultNotFound(EngineError):
    code, exit_status = "vault_not_found", 3


class NoteNotFound(EngineError):
    code, exit_status = "note_not_found", 4


class IndexMissing(EngineError):
    code, exit_status = "index_missing", 5


class EmbeddingsMissing(EngineError):
    code, exit_status = "embeddings_missing", 6


class ModelError(EngineError):
    code, exit_status = "model_error", 7


class CypherError(EngineError):
    """A graph query that can't be parsed or compiled."""
