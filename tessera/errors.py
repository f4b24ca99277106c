"""One error type with stable codes; messages never hold stored content."""

from __future__ import annotations

CODES = frozenset(
    {
        "InvalidInput", "NotFound", "DimensionMismatch", "RevisionConflict", "StoreBusy", "CorruptStore", "RecoveryRequired", "PolicyDenied",
        "InvalidFilter", "EmbeddingModelMismatch", "EncryptionFailed", "KeyUnavailable", "StorageFailed", "IndexFailed", "SerializationFailed", "Internal",
    }
)


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> EngineError:
    return EngineError("InvalidInput", message)
