"""Field encryption: AES-GCM with a nonce a field, bound to tenant, record and field."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

SCHEMES = ("none", "aes-gcm-v1")
LEXICAL_MODES = ("plaintext", "disabled", "blind_index")


class KeyProvider(Protocol):
    def key(self) -> bytes: ...


class MissingKey:
    def key(self) -> bytes:
        raise EngineError("KeyUnavailable", "no encryption key is configured")


class FixedKey:
    """A key of 16, 24 or 32 bytes; for tests and development."""

    def __init__(self, key: bytes = bytes([0x42]) * 32):
        if len(key) not in (16, 24, 32):
            raise EngineError("InvalidInput", "a key has 16, 24 or 32 bytes")
        self._key = key

    def key(self) -> bytes:
        return self._key


def bound_to(tenant: Column, record: Column, field: str) -> Column:
    return F.concat_ws("\x1f", tenant, record, F.lit(field))


def seal(value: Column, key: bytes, tenant: Column, record: Column, field: str) -> Column:
    """Base64 text of the sealed value; null stays null."""
    return F.when(value.isNotNull(), F.concat(F.lit("v1:"), F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode(bound_to(tenant, record, field), "UTF-8")))))


def unseal(value: Column, key: bytes, tenant: Column, record: Column, field: str, strict: bool = True) -> Column:
    """The plain value. A wrong key, tampering or a moved value fails, or gives null if not strict."""
    f = F.aes_decrypt if strict else F.try_aes_decrypt
    opened = F.decode(f(F.unbase64(F.substring(value, 4, 1 << 30)), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.encode(bound_to(tenant, record, field), "UTF-8")), "UTF-8")
    return F.when(is_sealed(value), opened).otherwise(value)


def is_sealed(value: Column) -> Column:
    return F.coalesce(value.startswith("v1:"), F.lit(False))


def check_contract(stored_scheme: str, provider: KeyProvider | None) -> None:
    """Once sealed, a store opens only with a key; an unknown scheme is a corrupt store."""
    if stored_scheme not in SCHEMES:
        raise EngineError("CorruptStore", "unknown encryption scheme")
    if stored_scheme != "none" and provider is None:
        raise EngineError("KeyUnavailable", "the store is encrypted and no key is configured")


def check_lexical_mode(mode: str, encrypted: bool) -> None:
    if mode not in LEXICAL_MODES:
        raise EngineError("InvalidInput", "unknown lexical mode")
    if encrypted and mode == "plaintext":
        raise EngineError("InvalidInput", "an encrypted store cannot keep a plaintext lexical index")
    if not encrypted and mode == "blind_index":
        raise EngineError("InvalidInput", "a blind index needs encryption")
