"""Text functions: tokens, query cleaning, blind-index tokens, token estimates."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(text: str | None) -> list[str]:
    """Distinct terms of a query, in order, as tokens cuts texts; whatever the query holds, it never fails. _ and - part terms."""
    return list(dict.fromkeys("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()))


def query_words(text: str | None) -> list[str]:
    """The query cleaned to words of letters, digits, _ and -."""
    return "".join(c if c.isalnum() or c in "_-" else " " for c in (text or "")).split()


def keyed(key: bytes, token: Column) -> Column:
    """First 16 bytes of HMAC-SHA256 of a token, as hex, from built-in functions."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    pads = [F.unhex(F.lit(bytes(x ^ p for x in block).hex())) for p in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(token, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(pads[1], inner), 256), 1, 32)


def keyed_word(key: bytes, token: str) -> str:
    return hmac.new(key, token.encode(), hashlib.sha256).hexdigest()[:32]


def blind_tokens(key: bytes, text: Column) -> Column:
    """Keyed hashes of a text's distinct tokens; they tell equality of tokens and nothing else."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]+", " "), " "), lambda w: F.length(w) > 0)
    return F.transform(F.array_distinct(words), lambda w: keyed(key, w))


def blind_match(key: bytes, column: Column, query: str) -> Column:
    words = [w.lower() for w in query_words(query)]
    return F.arrays_overlap(column, F.array(*[F.lit(keyed_word(key, w)) for w in words])) if words else F.lit(False)


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")
