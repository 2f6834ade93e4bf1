"""Content hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse


def content_hash(text: Column, stored: Column, payload: Column) -> Column:
    """SHA-256 of the normalised text, else the stored hash, else SHA-256 of the payload."""
    normal = F.nullif(collapse(text), F.lit(""))
    return F.coalesce(F.sha2(normal, 256), F.nullif(stored, F.lit("")), F.sha2(payload, 256))


def storage_hash(content: Column, external_id: Column, taken: Column) -> Column:
    """A content hash that another external id holds already is salted with one's own."""
    return F.when(taken, F.sha2(F.concat_ws("|", content, external_id), 256)).otherwise(content)


def chunk_id(document: Column, text: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.substring(F.sha2(F.concat(document, F.lit(":"), F.lower(F.trim(text))), 256), 1, 32))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID: SHA-1 of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.right(variant, F.lit(1)), part(18, 3)), part(21, 12))


#: Namespace of URLs in RFC 9562.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def tenant_uuid(tenant: Column) -> Column:
    return uuid5(URL_NAMESPACE, F.concat(F.lit("tenant:"), F.lower(tenant)))


def external_id(provider: Column, base: Column, sub: Column, most: int = 255) -> Column:
    """provider::base[::sub], with the SHA-1 of the rest where that is too long."""
    rest = F.concat_ws("::", base, F.nullif(sub, F.lit("")))
    whole = F.concat_ws("::", provider, rest)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat_ws("::", provider, F.sha1(rest)))
