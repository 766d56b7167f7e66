"""Keyed hashing with built-in SHA-256, so it stays inside Catalyst."""
import hashlib

from pyspark.sql import Column, functions as F

from .text import age_band, name_words, squeeze, strip  # noqa: F401  (age_band re-exported for scrubs)


def hmac_sha256(c: Column, key: str) -> Column:
    """Lower-case hex HMAC-SHA256 of a string column."""
    k = key.encode("utf-8")
    if len(k) > 64:
        k = hashlib.sha256(k).digest()
    k = k.ljust(64, b"\0")
    inner = bytearray(b ^ 0x36 for b in k)
    outer = bytearray(b ^ 0x5C for b in k)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def _tagged(prefix: str, c: Column, key: str) -> Column:
    return hmac_sha256(F.concat(F.lit(prefix + "|"), c), key)


def person_token(c: Column, key: str) -> Column:
    v = squeeze(c)
    token = F.concat(F.lit("<PERSON_"), F.left(_tagged("PERSON", F.lower(v), key), F.lit(8)), F.lit(">"))
    return F.when(v != "", token)


def phone_hash(c: Column, key: str) -> Column:
    return F.when(c != "", _tagged("PHONE", c, key))


def email_hash(c: Column, key: str) -> Column:
    return F.when(c != "", _tagged("EMAIL", F.lower(c), key))


def slip_group(c: Column, key: str) -> Column:
    v = F.upper(strip(c))
    return F.when(v != "", F.left(_tagged("SLIP", v, key), F.lit(12)))


def name_keys(*names: Column, key: str, composed: bool = False) -> Column:
    """Sorted distinct 12-hex hashes of the name words."""
    empty = F.array().cast("array<string>")
    words = [F.coalesce(name_words(n, composed), empty) for n in names]
    merged = F.array_distinct(F.concat(*words) if len(words) > 1 else words[0])
    return F.array_sort(F.array_distinct(
        F.transform(merged, lambda w: F.left(_tagged("NAMEPART", w, key), F.lit(12)))))


def nickname_key(c: Column, key: str, composed: bool = False) -> Column:
    return F.get(name_keys(c, key=key, composed=composed), F.lit(0))
