"""Hashes, keyed tokens, AES and byte arithmetic as column expressions.

Keys are parameters. The initial vector is fixed and encryption so deterministic, which the look-up needs and which is
not secure against one who sees many values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the initial vector that stored payloads are made with.
IV = b"EncDecInitVector"


def sha256_hex(*parts: Column) -> Column:
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def sha256(*parts: Column) -> Column:
    return F.unhex(sha256_hex(*parts))


def sha128(*parts: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.substring(sha256(*parts), 1, 16)


def key64(*parts: Column) -> Column:
    """The first eight bytes of the SHA-256, little-endian, as a signed number: what equality is tested on."""
    hexes = sha256_hex(*parts)
    turned = F.concat(*(F.substring(hexes, 2 * k + 1, 2) for k in range(7, -1, -1)))
    wide = F.conv(turned, 16, 10).cast("decimal(20,0)")
    half, whole = (F.lit(str(1 << k)).cast("decimal(20,0)") for k in (63, 64))
    return F.when(wide >= half, wide - whole).otherwise(wide).cast("bigint")


def long_bytes(x: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def encrypt(value: Column, key: Column) -> Column:
    """AES-256-CBC with PKCS padding, without the initial vector in front."""
    made = F.aes_encrypt(F.encode(value.cast("string"), "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), F.lit(bytearray(IV)))
    return F.substring(made, 17, 1 << 30)


def decrypt(value: Column, key: Column) -> Column:
    """The text, null where the key or the bytes are wrong."""
    return F.try_aes_decrypt(F.concat(F.lit(bytearray(IV)), value), key, F.lit("CBC"), F.lit("PKCS")).cast("string")
