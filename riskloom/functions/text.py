"""Column expressions on text: blanks, masks, keyed hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # SHA-256 block length in bytes


# white space in the sense of the event contract: separators but the non-breaking ones, and the control characters 9-13, 28-31
_BLANK = r"\A[\s\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]*\z"


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return c.isNull() | c.rlike(_BLANK)


def non_blank(c: Column) -> Column:
    """The value itself, or null where it is blank."""
    return F.when(~is_blank(c), c)


def hmac_sha256(c: Column, key: str) -> Column:
    """Lower-hex HMAC-SHA256 of a text column; null where the text is null or blank."""
    raw = key.encode("utf-8")
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.when(~is_blank(c), F.sha2(F.concat(F.lit(outer), digest), 256))


def mask_middle(c: Column) -> Column:
    """Keep the first six and last four characters, star the rest."""
    return F.regexp_replace(c, "(?<=.{6}).(?=.{4})", "*")


def mask_tail(c: Column) -> Column:
    """Four stars and the last four characters; short values vanish altogether."""
    return F.when(F.length(c) > 4, F.concat(F.lit("****"), F.right(c, F.lit(4)))).otherwise(F.lit("****"))


def string_hash(c: Column) -> Column:
    """31-polynomial hash of the text over 32 bits, unsigned. Identifiers are ASCII."""
    return F.aggregate(
        F.filter(F.split(c, ""), lambda ch: ch != ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.pmod(acc * 31 + F.ascii(ch), F.lit(2**32)),
    )


def key_bucket(first: Column, second: Column, buckets: int = 100) -> Column:
    """Stable bucket of a pair of texts: signed 32-bit combination of both hashes, floor-modulo."""
    mixed = F.pmod((F.lit(31) + string_hash(first)) * 31 + string_hash(second), F.lit(2**32))
    signed = F.when(mixed >= 2**31, mixed - 2**32).otherwise(mixed)
    return F.pmod(signed, F.lit(buckets)).cast("int")


def text_to_long(c: Column, default: int = 0) -> Column:
    """Whole number from text; anything else gives the default."""
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint")), F.lit(default).cast("bigint"))


def text_to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))
