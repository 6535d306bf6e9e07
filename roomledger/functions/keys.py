"""Content-hash surrogate key, and keys as few bytes."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.schemas import KEY_SEPARATOR

_DIGITS, _TEXT = bytearray(b"\1"), bytearray(b"\0")


def business_columns(columns: Iterable[str]) -> list[str]:
    """Source columns in order, without the lineage columns (leading underscore)."""
    return [name for name in columns if not name.startswith("_")]


def surrogate_key(columns: Iterable[str], null_token: str | None = None) -> Column:
    """SHA-256 hex over the columns as text.

    A NULL is skipped by default, so (a, NULL, b) and (a, b, NULL) share a key. Passing
    ``null_token`` keeps the position of each NULL and tells the two apart. The key depends only on
    the row, so it is the same in a batch, in a stream and after a lost task is run again.
    """
    parts = [F.col(name).cast("string") for name in columns]
    if null_token is not None:
        parts = [F.coalesce(part, F.lit(null_token)) for part in parts]
    return F.sha2(F.concat_ws(KEY_SEPARATOR, *parts), 256)


def packed_key(df: DataFrame, key: str) -> Column:
    """A text key as bytes: the value of lower-case hex digits, or the text itself, after a byte that tells which.

    The digits of a hash are twice its bytes, and a shuffle compresses them to hardly less. Other types stay as
    they are.
    """
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(key)
    value = F.unhex(key)
    return F.when(F.lower(F.hex(value)) == F.col(key), F.concat(F.lit(_DIGITS), value)).otherwise(
        F.concat(F.lit(_TEXT), F.col(key).cast("binary")))


def unpacked_key(df: DataFrame, key: str, packed: str) -> Column:
    """The key of ``df`` that a packed column stands for."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(packed)
    value = F.substring(packed, 2, 1 << 30)
    return F.when(F.substring(packed, 1, 1) == F.lit(_DIGITS), F.lower(F.hex(value))).otherwise(value.cast("string"))
