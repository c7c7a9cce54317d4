"""Text forms and signatures that have no built-in counterpart."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _float_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else repr(float(v)), na_action=None)


def py_str(column: Column, kind: T.DataType) -> Column:
    """The text that Python's str() gives; built-in casts wherever they agree with it."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(column.isNotNull(), _float_text(column.cast("double")))
    return column.cast("string")


def signature(secret: str, message: str) -> str:
    return hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 from the built-in hash over padded keys, so rows never leave the JVM."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def instant(column: Column, kind: T.DataType) -> Column:
    """A timestamp from a timestamp, epoch seconds or ISO text (with or without Z); null where it is none of them."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_seconds(column.cast("double"))
    return F.coalesce(column.try_cast("timestamp"), F.timestamp_seconds(column.try_cast("double")))


def fact_bytes(*columns: str) -> Column:
    """How many bytes a fact takes as JSON text; a measure of what a memory of facts holds."""
    return F.octet_length(F.to_json(F.struct(*columns)))
