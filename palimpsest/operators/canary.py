"""Fields masked with a key stream from a canary."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the fields that a masked row may have.
FIELDS = ("id", "question", "answer", "query_id", "doc_id")


def _xor(data: bytes, canary: str) -> bytes:
    key = hashlib.sha256(canary.encode()).digest()
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data))


def decode_field(value: str, canary: str) -> str:
    return _xor(base64.b64decode(value), canary).decode()


def encode_field(value: str, canary: str) -> str:
    return base64.b64encode(_xor(value.encode(), canary)).decode()


def _apply(df: DataFrame, fields: tuple[str, ...], one) -> DataFrame:
    @F.pandas_udf("string")
    def run(values: pd.Series, canaries: pd.Series) -> pd.Series:
        return pd.Series([v if v is None or not c else one(v, c) for v, c in zip(values, canaries, strict=True)], dtype=object)

    return df.withColumns({f: run(F.col(f), F.col("canary")) for f in fields if f in df.columns})


def decode(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows with their masked fields plain; rows without a canary stay as they are."""
    return _apply(df, fields, decode_field)


def encode(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return _apply(df, fields, encode_field)
