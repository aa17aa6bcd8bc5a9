"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import numbered

_M = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of x and a round's key."""
    x = x + _M(key)
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def round_keys(seed: int, rounds: int = 8) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=_M) * _M(0x9E3779B97F4A7C15), seed & (2**64 - 1))]


def _once(x: np.ndarray, a: int, b: int, keys: list[int], back: bool) -> np.ndarray:
    left, right = x // _M(b), x % _M(b)
    for i, key in reversed(list(enumerate(keys))) if back else enumerate(keys):
        if i % 2 == 0:
            f = _mix(right, key) % _M(a)
            left = (left + (_M(a) - f if back else f)) % _M(a)
        else:
            f = _mix(left, key) % _M(b)
            right = (right + (_M(b) - f if back else f)) % _M(b)
    return left * _M(b) + right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number x < n under the permutation of 0..n-1 that seed names
    (back: its inverse). The Feistel network runs on a x b >= n cells with a*b - n < a;
    values that land outside 0..n-1 walk on along their cycle, which must come back."""
    x = np.asarray(x).astype(_M)
    if n <= 1:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    keys = round_keys(seed)
    with np.errstate(over="ignore"):
        out = _once(x, a, b, keys, back)
        while (far := out >= _M(n)).any():
            out[far] = _once(out[far], a, b, keys, back)
    return out


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, size, text_crc32, position, shard, slot for every row of docs.

    Rows are numbered in the order of (id, CRC, size); position is the row number's image under
    permute(), shard = position mod n_shards and slot = position div n_shards. So counts of shards differ
    by one at most, slots have no gaps, and anyone who knows a row's number, the row count and
    the seed can compute its place, or go back from a place to the row.

    Null text: size 1 (no bytes) and the CRC of no bytes, 0. Null ids sort first. Rows that are
    equal in id and text are interchangeable. An empty table gives an empty result. Other
    columns of docs are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out, n = numbered(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])

    @F.pandas_udf("long")
    def place(rn: pd.Series) -> pd.Series:
        return pd.Series(permute(rn.to_numpy(), n, seed).astype(np.int64))

    out = out.withColumn("position", place("rn"))
    return out.select("doc_id", "size", "text_crc32", "position", (F.col("position") % n_shards).cast("int").alias("shard"), F.floor(F.col("position") / n_shards).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 under the law `rows`."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
