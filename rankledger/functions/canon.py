"""Canonical JSON, hashes and deterministic ids."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import store


def sorted_fields(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct in alphabetical order."""
    if isinstance(kind, T.StructType):
        fields = [sorted_fields(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or isinstance(kind, T.ArrayType) and _nested(kind.elementType)


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON of the columns with sorted keys at every depth, nulls kept, no spaces."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[sorted_fields(F.col(n), kinds[n]).alias(n) for n in names]), {"ignoreNullFields": "false"})


def json_tuple_key(*columns: Column) -> Column:
    return F.to_json(F.array(*columns), {"ignoreNullFields": "false"})


def sha256_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


#: Rows of one chunk of ``chunked_hash``.
CHUNK_ROWS = 100_000


def table_hash(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: SHA-256 of a result as a canonical JSON array in the given order.

    For published, bounded results (a season's standings); tables of any size take ``chunked_hash`` or ``fingerprint``.
    """
    rows = df.select(F.struct(*[F.col(c) for c in order]).alias("_o"), canonical_json(df, columns).alias("_j"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda x: x["_j"])
    return rows.agg(F.sha2(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), 256).alias("content_hash"))


def chunked_hash(df: DataFrame, columns: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row: SHA-256 of the digests of a table's chunks of ``chunk_rows`` rows in the given total order, at any size.

    The order is sorted in ranges apart; a chunk's place follows from the counts of the ranges before it, so the digest
    does not depend on how the table is partitioned. Only one digest a chunk meets in one task.
    """
    rows = df.withColumn("_j", canonical_json(df, columns)).select(*order, "_j")
    placed = numbered(rows, order)
    chunk = F.call_function("div", F.col("_n") - 1, F.lit(chunk_rows).cast("bigint"))
    texts = placed.groupBy(chunk.alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_n", "_j"))).alias("_l"))
    digests = texts.select("_c", F.sha2(F.array_join(F.transform("_l", lambda x: x["_j"]), ","), 256).alias("_d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_d"))), lambda x: x["_d"]), "")
    return digests.agg(F.sha2(joined, 256).alias("content_hash"))


def numbered(df: DataFrame, order: list[str], out: str = "_n") -> DataFrame:
    """``df`` with the place of every row, from 1, in the total order of the columns (nulls first)."""
    return running_total(df, order, F.lit(1).cast("bigint"), out)


def running_total(df: DataFrame, order: list[str], amount: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to each, in the total order of the columns (nulls first; a null amount is none).

    Ranges of the order are sorted apart and summed behind each other's totals: one row a range reaches a window.
    """
    priced = df.withColumn("_amount", F.coalesce(amount.cast("bigint"), F.lit(0).cast("bigint")))
    held = store(priced.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranges").df
    totals = held.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # one row a partition
    own = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_amount", "_own", "_before")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint per key: count and two sums of row hashes; combines on the map side at any size."""
    h = F.xxhash64(canonical_json(df, columns))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def hmac_sha256(key: bytes):
    """Column function: hexadecimal HMAC-SHA256 of a text under ``key``."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run


def packet_text(timestamp: Column, body: Column) -> Column:
    """What a signed packet signs: time, digest and length of the body, one a line."""
    return F.concat_ws("\n", timestamp, F.sha2(body, 256), F.octet_length(body).cast("string"))


def packet_error(timestamp: Column, body: Column, signature: Column, now: Column, key: bytes, seconds: int = 300) -> Column:
    """EXPIRED if the packet's time (ISO text) is further than ``seconds`` from now, BAD_SIGNATURE if it isn't signed with ``key``, else null.

    Signatures are compared as digests of themselves, so the time a comparison takes tells nothing about them.
    """
    at = timestamp.try_cast("timestamp")
    fresh = F.coalesce(F.abs(F.unix_millis(at) - F.unix_millis(now)) <= seconds * 1000, F.lit(False))
    same = F.coalesce(F.sha2(hmac_sha256(key)(packet_text(timestamp, body)), 256) == F.sha2(signature, 256), F.lit(False))
    return F.when(~fresh, "EXPIRED").when(~same, "BAD_SIGNATURE")


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Hexadecimal inner and outer pad of HMAC-SHA256: sha256(outer || sha256(inner || text))."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()
