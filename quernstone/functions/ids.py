"""Identifiers: keyed hashes, scores, canonical JSON and dataset digests."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 in hex, composed of two digests; the key's pads are constants."""
    if len(secret) < 32:
        raise ValueError("the secret must have at least 32 bytes")
    block = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    outer, inner = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x5C, 0x36))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def author_hash(source: Column | str, author: Column, secret: bytes) -> Column:
    """A stable identifier of an author within a source, which keeps nothing of the author's own."""
    source = F.lit(source) if isinstance(source, str) else source
    return hmac_sha256(F.concat(source, F.lit("\0"), author), secret)


def score(seed: int, purpose: str | Column, source: Column, document: Column) -> Column:
    """Digest that orders a seeded draw: lower-case hex sorts as its bytes do."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), purpose, source, document), 256)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, Unicode as it is, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.arrow_udf(StringType())
def canonical_json_text(x: pa.Array) -> pa.Array:
    """Canonical form of JSON documents."""
    return pa.array([None if v is None else canonical_json(json.loads(v)) for v in x.to_pylist()], pa.string())


def dataset_sha256(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One digest of a bounded dataset, whatever its order: of its canonical lines sorted by id.

    Meant for released datasets of a few hundred rows; use ``dataset_checksum`` for any size.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(json_col).alias("json")))), lambda r: r["json"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("dataset_sha256"))


def dataset_checksum(rows: DataFrame, json_col: str) -> DataFrame:
    """An order-free checksum that partial aggregation sums: row digests' first 15 hex digits."""
    part = F.conv(F.substring(F.sha2(F.col(json_col), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).alias("checksum"))
