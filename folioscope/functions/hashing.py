"""Content hashes, cache keys and a digest that never gathers its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nul() -> Column:
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


def joined_key(*parts: Column | str) -> Column:
    """sha256 of NUL-joined parts (H2); NULL as soon as a part is missing or blank."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    pieces: list[Column] = []
    blank = F.lit(False)
    for column in columns:
        pieces += [column, nul()]
        blank = blank | column.isNull() | (F.trim(column) == "")
    return F.when(~blank, F.sha2(F.concat(*pieces[:-1]), 256))


def content_hash(columns: Sequence[str | Column]) -> Column:
    """Stable hash of a row's content (H1, H5); NULL and absent differ from empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def short_id(prefix: str, seed: Column) -> Column:
    """``prefix`` plus the first 24 hex digits of the seed's sha256 (H4)."""
    return F.concat(F.lit(prefix), F.left(F.sha2(seed, 256), F.lit(24)))


def digest_columns(row_hash: Column) -> list[Column]:
    """Aggregates of a set digest: sums of the eight 32-bit words of each row hash, and a count.

    Sums combine on the map side, so no task ever holds the rows, and the order of the rows does
    not matter; a row's place in the ledger is part of its content.
    """
    words = [
        F.sum(F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
        .cast("string")
        .alias(f"_w{i}")
        for i in range(8)
    ]
    return [F.count(F.lit(1)).cast("string").alias("_n"), *words]


def set_digest(df: DataFrame, row_hash: Column, by: Sequence[str] = (), name: str = "digest"):
    """One digest per group of rows."""
    sums = df.groupBy(*by).agg(*digest_columns(row_hash))
    parts = [F.coalesce(F.col(f"_w{i}"), F.lit("0")) for i in range(8)]
    return sums.select(
        *by, F.sha2(F.concat_ws("|", F.col("_n"), *parts), 256).alias(name)
    )
