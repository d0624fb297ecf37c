"""Bounded samples of labelled rows, the same for the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5


def shares(counts: dict, each: int, total: int) -> dict:
    """The part of each value's rows to take: ``each`` at most, fewer where ``total`` would not hold them, rare values whole."""
    left, many, cap = total, len(counts), each
    for n in sorted(counts.values()):
        cap = min(each, left // max(1, many))
        if n >= cap:
            break
        left, many = left - n, many - 1
    return {v: min(1.0, cap / n) for v, n in counts.items()}


def by_hash(rows: DataFrame, by: str, each: int, total: int) -> DataFrame:
    """About ``each`` rows of every value of ``by`` (all of a rare one), ``total`` at most, chosen by a hash of doc_id.

    One count per value comes to the driver, of the ``total`` most frequent values (more cannot have a row each); the choice is a filter by a
    threshold on the hash, so no value's rows meet in one task. Should chance take more than ``total``, rows of frequent values go.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(total).collect()}
    part = rows.sparkSession.createDataFrame(list(shares(counts, each, total).items()), StructType([rows.schema[by], StructField("_share", DoubleType())]))
    place = F.pmod(F.xxhash64(F.lit(19), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.join(F.broadcast(part), by).filter(place < F.col("_share"))  # at most ``total`` values
    return chosen.orderBy(F.col("_share") < 1, F.xxhash64(F.lit(23), F.col("doc_id")), "doc_id").limit(total).select(*rows.columns)
