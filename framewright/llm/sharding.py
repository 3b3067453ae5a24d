"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import crc32_text, numbered, ranked, table


def rendezvous_shard(key: F.Column, weights: list[float]) -> F.Column:
    """The shard whose score -weight / ln(u) is highest, u being a uniform hash of (key, shard).

    Only the key, the shard's number and its weight matter: a further shard takes rows into itself and moves none between
    the others, and a heavier shard only gains. Shards of weight 0 get nothing. A null key is a key like any other. Of equal
    scores the lowest shard wins.
    """
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights: at least one above 0, none below")
    if len({*weights}) == 1:  # equal weights keep the order of u itself
        scores = [F.xxhash64(key, F.lit(s)) for s in range(len(weights))]
    else:
        # The hash's upper 53 bits, moved into (0, 1).
        u = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + 0.5) * (2.0**-53) for s in range(len(weights))]
        scores = [F.lit(w) / -F.log(x) if w else F.lit(-1.0) for w, x in zip(weights, u, strict=True)]
    if len(scores) == 1:
        return F.lit(0)
    best = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for s in reversed(range(len(scores) - 1)):
        out = F.when(scores[s] == best, F.lit(s)).otherwise(out)
    return out.cast("int")


def shard(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """df with the column out (its own column of that name, if any, gives way). No shuffle; recomputing gives the same."""
    return df.withColumn(out, rendezvous_shard(F.col(key), weights))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The manifest: for each row its size, text CRC, shard, place in the shard, and shard with one more shard.

    Null text: no bytes, so size 1. Null doc_id: a key of its own. Repeated rows share a shard and get places of their own.
    Empty table: no rows. Other columns are not looked at. Places are counted per shard and partition, so no shard is gathered in one
    task; equal rows are told apart by place only.
    """
    weights = [1.0] * shards
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"),
    )
    out = ranked(numbered(rows, "shards", "row"), ["shard"], "row", "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
