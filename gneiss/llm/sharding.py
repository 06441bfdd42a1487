"""Operator 9, sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING places. Each shard stands at `virtual` of them, and a document's place is the hash of its id and text. It goes to the
shard that stands next clockwise; where that shard is full it continues clockwise to the next that is not. A shard's
bound is its fair share, n // shards or one more, so counts are at most one apart (the law `rows`), and only what
overflows is moved away from its own shard.

The driver plans with RING counts, however many documents there are: each place is cut, by rank in the place, into
pieces that lie in one shard. Ranks come from a window over places, which are far more than the tasks.

Defined results: null texts have no bytes. Null and repeated doc_ids have places like any other; ties in a place are
ordered by doc_id, checksum and size, and rows equal in all three may swap slots.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

RING = 1 << 16
SHARDS, VIRTUAL, SEED = 24, 64, 42


def ring_owners(shards: int, virtual: int = VIRTUAL, seed: int = SEED) -> np.ndarray:
    """The shards met clockwise: owners[p] is the index into the virtual nodes sorted by place."""
    at = sorted((int.from_bytes(hashlib.blake2b(f"{seed}:{s}:{v}".encode(), digest_size=8).digest()) % RING, s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in at]), np.array([s for _, s in at])


def plan(counts: np.ndarray, shards: int, virtual: int = VIRTUAL, seed: int = SEED) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) so that every shard gets its fair share of sum(counts)."""
    places, owners = ring_owners(shards, virtual, seed)
    n = int(counts.sum())
    room = np.array([n // shards + (s < n % shards) for s in range(shards)])
    filled, pieces, over = np.zeros(shards, dtype=np.int64), [], []
    for p in np.flatnonzero(counts):
        node = int(np.searchsorted(places, p)) % len(places)
        s, c = owners[node], int(counts[p])
        take = min(c, int(room[s] - filled[s]))
        if take:
            pieces.append((int(p), 0, take, int(s), int(filled[s])))
            filled[s] += take
        if take < c:
            over.append((int(p), take, c, node))
    for p, rank, end, node in over:
        while rank < end:
            node = (node + 1) % len(places)
            s = owners[node]
            take = min(end - rank, int(room[s] - filled[s]))
            if take:
                pieces.append((p, rank, rank + take, int(s), int(filled[s])))
                filled[s] += take
                rank += take
    return pieces


def shard_rows(df: DataFrame, key: str, ties: list[str], shards: int = SHARDS, virtual: int = VIRTUAL, seed: int = SEED) -> DataFrame:
    """df with shard and slot (gapless in its shard), in place of columns of these names. df is read once: its rows are
    staged, so keep them narrow. A row's place is the hash of its key and ties: rows of one key, null among them, are
    spread by the others."""
    spark, own = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    at = F.xxhash64(F.lit(seed), key, *ties)
    df = stage(df.select(F.struct(*own).alias("row"), at.alias("at"), F.shiftrightunsigned(at, 48).cast("int").alias("place")), "op9-rows")
    counts = np.zeros(RING, dtype=np.int64)
    for place, n in df.groupBy("place").count().collect():  # RING rows at most
        counts[place] = n
    pieces = spark.createDataFrame(plan(counts, shards, virtual, seed), "of int, first long, until long, shard int, base long")
    order = Window.partitionBy("place").orderBy("at", *(F.col(f"row.`{c}`") for c in (key, *ties)))
    ranked = df.withColumn("rank", F.row_number().over(order) - 1)
    there = (F.col("place") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    found = ranked.join(F.broadcast(pieces), there)  # at most RING + virtual * shards**2 pieces
    return found.select("row.*", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null). Null texts have no bytes;
    null and repeated doc_ids are rows like any other. An empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard_rows(rows, "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
