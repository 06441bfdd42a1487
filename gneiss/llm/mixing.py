"""Operator 4, mixing sources to target weights by Sainte-Lague apportionment.

Sources are cut into equal-token blocks of `block` words: a source's documents lie in seeded order in shards of about
SHARD words, and each shard is one stream of words. The mix has so many blocks; a source gets them one by one, always
the source of the highest quotient target / (2 * got + 1). The same rule deals a source's blocks to its shards by their
sizes. In a shard, the quota is whole passes over the stream and then blocks chosen by seed; the last of these is cut
so that the quota is met to the word. A word is taken twice at most.

The driver holds one row a source. Shards are bounded, so a source with most of the rows is many groups.

Defined results: null and empty texts have size 0 and are taken 0 times. A null source is a source, ordered last.
Repeated rows are rows of their own. An empty table gives an empty mix. Reruns agree: order and choice are hashes of
the seed, doc_id, size, the text's hash, source and block number; rows equal in these may swap what they give.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stage, table

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
BLOCK, SHARD, SEED = 64, 500_000, 7
#: Shards of a group: a source of 15 T words has 30,000 groups.
LEVEL = 1000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> dict:
    """Target words of each source: shares by weight that stop at limit times the size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), share * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > limit * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in free}
        for s in full:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 * got + 1); ties go to the first. Starts from rounded shares, so its steps
    are as many as there are parties, not seats."""
    total = sum(votes)
    if not total or not seats:
        return [0] * len(votes)
    got = [int(v * seats / total + 0.5) for v in votes]
    more = sum(got) < seats
    heap = [(-v / (2 * g + 1), i) if more else (v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v and (more or g)]
    heapq.heapify(heap)
    for _ in range(abs(seats - sum(got))):
        i = abs(heapq.heappop(heap)[1])
        got[i] += 1 if more else -1
        if more or got[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i) if more else (votes[i] / (2 * got[i] - 1), -i))
    return got


def _dealt(name: str, by: list[str]):
    """Deals a group's `seats` to its rows by `words`; by: what orders and names the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        return pdf[by].assign(**{name: np.array(sainte_lague(pdf["words"].tolist(), int(pdf["seats"].iloc[0])), dtype=np.int64)})

    return run


def shard_quotas(totals: DataFrame, block: int, level: int = LEVEL) -> DataFrame:
    """at, shard, quota. totals: at, shard, words, seats (the source's blocks). A source's blocks go to its groups of
    `level` shards, and each group's to its shards, so no task holds more than some thousands of rows."""
    totals = totals.withColumn("group", F.expr(f"shard div {level}").cast("int"))
    groups = totals.groupBy("at", "group").agg(F.sum("words").alias("words"), F.first("seats").alias("seats"))
    given = groups.groupBy("at").applyInPandas(_dealt("seats", ["at", "group"]), "at int, group int, seats long")
    each = totals.drop("seats").join(given, ["at", "group"]).groupBy("at", "group").applyInPandas(_dealt("given", ["at", "shard"]), "at int, shard int, given long")
    return each.select("at", "shard", (F.col("given") * block).alias("quota"))


def _take(block: int, seed: int, key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", key, "size", "mark"], kind="stable")
        ends = pdf["size"].to_numpy().cumsum()
        starts, total, quota = ends - pdf["size"].to_numpy(), int(ends[-1]), int(pdf["quota"].iloc[0])
        passes = min(LIMIT, quota // total) if total else LIMIT
        rest = quota - passes * total if passes < LIMIT else 0
        numbers = np.arange(-(-total // block), dtype=np.uint64)
        dice = tk.mix(numbers + tk.mix(np.array([seed + 1000 * int(pdf["at"].iloc[0]) + 1_000_003 * int(pdf["shard"].iloc[0])], dtype=np.uint64)))
        chosen = np.argsort(dice, kind="stable")
        sizes = np.minimum(block, total - numbers.astype(np.int64) * block)
        used = np.cumsum(sizes[chosen])
        part = np.zeros(len(numbers), dtype=np.int64)  # words taken from the front of each block in the last pass
        part[chosen] = np.clip(rest - (used - sizes[chosen]), 0, sizes[chosen])
        before = np.concatenate([[0], np.cumsum(part)])

        def upto(x: np.ndarray) -> np.ndarray:
            k = np.minimum(x // block, max(0, len(part) - 1))
            return before[k] + (np.minimum(x - k * block, part[k]) if len(part) else 0)

        spans = []
        for a, b in zip(starts, ends, strict=True):
            own = []
            for k in range(a // block, -(-b // block)) if b > a else ():
                s, e = max(a, k * block) - a, min(b, k * block + part[k]) - a
                if e > s:
                    if own and own[-1][1] == s:
                        own[-1][1] = int(e)
                    else:
                        own.append([int(s), int(e)])
            spans.append(own)
        return pdf[[key, "mark", "at", "size"]].assign(passes=passes, taken=passes * pdf["size"].to_numpy() + upto(ends) - upto(starts), spans=spans)

    return run


def mark(text: str = "text") -> Column:
    """What tells apart the rows that share a key: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, key: str = "doc_id", block: int = BLOCK, shard_words: int = SHARD, seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, mark (a hash of the text), size, source, source_size, target, taken, passes (whole readings of the document)
    and spans (of words, read once more)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    sized = stage(docs.select(key, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark().alias("mark")), "op4-sizes")
    sizes = {s: int(n) for s, n in sized.groupBy("source").agg(F.sum("size")).collect()}  # one row a source
    want = targets(sizes, weights, share)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = sainte_lague([want[s] for s in names], round(sum(want.values()) / block))
    sources = spark.createDataFrame(
        [(i, s, sizes[s], want[s], b, -(-sizes[s] // shard_words) or 1) for i, (s, b) in enumerate(zip(names, blocks, strict=True))],
        "at int, name string, source_size long, target double, blocks long, shards int",
    )
    own = (key, "size", "mark")  # rows that share a key, null among them, are dealt by their texts
    placed = sized.join(sources, sized.source.eqNullSafe(sources.name)).withColumn("order", F.xxhash64(F.lit(seed), *own)).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), *own), F.col("shards").cast("long")).cast("int"))
    totals = placed.groupBy("at", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("seats"))
    quotas = shard_quotas(totals, block)
    taken = placed.select(*own, "at", "shard", "order").join(quotas, ["at", "shard"]).groupBy("at", "shard").applyInPandas(_take(block, seed, key), f"{key} {kind}, mark long, at int, size long, passes int, taken long, spans array<array<bigint>>")
    return taken.join(sources.select("at", F.col("name").alias("source"), "source_size", "target"), "at").drop("at")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken. Null and empty texts have size 0 and are taken 0
    times; a null source is one of its own; repeated rows are rows of their own. An empty table gives no rows."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
