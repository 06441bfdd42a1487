"""Operator 5, substring dedup: seed and extend over winnowed anchors.

Seeds: every run of `window` words holds the smallest of its `gram`-word hashes, its anchor; equal runs have equal
anchors, so documents that share a run meet when anchors are joined. Extension: around a seed, in both directions,
all runs that stand on the anchor are compared by 128-bit hash with those of the documents that it joins; what
remains, merged, are the maximal repeats of at least `window` words. Pairs of documents are never made: a run only
needs to know the smallest document that holds it, which is an aggregate with partial sums, and so a passage in a
third of all documents costs one row for each document and run.

Texts that are whole copies of a smaller document's are found by digest and take no part as they are removed whole.
Document texts are shuffled once, against the ids of documents that have a seed; only these are stored.

Defined results: null and empty texts, and those of under `window` words, lose nothing. Rows that share a doc_id are
never each other's repeats; equal rows all appear. A null doc_id neither removes nor loses words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import documents, stage, table

WINDOW, GRAM = 50, 25
EMPTY = hashlib.sha256(b"").hexdigest()


def _anchors(c: tk.Chunk, window: int, gram: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, their hashes, the anchor of each run of words and whether the run lies in one document."""
    starts, ends, firsts = tk.words(c)
    hashes = tk.word_hashes(c, starts, ends)
    low = tk.sliding_min(tk.windows_hash(hashes, gram, tk.BASE_A), window - gram + 1) if len(hashes) >= window else np.zeros(0, dtype=tk.U)
    return (starts, ends, firsts), hashes, low, tk.inside(window, firsts, len(hashes))


def _summaries(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                (_, _, firsts), _, low, ok = _anchors(c, window, gram)
                n = c.hi - c.lo
                new = ok.copy()
                new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(c.lo, n),
                        pa.array(np.diff(firsts)),
                        pa.array([hashlib.sha256(b" ".join(c.text(i).split())).digest() for i in range(n)], type=pa.binary()),
                        tk.list_array(low[at].view(np.int64), np.searchsorted(at, firsts), pa.int64()),
                    ],
                    names=["doc_id", "n_words", "digest", "anchors"],
                )

    return run


def _runs(window: int, gram: int):
    """Hashes of the runs that stand on a seed, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch["seeds"]
            for c in tk.chunks(batch["text"]):
                (_, _, firsts), hashes, low, ok = _anchors(c, window, gram)
                docs, hi, lo = [], [], []
                for i in range(c.hi - c.lo):
                    a, b = firsts[i], firsts[i + 1] - window + 1
                    if b <= a:
                        continue
                    at = a + np.flatnonzero(np.isin(low[a:b].view(np.int64), seeds[c.lo + i].values.to_numpy(zero_copy_only=False)))
                    one, two = (tk.spans_hash(hashes[a : firsts[i + 1]], at - a, at - a + window, x) for x in (tk.BASE_A, tk.BASE_B))
                    one, first = np.unique(one, return_index=True)
                    hi.append(one)
                    lo.append(two[first])
                    docs.append(np.full(len(one), i))
                if docs:
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(np.concatenate(docs) + c.lo)), pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64))],
                        names=["doc_id", "hi", "lo"],
                    )

    return run


def covered(repeated: np.ndarray, window: int) -> np.ndarray:
    """Units covered by the repeated runs; repeated has one flag for each run's start."""
    marks = np.zeros(len(repeated) + window, dtype=np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return np.cumsum(marks)[:-1] > 0


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                starts, ends, firsts = tk.words(c)
                hashes = tk.word_hashes(c, starts, ends)
                digest, removed, texts, spans = [], [], [], []
                for i in range(c.hi - c.lo):
                    a, b = firsts[i], firsts[i + 1]
                    own = tk.windows_hash(hashes[a:b], window, tk.BASE_A).view(np.int64)
                    gone = covered(np.isin(own, batch["runs"][c.lo + i].values.to_numpy(zero_copy_only=False)), window) if len(own) else np.zeros(b - a, dtype=bool)
                    all_words = c.text(i).split()
                    digest.append(hashlib.sha256(b" ".join(all_words)).digest())
                    texts.append(b" ".join(w for w, g in zip(all_words, gone, strict=True) if not g).decode())
                    removed.append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                n = c.hi - c.lo
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(c.lo, n), pa.array(digest, type=pa.binary()), pa.array(removed, type=pa.int64()), pa.array(texts), pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "digest", "n_removed", "kept_text", "repeats"],
                )

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(summary, cut). summary: doc_id, n_words, digest (of the words joined by a space), copy (its words are those of a
    smaller document) for every row. cut: doc_id, digest, n_removed, kept_text and repeats (maximal spans of words) for
    documents other than copies that lose words."""
    docs = documents(docs)
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    rows = stage(docs.mapInArrow(_summaries(window, gram), f"{kinds}, n_words bigint, digest binary, anchors array<bigint>"), "op5-summary")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copy = rows.join(stage(first, "op5-copied"), "digest", "left").select("doc_id", "n_words", "digest", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy"), "anchors")
    posts = stage(copy.where("not copy and doc_id is not null and size(anchors) > 0").select("doc_id", F.explode("anchors").alias("anchor")), "op5-posts")
    # staged, so that a hot anchor's or run's rows can be split in the joins with them
    shared = stage(posts.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "op5-shared")
    seeds = posts.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds"))
    held = stage(docs.join(seeds, "doc_id"), "op5-held")
    runs = stage(held.mapInArrow(_runs(window, gram), f"{kinds}, hi bigint, lo bigint"), "op5-runs")
    least = stage(runs.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hi", "lo", "least"), "op5-least")
    hits = runs.join(least, ["hi", "lo"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("hi").alias("runs"))
    cut = held.select("doc_id", "text").join(hits, "doc_id").mapInArrow(_kept(window), f"{kinds}, digest binary, n_removed bigint, kept_text string, repeats array<struct<start:bigint,end:bigint>>")
    return copy.drop("anchors"), cut


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256. Null and empty texts have no words; of rows that share
    a doc_id none removes words of the other; a null doc_id neither loses words nor takes them from others."""
    summary, cut = find_repeats(table(spark, sf_dir, "documents"))
    cut = cut.select("doc_id", "digest", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept")).dropDuplicates(["doc_id", "digest"])
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    return summary.join(cut, ["doc_id", "digest"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM h) WHERE m < doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM o
"""
