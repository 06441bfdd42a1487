"""Operator 2, line dedup: winnowing over line hashes.

Units are the lines (split at \\n) that hold a word; other lines are never deleted and never break a run. Each run of
`run` lines has a guaranteed fingerprint, the smallest of its `gram`-line hashes. Fingerprints that two documents
share are joined; around them, in both directions, runs are compared by 128-bit hash, and each run that also stands
earlier, in a smaller doc_id or before it in the same text, is a repeat. Lines covered by repeats go: what is left of
each repeated passage is its first occurrence.

With `least`, runs shorter than `run` lines count by their content: one of `least` words or more that also stands earlier
is a repeat, and so is a whole text of fewer than `run` lines that is also an earlier document's whole text. The
pipeline asks for this; the query and its SQL know runs of `run` lines only.

Only hashes of lines are shuffled; texts meet the deletions once, at the end. Pairs of documents are never made.

Defined results: null and empty texts have no lines and lose none (a null text stays null). Rows that share a doc_id
are not earlier than each other. A null doc_id loses only what repeats within its own text, and removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import documents, stage, table
from .substring_dedup import covered

RUN, GRAM = 3, 2
#: Words from which runs of fewer lines count in the pipeline.
LEAST = 50
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def lines(c: tk.Chunk) -> tuple[np.ndarray, ...]:
    """Starts and ends of all lines, the first line of each document (and the end), and whether a line has a word."""
    n = len(c.offs) - 1
    breaks = np.flatnonzero(c.data == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(c.offs, breaks, side="right") - 1])
    starts, ends = np.concatenate([c.offs[:-1], breaks + 1]), np.concatenate([breaks, c.offs[1:]])
    of_end = np.concatenate([doc[n:], np.arange(n)])
    starts, ends = starts[np.lexsort((starts, doc))], ends[np.lexsort((ends, of_end))]
    text = np.concatenate([[0], np.cumsum(~tk.SPACE[c.data])])
    return starts, ends, np.searchsorted(np.sort(doc), np.arange(n + 1)), text[ends] > text[starts]


def _units(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts, full = lines(c)
    at = np.flatnonzero(full)
    return tk.spans_hash(tk._bytes_table(2)[c.data], starts[at], ends[at], tk.BASE_BYTES), np.searchsorted(at, firsts)


def _n_words(c: tk.Chunk) -> np.ndarray:
    """Words of each unit."""
    starts, ends, _, full = lines(c)
    begin = tk.words(c)[0]
    return np.searchsorted(begin, ends[full]) - np.searchsorted(begin, starts[full])


def _short(own: np.ndarray, n_words: np.ndarray, run: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of fewer than `run` lines that count: their length, places and both hashes."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    for k in range(1, min(run - 1, len(own)) + 1):
        at = np.flatnonzero(total[k:] - total[:-k] >= least)
        yield k, at, tk.spans_hash(own, at, at + k, tk.BASE_A), tk.spans_hash(own, at, at + k, tk.BASE_B)
        if k == len(own) and not len(at):
            at = np.zeros(1, dtype=np.int64)
            yield k, at, tk.spans_hash(own, at, at + k, tk.BASE_A) ^ _WHOLE, tk.spans_hash(own, at, at + k, tk.BASE_B) ^ _WHOLE


def _short_runs(run: int, least: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                hashes, units = _units(c)
                n_words = _n_words(c)
                docs, hi, lo = [], [], []
                for i in range(c.hi - c.lo):
                    for _, _, one, two in _short(hashes[units[i] : units[i + 1]], n_words[units[i] : units[i + 1]], run, least):
                        one, first = np.unique(one, return_index=True)
                        hi.append(one)
                        lo.append(two[first])
                        docs.append(np.full(len(one), c.lo + i))
                if docs:
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64))], names=["doc_id", "hi", "lo"])

    return go


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tk.chunks(batch["text"]):
            hashes, firsts = _units(c)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(c.lo, c.hi - c.lo), tk.list_array(hashes.view(np.int64), firsts, pa.int64())], names=["doc_id", "lines"])


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    offs, flat = batch["lines"].offsets.to_numpy(), batch["lines"].values.to_numpy(zero_copy_only=False).view(np.uint64)
    for i in range(len(batch)):
        yield i, flat[offs[i] : offs[i + 1]]


def _anchors(own: np.ndarray, run: int, gram: int) -> np.ndarray:
    return tk.sliding_min(tk.windows_hash(own, gram, tk.BASE_A), run - gram + 1) if len(own) >= run else np.zeros(0, dtype=tk.U)


def _fingerprints(run: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, np.unique(_anchors(own, run, gram))) for i, own in _each(batch)]
            at = np.repeat([i for i, _ in found], [len(x) for _, x in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, type=pa.int64())), pa.array(np.concatenate([x for _, x in found] or [np.zeros(0, tk.U)]).view(np.int64))], names=["doc_id", "anchor"])

    return go


def _runs(run: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hi, lo = [], [], []
            for i, own in _each(batch):
                at = np.flatnonzero(np.isin(_anchors(own, run, gram).view(np.int64), batch["seeds"][i].values.to_numpy(zero_copy_only=False)))
                one, first = np.unique(tk.spans_hash(own, at, at + run, tk.BASE_A), return_index=True)
                hi.append(one)
                lo.append(tk.spans_hash(own, at, at + run, tk.BASE_B)[first])
                docs.append(np.full(len(one), i))
            if docs:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64))], names=["doc_id", "hi", "lo"])

    return go


def _later(at: np.ndarray, known: pa.Array | None) -> np.ndarray:
    """Which runs stand before in the text, or are known to."""
    later = np.ones(len(at), dtype=bool)
    later[np.unique(at, return_index=True)[1]] = False
    if known is not None and len(known):
        later |= np.isin(at.view(np.int64), known.to_numpy(zero_copy_only=False))
    return later


def _delete(run: int, least: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                starts, ends, firsts, full = lines(c)
                hashes, units = _units(c)
                n_words = _n_words(c) if least else None
                texts, counts, removed = [], np.diff(units), []
                for i in range(c.hi - c.lo):
                    own, known = hashes[units[i] : units[i + 1]], batch["runs"][c.lo + i].values
                    gone = np.zeros(len(own), dtype=bool)
                    if len(own) >= run:
                        later = _later(tk.windows_hash(own, run, tk.BASE_A), known)
                        if later.any():
                            gone = covered(later, run)
                    if least:
                        for k, at, one, _ in _short(own, n_words[units[i] : units[i + 1]], run, least):
                            for j in range(k):
                                gone[at[_later(one, known)] + j] = True
                    removed.append(int(gone.sum()))
                    if not removed[-1]:
                        texts.append(batch["text"][c.lo + i].as_py())
                        continue
                    a, b = firsts[i], firsts[i + 1]
                    keep = np.ones(b - a, dtype=bool)
                    keep[np.flatnonzero(full[a:b])[gone]] = False
                    texts.append(b"\n".join(c.data[starts[k] : ends[k]].tobytes() for k in a + np.flatnonzero(keep)).decode())
                rest = [batch[k].slice(c.lo, c.hi - c.lo) for k in batch.schema.names if k not in ("text", "runs")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int64()), pa.array(removed, type=pa.int64())], names=[*(k for k in batch.schema.names if k not in ("text", "runs")), "text", "n_lines", "n_removed"])

    return go


def dedup_lines(docs: DataFrame, *carry: str, run: int = RUN, gram: int = GRAM, least: int | None = None) -> DataFrame:
    """doc_id, the carried columns, text without later repeats, n_lines (lines with a word) and n_removed."""
    docs = documents(docs, *carry)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = stage(docs.select("doc_id", "text").mapInArrow(_hash_lines, f"doc_id {kind}, lines array<bigint>"), "op2-lines").where("doc_id is not null")
    posts = stage(hashed.mapInArrow(_fingerprints(run, gram), f"doc_id {kind}, anchor bigint"), "op2-posts")
    # staged, so that a hot anchor's or run's rows can be split in the joins with them
    shared = stage(posts.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "op2-shared")
    seeds = posts.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds"))
    runs = stage(hashed.join(seeds, "doc_id").mapInArrow(_runs(run, gram), f"doc_id {kind}, hi bigint, lo bigint"), "op2-runs")
    if least:
        short = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_short_runs(run, least), f"doc_id {kind}, hi bigint, lo bigint")
        runs = runs.union(stage(short, "op2-short"))
    first = stage(runs.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hi", "lo", "least"), "op2-first")
    hits = runs.join(first, ["hi", "lo"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("hi").alias("runs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", text string, n_lines bigint, n_removed bigint"
    bare = docs.where("doc_id is null").withColumn("runs", F.array().cast("array<bigint>"))
    return docs.where("doc_id is not null").join(hits, "doc_id", "left").unionByName(bare).mapInArrow(_delete(run, least), schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; null texts count as empty)."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def keep_sql(documents: str) -> str:
    """DuckDB: o(doc_id, n_lines, n_removed, kept), kept being the text that is left."""
    return rf"""
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM {documents}),
u AS (SELECT doc_id, all_lines, list_filter(range(1, len(all_lines) + 1), lambda i: regexp_matches(all_lines[i], '[^\x20\x09-\x0D]')) AS f FROM l),
p AS (SELECT doc_id, all_lines, f, unnest(range(1, len(f) - 1)) AS i FROM u WHERE len(f) >= 3),
h AS (SELECT doc_id, f, i, all_lines[f[i]] || chr(10) || all_lines[f[i + 1]] || chr(10) || all_lines[f[i + 2]] AS k FROM p),
m AS (SELECT doc_id, f, i FROM (SELECT doc_id, f, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, list_distinct(flatten(list([f[i], f[i + 1], f[i + 2]]))) AS gone FROM m GROUP BY doc_id),
o AS (SELECT u.doc_id, len(u.f)::BIGINT AS n_lines, len(coalesce(g.gone, []))::BIGINT AS n_removed,
  array_to_string(list_transform(list_filter(range(1, len(all_lines) + 1), lambda i: NOT list_contains(coalesce(g.gone, []), i)), lambda i: all_lines[i]), chr(10)) AS kept
  FROM u LEFT JOIN g ON g.doc_id = u.doc_id)"""


ORACLE = f"WITH {keep_sql('documents')}\nSELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o"
