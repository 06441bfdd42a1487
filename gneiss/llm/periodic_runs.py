"""Operator 11, periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q and at least max(least, exponent * q) words that no
neighbouring word extends. Such a run overlaps itself, moved by q, in at least k words, where k is the smallest value of
max(least, exponent * q) - q over all q: each of its words lies in a k-gram that the document holds twice. Words outside
repeated k-grams are masked; no run crosses them, so the stretches between them are searched apart.

Main-Lorentz halves a stretch until it is too short for a run. A run across the middle of a part has half of its length,
two periods at least, on one side of it: there the first period from the middle equals the next one. All parts of one
depth, over all stretches of a chunk of documents, are tested at once; what passes is extended both ways by longest common
extensions. These are exact: stretches are named by doubling (equal names, equal words), and a stop word of its own behind
each stretch ends every comparison.

Documents are independent: no shuffle, and the rows of a chunk bound the memory. Defined results: null and empty texts have
no words and no runs; repeated rows give equal rows; the doc_id is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import documents, table

LEAST, EXPONENT = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def overlap(least: int, exponent: int) -> int:
    """The least number of words that a run shares with itself, moved by its period."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def unmasked(ids: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document holds twice or more."""
    n = len(ids)
    if n < k:
        return np.zeros(n, dtype=bool)
    at = np.flatnonzero(tk.inside(k, firsts, n))
    doc = np.searchsorted(firsts, at, side="right").astype(tk.U)
    grams = tk.mix(tk.spans_hash(ids, at, at + k, tk.BASE_A) + doc * tk.U(tk.BASE_B))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + k, -1)
    return np.cumsum(marks)[:n] > 0


class Names:
    """Names of all stretches of 2**j words, for longest common extensions. Equal names mean equal words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels = [ids]
        while 2 << len(self.levels) <= 2 * max(1, longest):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= step:
                break
            pairs = last[:-step] * np.int64(int(last.max()) + 1) + last[step:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on."""
        got = np.zeros(len(a), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names, x, y = self.levels[j], a + got, b + got
            ok = (x < len(names)) & (y < len(names))
            ok[ok] = names[x[ok]] == names[y[ok]]
            got[ok] += 1 << j
        return got

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        got = np.zeros(len(a), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names, x, y = self.levels[j], a - got - (1 << j), b - got - (1 << j)
            ok = (x >= 0) & (y >= 0)
            ok[ok] = names[x[ok]] == names[y[ok]]
            got[ok] += 1 << j
        return got

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on equal those from b on, by two names that cover them; n is at most the longest."""
        out = np.zeros(len(a), dtype=bool)
        level = np.minimum(np.frexp(n.astype(np.float64))[1] - 1, len(self.levels) - 1)
        for j in np.unique(level):
            at, names, size = np.flatnonzero(level == j), self.levels[j], 1 << int(j)
            x, y, m = a[at], b[at], n[at]
            good = (x >= 0) & (y >= 0) & (np.maximum(x, y) + m - size < len(names))
            at, x, y, m = at[good], x[good], y[good], m[good]
            out[at] = (names[x] == names[y]) & (names[x + m - size] == names[y + m - size])
        return out


def extended(names: Names, m: np.ndarray, p: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch with period p around m, of which two periods stand on one side of m."""
    a = m if side > 0 else m - p
    return a - names.backward(a, a + p), a + p + names.forward(a, a + p)


def main_lorentz(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in ids[s:e] of each stretch, ordered by start and then period."""
    none = np.zeros(0, dtype=np.int64)
    size = ends - starts
    starts, ends, size = (x[size >= least] for x in (starts, ends, size))
    if not len(starts):
        return none, none, none
    # the stretches one after another, a stop word of its own behind each
    to = np.concatenate([[0], np.cumsum(size + 1)])
    _, dense = np.unique(np.concatenate([ids[s:e] for s, e in zip(starts, ends, strict=True)]), return_inverse=True)
    line = np.empty(to[-1], dtype=np.int64)
    stop = np.zeros(to[-1], dtype=bool)
    stop[to[1:] - 1] = True
    line[~stop] = dense
    line[stop] = dense.max() + 1 + np.arange(len(starts))
    names = Names(line, int(size.max()))
    lo, hi = to[:-1], to[:-1] + size
    found = [(none, none, none)]
    while len(lo):
        mid = (lo + hi) // 2
        for side in (1, -1):
            most = (hi - mid if side > 0 else mid - lo) // 2
            own = np.repeat(np.arange(len(mid)), most)
            p = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most) + 1
            m = mid[own]
            a, b = (m, m + p) if side > 0 else (m - 2 * p, m - p)
            passed = line[a] == line[b]
            m, p, a, b = m[passed], p[passed], a[passed], b[passed]
            passed = names.equal(a, b, p)
            m, p = m[passed], p[passed]
            if not len(m):
                continue
            # a multiple of a place's smallest period inside that period's stretch gives the same stretch again
            least_of = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            s0, e0 = extended(names, m[least_of], p[least_of], side)
            times = np.diff(np.concatenate([least_of, [len(m)]]))
            p0, s0, e0 = (np.repeat(x, times) for x in (p[least_of], s0, e0))
            new = (p == p0) | (p % p0 != 0) | ((m + 2 * p > e0) if side > 0 else (m - 2 * p < s0))
            m, p = m[new], p[new]
            s, e = extended(names, m, p, side)
            keep = e - s >= np.maximum(least, exponent * p)
            found.append((s[keep], e[keep], p[keep]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    s, e, p = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[first], e[first], p[first]
    back = starts[np.searchsorted(to, s, side="right") - 1] - to[np.searchsorted(to, s, side="right") - 1]
    s, e = s + back, e + back
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def runs_of(ids: np.ndarray, firsts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs over documents' words; firsts has each document's first word, and the end."""
    open_ = unmasked(ids, firsts, overlap(least, exponent))
    edge = np.zeros(len(ids) + 1, dtype=bool)
    edge[firsts] = True
    starts = np.flatnonzero(open_ & (edge[:-1] | ~np.concatenate([[False], open_[:-1]])))
    ends = np.flatnonzero(open_ & (edge[1:] | ~np.concatenate([open_[1:], [False]]))) + 1
    return main_lorentz(ids, starts, ends, least, exponent)


def _found(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                starts, ends, firsts = tk.words(c)
                s, e, p = runs_of(tk.word_hashes(c, starts, ends), firsts, least, exponent)
                gone = np.zeros(len(starts) + 1, dtype=np.int32)
                np.add.at(gone, s + p, 1)
                np.add.at(gone, e, -1)
                gone = np.cumsum(gone)[:-1] > 0
                place = np.searchsorted(s, firsts)
                lost = np.concatenate([[0], np.cumsum(gone)])[firsts]
                n, texts = c.hi - c.lo, []
                for i in range(n):
                    own = c.text(i).split()
                    if lost[i + 1] > lost[i]:
                        own = [own[k] for k in np.flatnonzero(~gone[firsts[i] : firsts[i + 1]])]
                    texts.append(b" ".join(own).decode())
                base = np.repeat(firsts[:-1], np.diff(place))
                spans = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - s), pa.array(p)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(c.lo, n), pa.array(np.diff(firsts)), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), spans), pa.array(texts, type=pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period in words, by start and then period) and collapsed,
    the words joined by a space without those that follow the first period of a run that holds them. Null and empty texts
    have no runs and an empty collapsed text; repeated rows are equal. exponent is 4 or more: each half of a run has to hold
    two periods."""
    if exponent < 4 or least < 2:
        raise ValueError("runs of fewer than four periods or two words aren't found by this search")
    docs = documents(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_found(least, exponent), f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a period in its words, for the ids whose crc32 is divisible by 10; null ids have none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start,
    then period; nulls without a run), runs_sha256 and collapsed_sha256. Null and empty texts have no words."""
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # the longest, then the first: runs are ordered by start and period
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda top, r: F.when(top.isNull() | (r["length"] > top["length"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
