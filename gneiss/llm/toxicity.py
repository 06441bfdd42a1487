"""Operator 1, toxicity: a bidirectional gated recurrent network with attention pooling over characters and words.

Tokens are runs of letters in lower case, in pieces of at most CHARS letters. A token's input is the attention-pooled
state of a bidirectional GRU over its characters beside an embedding of its hash. A second bidirectional GRU with
attention reads windows of WINDOW tokens that overlap by half and cover the whole text; a document's score is that of
its most toxic window. Everything is numpy, forward and backward.

Training sees a bounded sample: at most SAMPLE labelled documents of label 1 and twice as many of label 0, of texts up
to SAMPLE_CHARS, chosen by hash (parameters of `fit`); the model's size is fixed, so what is sent to the executors doesn't grow. Scoring reads
each text once. Distinct tokens of a chunk are read by the character network once; a worker keeps a bounded number.

Defined results: null, empty and letterless texts get the score of an empty window. With no labels of one kind, every
score is the share of label 1 (0.5 without labels). Labels of a doc_id that differ count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import documents, stage, table

CHARS, WINDOW, STRIDE = 16, 32, 16
HIDDEN, CHAR_HIDDEN, CHAR_IN, WORD_IN, BUCKETS, ALPHABET = 8, 8, 8, 8, 1 << 13, 64
SAMPLE, SAMPLE_CHARS, SEED = 1000, 20_000, 5
EPOCHS, BATCH, RATE, HEADS = 7, 512, 0.01, (5, 6, 7)
KEPT = 300_000
f32 = np.float32

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_LETTER = np.zeros(128, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Tokens:
    """Tokens of a chunk: hashes, letters and the first token of each document (and the end)."""

    def __init__(self, c: tk.Chunk):
        text = c.data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
        offs = lead[c.offs]
        small = points < 256
        points = np.where(small, _FOLD[np.minimum(points, 255)], points)
        gap = ~np.where(points < 128, _LETTER[np.minimum(points, 127)], True)
        start, end = ~gap, ~gap
        start[1:] &= gap[:-1]
        end[:-1] &= gap[1:]
        full = offs[1:] > offs[:-1]
        a, b = offs[:-1][full], offs[1:][full] - 1
        start[a], end[b] = ~gap[a], ~gap[b]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        parts = -(-(ends - starts) // CHARS)
        which = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.starts = starts[which] + nth * CHARS
        self.ends = np.minimum(self.starts + CHARS, ends[which])
        self.firsts = np.searchsorted(self.starts, offs)
        self.hashes = tk.spans_hash(tk.mix(points.astype(tk.U)), self.starts, self.ends, tk.BASE_BYTES)
        self.points = points

    def letters(self, which: np.ndarray) -> np.ndarray:
        """Character ids of tokens, 0 after their end."""
        at = self.starts[which][:, None] + np.arange(CHARS)
        inside = at < self.ends[which][:, None]
        points = self.points[np.minimum(at, max(0, len(self.points) - 1))]
        ids = np.where((points >= 97) & (points < 123), points - 96, 27 + points % (ALPHABET - 27))
        return np.where(inside, ids, 0).astype(np.int8)


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n tokens: all overlapping ones, the last of which reaches the end."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of a GRU over input gates x (T, B, 3H); where mask is 0 the state stays. keep: for gru_back."""
    steps, size, h3 = x.shape
    h = h3 // 3
    state, out, saved = np.zeros((size, h), dtype=f32), np.empty((steps, size, h), dtype=f32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        m = mask[t][:, None]
        g = state @ u
        rz = sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
        new = state + m * ((1 - z) * (n - state))
        if keep:
            saved.append((t, state, r, z, n, g[:, 2 * h :]))
        state = out[t] = new
    return out, saved


def gru_back(d: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from that of the states."""
    h = d.shape[2]
    dx, du, carry = np.empty((d.shape[0], d.shape[1], 3 * h), dtype=f32), np.zeros_like(u), np.zeros(d.shape[1:], dtype=f32)
    for t, state, r, z, n, gn in reversed(saved):
        m = mask[t][:, None]
        dnew = d[t] + carry
        dm = m * dnew
        dn = dm * (1 - z) * (1 - n * n)
        dz = dm * (state - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dg = np.concatenate([dr, dz, dn * r], axis=1)
        dx[t] = np.concatenate([dr, dz, dn], axis=1)
        du += state.T @ dg
        carry = dnew * (1 - m) + dm * z + dg @ u.T
    return dx, du


def pool(states: np.ndarray, mask: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention pooling over time: (B, 2H), and the weights (T, B); nothing to attend to pools to zeros."""
    score = np.where(mask > 0, states @ v, f32(-1e9))
    w = np.exp(score - score.max(0)) * mask
    w /= np.maximum(w.sum(0), f32(1e-9))
    return np.einsum("tb,tbh->bh", w, states), w


def pool_back(d: np.ndarray, states: np.ndarray, w: np.ndarray, v: np.ndarray, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ds = w * (np.einsum("bh,tbh->tb", d, states) - np.einsum("bh,bh->b", d, pooled))
    return w[:, :, None] * d[None] + ds[:, :, None] * v, np.einsum("tb,tbh->h", ds, states)


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = 2 * CHAR_HIDDEN + WORD_IN
    shapes = {
        "chars": (ALPHABET, CHAR_IN), "words": (BUCKETS, WORD_IN), "cx": (CHAR_IN, 6 * CHAR_HIDDEN), "cb": (6 * CHAR_HIDDEN,), "cu0": (CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cu1": (CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cv": (2 * CHAR_HIDDEN,),
        "wx": (wide, 6 * HIDDEN), "wb": (6 * HIDDEN,), "wu0": (HIDDEN, 3 * HIDDEN), "wu1": (HIDDEN, 3 * HIDDEN), "wv": (2 * HIDDEN,), "o": (2 * HIDDEN,), "ob": (1,),
    }
    p = {k: (rng.standard_normal(s) * (0.5 if k == "chars" else 0.1 if k == "words" else 1.5 / np.sqrt(s[0]))).astype(f32) for k, s in shapes.items()}
    for k in ("cb", "wb", "ob"):
        p[k][:] = 0
    return p


def read_words(p: dict, letters: np.ndarray, buckets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Vectors of distinct tokens."""
    steps = max(1, int((letters > 0).sum(1).max())) if len(letters) else 1
    ids = letters[:, :steps].T.astype(np.int64)
    mask = (ids > 0).astype(f32)
    gates = (p["chars"] @ p["cx"] + p["cb"])[ids]
    h = 3 * CHAR_HIDDEN
    one, s1 = gru(gates[:, :, :h], mask, p["cu0"], False, keep)
    two, s2 = gru(gates[:, :, h:], mask, p["cu1"], True, keep)
    states = np.concatenate([one, two], axis=2)
    pooled, w = pool(states, mask, p["cv"])
    return np.concatenate([pooled, p["words"][buckets]], axis=1), (ids, mask, states, pooled, w, s1, s2, buckets)


def read_words_back(p: dict, g: dict, d: np.ndarray, saved: tuple) -> None:
    ids, mask, states, pooled, w, s1, s2, buckets = saved
    c = 2 * CHAR_HIDDEN
    np.add.at(g["words"], buckets, d[:, c:])
    ds, g["cv"] = pool_back(d[:, :c], states, w, p["cv"], pooled)
    d1, g["cu0"] = gru_back(ds[:, :, :CHAR_HIDDEN], mask, p["cu0"], s1)
    d2, g["cu1"] = gru_back(ds[:, :, CHAR_HIDDEN:], mask, p["cu1"], s2)
    dx = np.concatenate([d1, d2], axis=2)
    by = np.zeros((ALPHABET, dx.shape[2]), dtype=f32)
    flat, rows = ids.ravel(), dx.reshape(-1, dx.shape[2])
    for k in range(rows.shape[1]):
        by[:, k] = np.bincount(flat, rows[:, k], ALPHABET)
    g["chars"], g["cx"], g["cb"] = by @ p["cx"].T, p["chars"].T @ by, by.sum(0)


def read_windows(p: dict, gates: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows. gates: input gates by token, the last row for none; at (B, T): tokens of each window."""
    tokens = at.T
    mask = (tokens < len(gates) - 1).astype(f32)
    x, h = gates[tokens], 3 * HIDDEN
    one, s1 = gru(x[:, :, :h], mask, p["wu0"], False, keep)
    two, s2 = gru(x[:, :, h:], mask, p["wu1"], True, keep)
    states = np.concatenate([one, two], axis=2)
    pooled, w = pool(states, mask, p["wv"])
    return pooled @ p["o"] + p["ob"][0], (tokens, mask, states, pooled, w, s1, s2)


def gates_of(p: dict, vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors @ p["wx"] + p["wb"], np.zeros((1, 6 * HIDDEN), dtype=f32)])


def step(p: dict, letters: np.ndarray, buckets: np.ndarray, at: np.ndarray, weight: np.ndarray, label: np.ndarray) -> dict:
    """Gradients of the weighted cross entropy of windows at (B, T) over distinct tokens."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    vectors, read = read_words(p, letters, buckets, True)
    logits, (tokens, mask, states, pooled, w, s1, s2) = read_windows(p, gates_of(p, vectors), at, True)
    d = ((sigmoid(logits) - label) * weight / weight.sum()).astype(f32)
    g["o"], g["ob"] = pooled.T @ d, d.sum(keepdims=True)
    ds, g["wv"] = pool_back(d[:, None] * p["o"], states, w, p["wv"], pooled)
    d1, g["wu0"] = gru_back(ds[:, :, :HIDDEN], mask, p["wu0"], s1)
    d2, g["wu1"] = gru_back(ds[:, :, HIDDEN:], mask, p["wu1"], s2)
    dx = np.concatenate([d1, d2], axis=2).reshape(-1, 6 * HIDDEN)
    flat = tokens.ravel()
    dv = np.empty((len(vectors) + 1, 6 * HIDDEN), dtype=f32)
    for k in range(dx.shape[1]):
        dv[:, k] = np.bincount(flat, dx[:, k], len(vectors) + 1)
    dv = dv[:-1]
    g["wx"], g["wb"] = vectors.T @ dv, dv.sum(0)
    read_words_back(p, g, dv @ p["wx"].T, read)
    return g


def odds(keys: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each key (of a token of doc), how much likelier it is in documents of label 1: log-odds, 0 if in under 3."""
    if not len(keys):
        return np.zeros(0, dtype=f32)
    _, index = np.unique(keys, return_inverse=True)
    seen = np.unique(np.stack([index, doc]), axis=1)
    n = index.max() + 1
    one, two = (np.bincount(seen[0], y[seen[1]] == v, n) for v in (1, 0))
    out = np.log((one + 0.5) / ((y == 1).sum() + 1)) - np.log((two + 0.5) / ((y == 0).sum() + 1))
    return np.where(one + two >= 3, out, 0)[index].astype(f32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fits on documents. Which windows of a toxic document are toxic is learned on the way: those with the most telling
    token or start of a token at first, then those that the network itself scores highest."""
    p, rng = fresh(seed), np.random.default_rng(seed)
    own = Tokens(next(tk.chunks(pa.array(texts), 1 << 60)))
    _, first, index = np.unique(own.hashes, return_index=True, return_inverse=True)
    letters, buckets = own.letters(first), (own.hashes[first] % tk.U(BUCKETS)).astype(np.int64)
    index = np.concatenate([index, np.full(WINDOW, len(first))])
    places, docs = [], []
    for i, (a, b) in enumerate(zip(own.firsts[:-1], own.firsts[1:], strict=True)):
        s = windows(b - a)
        cells = a + s[:, None] + np.arange(WINDOW)
        places.append(np.where(cells < b, index[np.minimum(cells, len(index) - 1)], len(first)))
        docs.append(np.full(len(s), i))
    at, doc = np.concatenate(places), np.concatenate(docs)
    y = np.array(labels, dtype=f32)
    of = np.repeat(np.arange(len(texts)), np.diff(own.firsts))
    told = odds(own.hashes, of, y)
    p["words"][buckets, 0] = np.clip(told[first], -3, 3) / 2
    for k in HEADS:
        told = np.maximum(told, odds(tk.spans_hash(tk.mix(own.points.astype(tk.U)), own.starts, np.minimum(own.starts + k, own.ends), tk.BASE_BYTES), of, y))
    best = np.full(len(first) + 1, -9, dtype=f32)
    np.maximum.at(best, index[:-WINDOW], told)
    even = np.array([(2 - v) / max(1, (y == v).sum()) for v in (0, 1)], dtype=f32)  # false alarms weigh double
    moment, spread = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    turn = 0
    for epoch in range(epochs):
        if epoch < 2:
            rank = np.sort(best[at], axis=1)[:, -3:] @ np.array([0.3, 0.5, 1], dtype=f32) + 0.01 * rng.random(len(at))
        else:
            vectors = np.concatenate([read_words(p, letters[i : i + 16_000], buckets[i : i + 16_000])[0] for i in range(0, len(first), 16_000)])
            gates = gates_of(p, vectors)
            rank = np.concatenate([read_windows(p, gates, at[i : i + 8192])[0] for i in range(0, len(at), 8192)])
        order = np.lexsort((-rank, doc))
        nth = np.arange(len(order)) - np.repeat(np.flatnonzero(np.diff(doc[order], prepend=-1)), np.bincount(doc, minlength=len(texts))[np.unique(doc)])
        use = order[nth < 2]
        others = rng.permutation(np.flatnonzero(y[doc] == 0))[: int((y == 0).sum())]
        use = rng.permutation(np.union1d(use, others))
        size = max(48, min(BATCH, len(use) // 12))  # a small sample needs as many steps
        for i in range(0, len(use), size):
            some = use[i : i + size]
            tokens, back = np.unique(at[some], return_inverse=True)
            back = back.reshape(len(some), WINDOW)
            none = len(tokens) - (tokens[-1] == len(first))
            g = step(p, letters[tokens[:none]], buckets[tokens[:none]], np.minimum(back, none), even[y[doc[some]].astype(int)], y[doc[some]])
            turn += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                moment[k] = 0.9 * moment[k] + 0.1 * x
                spread[k] = 0.99 * spread[k] + 0.01 * x * x
                p[k] -= (RATE * (1 - 0.8 * epoch / epochs) * (moment[k] / (1 - 0.9**turn)) / (np.sqrt(spread[k] / (1 - 0.99**turn)) + 1e-6)).astype(f32)
    return p


class Scorer:
    """A model with the vectors of tokens that it has read."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((0, 2 * CHAR_HIDDEN + WORD_IN), dtype=f32)

    def _vectors(self, own: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the chunk's distinct tokens, and which one each token is."""
        hashes, first, index = np.unique(own.hashes, return_index=True, return_inverse=True)
        if len(self.rows) > KEPT:
            self.rows.clear()
            self.vectors = self.vectors[:0]
        at = np.array([self.rows.get(h, -1) for h in hashes.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            lengths = np.argsort(own.ends[first[new]] - own.starts[first[new]], kind="stable")  # like lengths together: fewer steps
            new = new[lengths]
            made = [read_words(self.p, own.letters(first[x]), (hashes[x] % tk.U(BUCKETS)).astype(np.int64))[0] for x in np.array_split(new, -(-len(new) // 8192))]
            at[new] = len(self.vectors) + np.arange(len(new))
            self.rows.update(zip(hashes[new].tolist(), at[new].tolist(), strict=True))
            self.vectors = np.concatenate([self.vectors, *made])
        return self.vectors[at], index

    def score(self, c: tk.Chunk) -> list[float]:
        own = Tokens(c)
        vectors, index = self._vectors(own)
        gates = gates_of(self.p, vectors)
        none = len(vectors)
        lengths = np.diff(own.firsts)
        counts = np.maximum(1, -(-(lengths - STRIDE) // STRIDE))
        doc = np.repeat(np.arange(len(lengths)), counts)
        start = own.firsts[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
        top = np.full(len(lengths), -np.inf, dtype=f32)
        index = np.concatenate([index, np.full(WINDOW, none)])
        for i in range(0, len(doc), 4096):
            cells = start[i : i + 4096, None] + np.arange(WINDOW)
            at = np.where(cells < own.firsts[1:][doc[i : i + 4096]][:, None], index[np.minimum(cells, len(index) - 1)], none)
            np.maximum.at(top, doc[i : i + 4096], read_windows(self.p, gates, at)[0])
        return sigmoid(top).astype(float).tolist()


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, *carry: str) -> DataFrame:
    """doc_id, the carried columns and score. model: parameters, or one score for all."""
    docs = documents(docs, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model) if isinstance(model, dict) else None
        for batch in batches:
            names = [k for k in batch.schema.names if k != "text"]
            for c in tk.chunks(batch["text"]):
                found = own.score(c) if own else [model] * (c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([*(batch[k].slice(c.lo, c.hi - c.lo) for k in names), pa.array(found, type=pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "score double"]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, seed: int = SEED) -> dict[str, np.ndarray] | float:
    """The model from docs(doc_id, text) and labels(doc_id, toxic): at most `sample` documents of label 1, twice that of 0.

    They are drawn from the labelled documents that have a letter and at most sample_chars characters; of rows that share
    a doc_id, the least text counts. Without documents of both labels, one score for all: that of the label there is, or
    0.5."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    fitting = documents(docs).where((F.length("text") <= sample_chars) & F.col("text").rlike("[a-zA-Z\\x{80}-\\x{10FFFF}]"))
    known = stage(labels.join(fitting.select("doc_id").distinct(), "doc_id", "left_semi"), "op1-labels")
    order = F.xxhash64(F.lit(seed), "doc_id")
    drawn = [known.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(sample * (2 - v)) for v in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # 3 * sample rows at most
    texts = fitting.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.collect())  # of sample_chars at most
    rows = [r for r in rows if len(Tokens(next(tk.chunks(pa.array([r[1]])))).starts)]
    if len({y for _, _, y in rows}) < 2:
        return float(rows[0][2]) if rows else 0.5
    return train([t for _, t, _ in rows], [y for _, _, y in rows], seed=seed)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Labels of rows that are not held out alone are learned;
    null and empty texts have the score of a window without tokens; repeated rows are scored each. An empty documents
    table gives no rows, an empty labels table the score 0.5 for all."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
