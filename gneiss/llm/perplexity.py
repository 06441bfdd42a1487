"""A modified Kneser-Ney model of code points for each language: counted by Spark, stored in sorted hash arrays.

Every run of ORDER code points of every text is counted and stored; texts start after pads. Counts of all runs, and of the
distinct left extensions of all shorter ones, give each order's discounts and each context's total. A language's arrays are
made in one group, whose size is the number of its distinct runs of up to ORDER code points. That number grows far slower
than the texts (README), but nothing bounds it. Code points that no text has are one symbol, OTHER, which the lowest order,
a uniform one, holds too; in a context it is unseen. An n-gram holds a symbol in BITS bits. A model of more symbols than
that keeps them all: it is a wide one, with POINT bits for a symbol, whose n-grams are the places of their halves among its
pairs.

A model of all runs finds junk likely in its highest order, as junk of the same make predicts itself. Its order of single
code points doesn't: there a code point counts by how many others it follows, not by how often, and signs that stand in
few places stay unlikely. So texts are scored by both orders.

An n-gram that a seen context doesn't have gets the context's back-off weight times the probability of the lower order;
a context that was never seen passes on to the lower order as it is. So the probabilities of all symbols after a context
sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stage

ORDER = 4
#: The least share of a language's texts that hold a run which the model stores: at 0 all runs are stored. What a greater
#: one leaves out goes to the back-off weight of its context.
SHARE = 0.0
#: Bits of a symbol in a packed n-gram, of a code point in a counted one.
BITS, POINT = 16, 21
#: Numbers of the models that are broadcast at once.
BLOCK = 4_000_000
_ODD = tk.U(0x9E3779B97F4A7C15)
_LISTS = tuple(f"{x}{k}" for k in range(1, ORDER + 1) for x in ("hashes", "logs", "contexts", "backs"))
#: symbols: those that BITS bits hold, by left extensions; rare and pairs: the others, and pairs of numbers, of a wide model.
SCHEMA = "model bigint, symbols array<int>, rare array<int>, pairs array<bigint>, " + ", ".join(f"{x} array<{'double' if x[0] in 'lb' else 'bigint'}>" for x in _LISTS)


def points(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's code points, and the number of the first one of each document (and the end)."""
    firsts = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])[c.offs]
    if not len(c.data) or int(c.data.max()) < 128:
        return c.data.astype(np.uint32), firsts
    found = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return (found if len(found) == firsts[-1] else np.resize(found, firsts[-1])), firsts


def packed(own: np.ndarray, counts: np.ndarray, bits: int, first: int = 0, last: int = ORDER) -> np.ndarray:
    """The last ORDER symbols at each place in one number, zeros before a text's start; of those, the ones from `first` to
    `last` places back. counts: symbols of each text."""
    place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(own), dtype=tk.U)
    for back in range(first, last):
        before = np.zeros(len(own), dtype=tk.U)
        before[back:] = own[: len(own) - back]
        before[place < back] = 0
        out |= before << tk.U(bits * (back - first))
    return out


def shortened(high: np.ndarray, low: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k symbols of n-grams in halves of two symbols."""
    one = tk.U((1 << bits) - 1)
    return (high if k == ORDER else high & one if k == 3 else high & tk.U(0)), (low & one if k == 1 else low)


def contexts_of(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams without their last symbol."""
    return high >> tk.U(bits), (high & tk.U((1 << bits) - 1)) << tk.U(bits) | low >> tk.U(bits)


def coded(high: np.ndarray, low: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One number for both halves: side by side, or in a wide model their places among its pairs. A half that isn't there
    makes a number that no n-gram has."""
    if not len(pairs):
        return high << tk.U(2 * BITS) | low
    (a, first), (b, second) = find(pairs, high), find(pairs, low)
    return np.where(first & second, a.astype(tk.U) << tk.U(32) | b.astype(tk.U), ~tk.U(0))


def count_texts(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ORDER code points (plus 1; 0 before the start) of some texts, how often each occurs, and in how
    many texts."""
    alphabet, own = np.unique(own, return_inverse=True)
    bits, text_bits = len(alphabet).bit_length(), max(1, int(len(counts)).bit_length())
    pairs = None
    if ORDER * bits > 64:  # halves by their places among all halves
        halves = [packed(own + 1, counts, bits, 2), packed(own + 1, counts, bits, 0, 2)]
        pairs = np.unique(np.concatenate(halves))
        keys = np.searchsorted(pairs, halves[0]).astype(tk.U) << tk.U(32) | np.searchsorted(pairs, halves[1]).astype(tk.U)
    else:
        keys = packed(own + 1, counts, bits)
    if pairs is not None or ORDER * bits + text_bits > 64:
        each, keys = np.unique(keys, return_inverse=True)
    else:
        each = None
    keys = np.sort(keys.astype(tk.U) << tk.U(text_bits) | np.repeat(np.arange(len(counts)), counts).astype(tk.U))
    texts_of = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys >>= tk.U(text_bits)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = keys[first] if each is None else each[keys[first]]
    n = np.diff(np.append(first, len(keys)))
    texts = np.diff(np.append(np.searchsorted(texts_of, first), len(texts_of)))
    one = tk.U((1 << bits) - 1)
    if pairs is None:
        columns = [(runs >> tk.U(bits * back)) & one for back in range(ORDER - 1, -1, -1)]
    else:
        columns = [pairs[half.astype(np.int64)] >> shift & one for half in (runs >> tk.U(32), runs & tk.U(0xFFFFFFFF)) for shift in (tk.U(bits), tk.U(0))]
    named = np.concatenate([[0], alphabet.astype(np.int64) + 1])
    return np.stack([named[x.astype(np.int64)] for x in columns], 1), n, texts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["model", "high", "low", "n", "texts"]
    for batch in batches:
        kinds = batch["model"].to_numpy(zero_copy_only=False)
        for c in tk.chunks(batch["text"]):
            own, firsts = points(c)
            sizes, of = np.diff(firsts), kinds[c.lo : c.hi]
            for model in np.unique(of[sizes > 0]):
                mine = of == model
                some = sizes[mine & (sizes > 0)]
                runs, n, texts = count_texts(own[np.repeat(mine, sizes)], some)
                high, low = (runs[:, 0] << POINT | runs[:, 1]), (runs[:, 2] << POINT | runs[:, 3])
                columns = [np.full(len(n), model), high, low, n, texts]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (model, -1, -1, 0, len(some))], names=names)


def discounts(ones: list[Column]) -> Column:
    """Modified Kneser-Ney's discounts of counts 1, 2 and 3 or more, by how many n-grams occur once to four times; 0.5, 1 and
    1.5 where these are too few or too odd for its formula."""
    n = ones
    y = F.try_divide(n[0], n[0] + 2 * n[1])
    found = [k - (k + 1) * y * F.try_divide(n[k], n[k - 1]) for k in (1, 2, 3)]
    enough = F.least(*n) > 0
    return F.array(*(F.when(enough & (d > 0) & (d < k), d).otherwise(F.lit(k / 2)) for k, d in enumerate(found, 1)))


def counted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n-grams, kept). n-grams: model, k (the order), high, low, n: all n-grams with their counts, of the highest order as they
    occur, of lower ones as distinct left extensions. kept: those that the model stores; the same rows where SHARE is 0."""
    counts = texts.select("model", "text").mapInArrow(_counted, "model bigint, high bigint, low bigint, n bigint, texts bigint")
    counts = stage(counts.groupBy("model", "high", "low").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "op10-runs")
    of = counts.where("high = -1").select("model", F.col("texts").alias("of"))
    mask = F.lit((1 << POINT) - 1)
    # the n-gram without its first symbol, by the number of symbols
    shorter = {3: (F.col("high").bitwiseAND(mask), F.col("low")), 2: (F.lit(0).cast("long"), F.col("low")), 1: (F.lit(0).cast("long"), F.col("low").bitwiseAND(mask))}
    tables = [counts.where("high >= 0").select("model", "high", "low", "n")]
    kept = SHARE and [counts.where("high >= 0").join(of, "model").where(F.col("texts") >= SHARE * F.col("of")).select("model", "high", "low")]
    for k in (3, 2, 1):
        high, low = shorter[k]
        tables.append(tables[-1].groupBy("model", high.alias("high"), low.alias("low")).agg(F.count("*").alias("n")))
        if kept:
            kept.append(kept[-1].select("model", high.alias("high"), low.alias("low")).distinct())
    named = lambda parts: reduce(DataFrame.unionByName, (x.withColumn("k", F.lit(k)) for k, x in zip((4, 3, 2, 1), parts, strict=True)))
    every = named(tables)
    return every, named(kept) if kept else every


def fit(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The arrays of a model. rows: k, high, low, n, total (of the n-gram's context) and cut (its discount)."""
    mask = (1 << POINT) - 1
    order, high, low, n, total, cut = (rows[x].to_numpy() for x in ("k", "high", "low", "n", "total", "cut"))
    runs = np.stack([high >> POINT, high & mask, low >> POINT, low & mask], 1)
    symbols, rare, bits, pairs = np.setdiff1d(runs, [0]), np.zeros(0, dtype=np.int64), BITS, np.zeros(0, dtype=tk.U)
    own = np.searchsorted(symbols, runs).astype(tk.U) + tk.U(1)
    own[runs == 0] = 0
    below_keys, below = None, 1 / (len(symbols) + 1)
    if len(symbols) + 2 >> BITS:
        ones = order == 1
        most = runs[ones, 3][np.lexsort((runs[ones, 3], -n[ones]))][: (1 << BITS) - 2]
        symbols, rare, bits = np.sort(most), np.setdiff1d(symbols, most), POINT
    highs, lows = own[:, 0] << tk.U(bits) | own[:, 1], own[:, 2] << tk.U(bits) | own[:, 3]
    if len(rare):
        pairs = np.unique(np.concatenate([highs, lows, *contexts_of(highs, lows, bits)]))
    out = {"symbols": (symbols - 1).astype(np.int32), "rare": (rare - 1).astype(np.int32), "pairs": pairs.view(np.int64)}
    for k in range(1, ORDER + 1):
        mine = order == k
        high, low, p = highs[mine], lows[mine], (n[mine] - cut[mine]) / total[mine]
        own = coded(high, low, pairs)
        contexts, which = np.unique(coded(*contexts_of(high, low, bits), pairs), return_inverse=True)
        back = 1 - np.bincount(which, p)
        lower = below if below_keys is None else below[np.searchsorted(below_keys, coded(*shortened(high, low, k - 1, bits), pairs))]
        p = p + back[which] * lower
        for name, at, x in (("hashes", own, p), ("contexts", contexts, back)):
            by = np.argsort(at * _ODD)
            out[f"{name}{k}"], out[f"{'logs' if name == 'hashes' else 'backs'}{k}"] = (at * _ODD)[by].view(np.int64), np.log(x)[by]
        by = np.argsort(own)
        below_keys, below = own[by], p[by]
    return out


def fitted(texts: DataFrame) -> DataFrame:
    """A row of SCHEMA for each model. texts: model bigint, text."""
    every, kept = counted(texts)
    context = [F.col("high"), F.shiftright("low", POINT).alias("before")]
    totals = every.groupBy("model", "k", *context).agg(F.sum("n").alias("total"))
    ones = every.groupBy("model", "k").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)))
    cuts = ones.select("model", "k", discounts([F.col(f"n{i}").cast("double") for i in range(1, 5)]).alias("cuts"))
    stored = every if kept is every else kept.join(every, ["model", "k", "high", "low"])
    rows = stored.withColumn("before", F.shiftright("low", POINT)).join(totals, ["model", "k", "high", "before"]).join(cuts, ["model", "k"])
    rows = rows.select("model", "k", "high", "low", "n", "total", F.element_at("cuts", F.least("n", F.lit(3)).cast("int")).alias("cut"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [key[0]], **{k: [v] for k, v in fit(group).items()}})

    return rows.groupBy("model").applyInPandas(one, SCHEMA)


class Model:
    """A fitted model: the sorted hashes of each order's n-grams and contexts, with their logarithms."""

    def __init__(self, row: dict):
        common, rare = (np.asarray(row[x], dtype=np.int64) for x in ("symbols", "rare"))
        symbols = np.sort(np.concatenate([common, rare]))
        self.pairs = np.asarray(row["pairs"], dtype=np.int64).view(tk.U)
        self.bits = POINT if len(rare) else BITS
        self.other = len(symbols) + 1
        self.number = np.full(int(symbols.max(initial=0)) + 2, self.other, dtype=np.uint32 if len(rare) else np.uint16)
        self.number[symbols] = np.arange(1, len(symbols) + 1)
        self.orders = [[np.asarray(row[f"{x}{k}"], dtype=np.float64) if x[0] in "lb" else np.asarray(row[f"{x}{k}"], dtype=np.int64).view(tk.U) for x in ("hashes", "logs", "contexts", "backs")] for k in range(1, ORDER + 1)]
        #: Log-probabilities of single symbols, by number (0 is a pad).
        self.alone = self.halved(np.zeros(self.other + 1, dtype=tk.U), np.arange(self.other + 1, dtype=tk.U), 1)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each packed n-gram."""
        return self.halved(keys >> tk.U(2 * BITS), keys & tk.U((1 << 2 * BITS) - 1))

    def halved(self, high: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
        """As `logs`, of n-grams in halves of two symbols; by this order and lower ones."""
        out, rest = np.zeros(len(high)), np.arange(len(high))
        for k in range(order, 0, -1):
            hashes, logs, contexts, backs = self.orders[k - 1]
            high, low = shortened(high, low, k, self.bits)
            at, there = find(hashes, coded(high, low, self.pairs) * _ODD)
            out[rest[there]] += logs[at[there]]
            rest, high, low = rest[~there], high[~there], low[~there]
            at, there = find(contexts, coded(*contexts_of(high, low, self.bits), self.pairs) * _ODD)
            out[rest[there]] += backs[at[there]]
        out[rest] -= np.log(self.other)
        return out

    def mean_alone(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """As `mean`, by the order of single symbols."""
        number = self.number[np.minimum(own, len(self.number) - 1)]
        return -np.add.reduceat(self.alone[number], np.cumsum(counts) - counts) / counts

    def mean(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean negative log-probability of the code points of some texts, none of them empty."""
        number = self.number[np.minimum(own, len(self.number) - 1)]
        if self.bits == BITS:
            logs = self.logs(packed(number, counts, BITS))
        else:
            logs = self.halved(packed(number, counts, POINT, 2), packed(number, counts, POINT, 0, 2))
        return -np.add.reduceat(logs, np.cumsum(counts) - counts) / counts


def find(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each asked value in a sorted array, and whether it is there."""
    at = np.searchsorted(sorted_, asked)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == asked if len(sorted_) else np.zeros(len(asked), dtype=bool)


def score(c: tk.Chunk, kinds: np.ndarray, models: dict[int, Model]) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log-probability of each of a chunk's texts, by the highest order and by that of single code points; NaN
    where it is empty or its model isn't here."""
    own, firsts = points(c)
    sizes = np.diff(firsts)
    out, alone = np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
    for kind in np.unique(kinds[sizes > 0]):
        if int(kind) in models:
            mine = (kinds == kind) & (sizes > 0)
            texts = own[np.repeat(mine, sizes)], sizes[mine]
            out[mine], alone[mine] = models[int(kind)].mean(*texts), models[int(kind)].mean_alone(*texts)
    return out, alone


def blocks(models: DataFrame) -> Iterator[dict[int, Model]]:
    """The models, BLOCK numbers at a time (at least one model)."""
    held, block = 0, {}
    for row in models.toLocalIterator():
        size = len(row["pairs"]) + sum(len(row[x]) for x in _LISTS)
        if block and held + size > BLOCK:
            yield block
            held, block = 0, {}
        block[row["model"]] = Model(row.asDict())
        held += size
    yield block
