"""Operator 10, quality rules: n-gram perplexity under a modified Kneser-Ney model, with bands for each language.

The query and the pipeline judge by runs of code points (unit="characters", module `perplexity`), counted over all texts.
The other unit, "words", counts all runs of WORD_ORDER words in tables keyed by language and word hashes, with discounts,
contexts and probabilities joined; no text is judged by its own counts there, but by those of the half of the texts that
it doesn't belong to (dealt by the least hash of their n-grams, so copies stand together). It sees the order of words,
which characters don't, and needs more disk than the budget (README).

A document's log-perplexity is the mean negative log-probability of its units. Each language's band comes from the exact
quartiles of all its documents that pass the base rules: they are rejected above q75 + slack (unlike the language) and
below q25 - slack (too easy), where slack is SPREAD times the interquartile range plus MARGIN times the median. By
characters there are two of them, each with its band: by the model's highest order, and by its order of single code points.

Defined results: null and empty texts have no words, fail the base rules and have no perplexity. A null language is
one of its own. Documents of a language whose band is unknown (no document passes the base rules) fail those anyway.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perplexity
from . import textkit as tk
from .common import stage, table
from .line_dedup import lines

WORD_ORDER = 3
MIN_WORDS, REPEATED = 50, 50
#: Log-perplexities are counted in these steps; those of single code points lie closer.
STEP, FINE = 0.01, 0.0005
#: By unit ("alone": single code points). Measured on labelled documents outside the held-out fifth; they hold for all
#: languages.
SPREAD, MARGIN = {"words": 2.0, "characters": 4.0, "alone": 4.0}, {"words": 0.3, "characters": 0.1, "alone": 0.005}
#: Columns of an n-gram, the word last.
WORDS = tuple(f"w{k}" for k in range(WORD_ORDER))
SYMBOLS = "#*$%&|<>"

def _grams(with_key: bool):
    """The words of each text, each after the WORD_ORDER - 1 words before it (zeros before the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                starts, ends, firsts = tk.words(c)
                hashes = tk.word_hashes(c, starts, ends).view(np.int64)
                counts = np.diff(firsts)
                place = np.arange(len(hashes)) - np.repeat(firsts[:-1], counts)
                which = pa.array(np.repeat(np.arange(c.lo, c.hi), counts))
                columns, mixed = [], np.zeros(len(hashes), dtype=tk.U)
                for back in range(WORD_ORDER - 1, -1, -1):
                    own = np.zeros_like(hashes)
                    own[back:] = hashes[: len(hashes) - back]
                    own[place < back] = 0
                    columns.append(pa.array(own))
                    mixed = tk.mix(mixed + own.view(tk.U))
                full = counts > 0
                least = np.minimum.reduceat(mixed, firsts[:-1][full]) if full.any() else mixed
                names = ("key", "model") if with_key else ("model",)
                half = pa.array(np.repeat((least & tk.U(1)).astype(np.int64), counts[full]))
                yield pa.RecordBatch.from_arrays([*(batch[k].take(which) for k in names), half, *columns], names=[*names, "half", *WORDS])

    return run


def _base(c: tk.Chunk) -> Iterator[tuple]:
    starts, ends, firsts = tk.words(c)
    hashes = tk.word_hashes(c, starts, ends)
    triples, whole = tk.windows_hash(hashes, 3, tk.BASE_A), tk.inside(3, firsts, len(hashes))
    lead = np.concatenate([[0], np.cumsum(((c.data & 0xC0) != 0x80) & ~tk.SPACE[c.data])])[c.offs]
    odd = np.zeros(256, dtype=bool)
    odd[list(SYMBOLS.encode())] = True
    odd = np.concatenate([[0], np.cumsum(odd[c.data])])[c.offs]
    begin, end, first_line, full = lines(c)
    line = tk.spans_hash(tk._bytes_table(2)[c.data], begin, end, tk.BASE_BYTES)
    for i in range(c.hi - c.lo):
        a, b = firsts[i], firsts[i + 1]
        repeated = 0
        if b - a > 3:
            _, back, times = np.unique(triples[a : b - 2], return_inverse=True, return_counts=True)
            at = np.flatnonzero(times[back] > 1)
            if len(at):
                marks = np.zeros(b - a + 1, dtype=np.int32)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + 3, -1)
                repeated = int((np.cumsum(marks) > 0).sum())
        rows = line[first_line[i] : first_line[i + 1]][full[first_line[i] : first_line[i + 1]]]
        n = int(b - a)
        yield n, int(lead[i + 1] - lead[i]), int(odd[i + 1] - odd[i]), len(rows) - len(np.unique(rows)), repeated, n < MIN_WORDS or 100 * repeated > REPEATED * n


def _measure(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                columns = list(zip(*_base(c), strict=True))
                kinds = (*[pa.int64()] * 5, pa.bool_())
                rest = [k for k in batch.schema.names if with_text or k != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[k].slice(c.lo, c.hi - c.lo) for k in rest), *(pa.array(v, type=k) for v, k in zip(columns, kinds, strict=True))],
                    names=[*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
                )

    return run


def probabilities(grams: DataFrame) -> DataFrame:
    """half, model, the words of each n-gram that this half has, and p: its probability by the counts of the other half."""
    by = ["half", "model"]
    counts = stage(grams.groupBy(*by, *WORDS).agg(F.count("*").alias("n")), "op10-counts")
    tables = [counts]
    for k in range(1, WORD_ORDER):
        tables.insert(0, stage(tables[0].groupBy(*by, *WORDS[k:]).agg(F.count("*").alias("n")), f"op10-continuations-{k}"))  # distinct left extensions
    lower = tables[0].groupBy("model").agg((1 / F.count_distinct(WORDS[-1])).alias("p"))
    for k, own in enumerate(tables, 1):
        words = list(WORDS[WORD_ORDER - k :])
        ones = own.groupBy(*by).agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        enough = F.least("n1", "n2", "n3", "n4") > 0
        steps = ((i, F.when(enough, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))) for i in (1, 2, 3))
        discounts = ones.select(*by, *(F.when(d > 0, d).otherwise(F.lit(i / 2)).alias(f"d{i}") for i, d in steps))
        cut = own.join(discounts, by).select(*by, *words, "n", F.element_at(F.array("d1", "d2", "d3"), F.least("n", F.lit(3)).cast("int")).alias("cut"))
        context = cut.groupBy(*by, *words[:-1]).agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        asked = own.select((1 - F.col("half")).alias("half"), "model", *words)  # what the other half holds
        found = asked.join(cut, [*by, *words], "left").join(context, [*by, *words[:-1]], "left").join(lower, ["model"] if k == 1 else [*by, *words[1:]])
        p = F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")
        lower = stage(found.select(*by, *words, p.alias("p")), f"op10-probabilities-{k}")
    return lower.withColumn("half", 1 - F.col("half"))


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def _by_words(docs: DataFrame, with_text: bool, carried: str) -> DataFrame:
    rows = stage(docs.mapInArrow(_measure(with_text), f"{carried}, {MEASURES}"), "op10-rows")
    texts = docs.select(F.col("gram_key").alias("key"), F.col("gram_model").alias("model"), "text")
    named = ", ".join(f"{k} bigint" for k in WORDS)
    known = probabilities(texts.drop("key").mapInArrow(_grams(False), f"model bigint, half bigint, {named}"))
    each = texts.dropDuplicates(["key"]).mapInArrow(_grams(True), f"key bigint, model bigint, half bigint, {named}")
    mean = each.join(known, ["half", "model", *WORDS]).groupBy("key").agg(F.round(-F.avg(F.log("p")) / STEP).cast("long").alias("gram_steps"))
    return rows.join(mean.withColumnRenamed("key", "gram_key"), "gram_key", "left")


def _scored(models: Broadcast, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch["gram_model"].to_numpy(zero_copy_only=False)
            for measured, c in zip(_measure(with_text)(iter([batch])), tk.chunks(batch["text"]), strict=True):
                for name, x, step in zip(("gram_steps", "gram_alone"), perplexity.score(c, kinds[c.lo : c.hi], models.value), (STEP, FINE), strict=True):
                    measured = measured.append_column(name, pa.array(np.nan_to_num(np.round(x / step)).astype(np.int64), mask=np.isnan(x)))
                yield measured

    return run


def _by_characters(docs: DataFrame, with_text: bool, carried: str) -> DataFrame:
    spark = docs.sparkSession
    models = stage(perplexity.fitted(docs.select(F.col("gram_model").alias("model"), "text")), "op10-models")
    mine, parts, done = F.col("gram_model"), [], []

    def judged(own: DataFrame, block: dict) -> DataFrame:
        return own.mapInArrow(_scored(spark.sparkContext.broadcast(block), with_text), f"{carried}, {MEASURES}, gram_steps bigint, gram_alone bigint")

    found = perplexity.blocks(models)
    block = next(found)
    for following in found:
        parts.append(judged(docs.where(mine.isin(list(block))), block))
        done += block
        block = following
    parts.append(judged(docs.where(~mine.isin(done)) if done else docs, block))
    return functools.reduce(DataFrame.unionByName, parts)


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang"), unit: str = "words") -> DataFrame:
    """The carried columns, the base measures, base_failed, log_perplexity, its band (low, high) and kept, for every row.
    unit: "words" or "characters", which adds log_perplexity_alone, that of single code points, with its band.

    Carried columns are staged with the measures; with text among them, each text is written once."""
    kinds = dict(docs.dtypes)
    with_text = "text" in carry
    model, key = F.xxhash64("lang"), F.xxhash64("lang", F.coalesce("text", F.lit("")))
    docs = docs.select(*dict.fromkeys((*carry, "lang", "text"))).withColumns({"gram_model": model, "gram_key": key})
    carried = ", ".join(f"`{k}` {kinds[k]}" for k in docs.columns[:-2] if with_text or k != "text") + ", gram_model bigint, gram_key bigint"
    rows = stage((_by_words if unit == "words" else _by_characters)(docs, with_text, carried), "op10-judged")
    scales = [("gram_steps", "", unit, STEP)] + [("gram_alone", "_alone", "alone", FINE)] * (unit == "characters")
    passed = rows.where("not base_failed").groupBy("gram_model")
    bands = passed.agg(*(F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY {steps})").alias(f"{steps}_q{i}") for steps, *_ in scales for i, x in enumerate((0.25, 0.5, 0.75))))
    inside, added = ~F.col("base_failed"), {}
    for steps, end, kind, step in scales:
        q0, q1, q2 = (F.col(f"{steps}_q{i}") for i in range(3))
        slack = SPREAD[kind] * (q2 - q0) + MARGIN[kind] * q1
        log = F.col(steps) * F.lit(step)
        own = {f"low{end}": (q0 - slack) * step, f"high{end}": (q2 + slack) * step, f"log_perplexity{end}": log}
        inside = inside & F.coalesce(log.between(own[f"low{end}"], own[f"high{end}"]), F.lit(False))
        added |= own
    # a row a language: sent to all, as a join by language would put one language's rows into one task
    found = rows.join(F.broadcast(bands), "gram_model", "left").withColumns(added | {"kept": inside})
    return found.drop("gram_model", "gram_key", *(x for steps, *_ in scales for x in (steps, *(f"{steps}_q{i}" for i in range(3)))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, the base measures, base_failed, both log-perplexities with their bands, kept, by a model of
    all runs of all texts. Null and empty texts fail the base rules; a null language is one of its own; repeated rows are judged
    each. An empty table gives no rows."""
    return judge(table(spark, sf_dir, "documents"), unit="characters").drop("lang")
