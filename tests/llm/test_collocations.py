"""Operator 13 against brute force and its SQL, with prefixes dealt out by their extensions too."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import collocations

from .test_operators import ROWS, SCHEMA, db_of, written

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000, within=50):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in candidates.items():
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x))) and 100 * b >= within * a for x, b in candidates.items()):
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, t.decode(), -a, left, right, n, -s) for i, (s, a, t, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made():
    rng = random.Random(8)
    rows = [r for r in ROWS if r[0] != 103]
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Ab", "aB"]
    for i in range(200, 300):
        text = "".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1))[0] + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "  "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text + " The very common Phrase" * rng.randint(0, 2), rng.choice(["en", "de", None, ""]), "s", 0))
    return rows + [(400, "Und und UND " * 30, "und", "s", 0)]


@pytest.mark.parametrize(("longest", "split"), [(3, 40), (4, 30)])
def test_brute(spark, longest, split):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit("x"), "a": F.lit(1), "word": F.lit("y"), "times": F.lit(2)}).repartition(5)
    got = collocations.collocations(docs, longest=longest, split=split, top=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, top=50)


def test_query_and_sql(spark, tmp_path):
    rows = made()
    got = collocations.op13_collocations(spark, written(spark, tmp_path, spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(db_of(rows).sql(collocations.ORACLE).fetchall()) == brute(rows)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_products(spark):
    """Counts whose products pass 64 bits, through the scoring of collocations alone."""
    a, left, right = 3_000_000_019, 3_000_000_019, 4_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{collocations.SCORE} AS s").first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_grow():
    ids = [np.array([1, 1, 1, 2]), np.array([5, 5, 6, 5]), np.array([0, 7, 0, 7])]
    assert list(collocations.grow(ids, np.array([2, 3, 9, 1]), 3)) == [((1, 5), 5), ((1, 5, 7), 3), ((1, 6), 9)]
