"""Operator 11 against brute force: kernels on made words, the query on awkward rows and planted periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import periodic_runs
from gneiss.llm import textkit as tk

from .test_operators import ROWS, SCHEMA, words, written


def brute(w, least=6, exponent=4):
    """All runs by period: stretches in which words q apart are equal, smallest period first."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_overlap():
    assert periodic_runs.overlap(6, 4) == 5
    assert periodic_runs.overlap(20, 4) == 15
    assert periodic_runs.overlap(2, 4) == 3


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (12, 5), (2, 4)])
def test_kernel(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters, doc = rng.choice([1, 2, 3, 8]), []
            for _ in range(rng.randint(0, 5)):
                block = [rng.randint(1, letters) for _ in range(rng.randint(1, 6))]
                doc += (block * rng.randint(1, 9))[: rng.randint(0, 40)]
            docs.append(doc)
        ids = tk.mix(np.array([x for d in docs for x in d], dtype=np.uint64))
        firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        s, e, p = periodic_runs.runs_of(ids, firsts, least, exponent)
        expected = [(f + a, n, q) for d, f in zip(docs, firsts, strict=False) for a, n, q in brute(d, least, exponent)]
        assert list(zip(s, e - s, p, strict=True)) == sorted(expected)


def test_masking_leaves_words_out():
    w = [f"w{i}" for i in range(100)] + ["a", "b"] * 5 + [f"x{i}" for i in range(100)]
    ids = tk.mix(np.array([zlib.crc32(x.encode()) for x in w], dtype=np.uint64))
    assert np.flatnonzero(periodic_runs.unmasked(ids, np.array([0, len(w)]), 5)).tolist() == list(range(100, 110))


def expected_row(doc_id, text):
    w = words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for r in ROWS if r[0] != 103]  # brute force is slow on the longest
    for i in range(300, 420):
        block = " ".join(rng.choice(["a", "b", "cé"]) for _ in range(rng.randint(1, 5)))
        rows.append((i, f"{i} " + " \n".join([block] * rng.randint(1, 12)) + f" end{i} " + "z " * rng.randint(0, 9), "en", "s0", 0))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"runs": F.lit("x"), "n_words": F.lit(1), "collapsed": F.lit("y"), "best": F.lit(2)}).repartition(3)
    got = periodic_runs.op11_periodic_runs(spark, written(spark, tmp_path, docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected_row(r[0], r[1])) for r in rows)


def test_empty_table_and_long_text(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(["one", "two", "three"] * 60_000)
    row = periodic_runs.find_runs(spark.createDataFrame([(1, long, "en", "s", 0)], SCHEMA)).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 180_000, 3)] and row["collapsed"] == "one two three"
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs(spark.createDataFrame([], SCHEMA), exponent=3)
