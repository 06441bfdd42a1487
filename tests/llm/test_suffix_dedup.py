"""Operator 12: the transform against sorted suffixes, the query against brute force and its SQL."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import suffix_dedup

from .test_operators import ROWS, SCHEMA, db_of, written


@pytest.mark.parametrize("seed", range(20))
def test_columns(tmp_path, seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choices(b"ab\x00\xf4c"[: rng.randint(1, 5)], k=rng.randint(1, 12))) for _ in range(rng.randint(1, 30))]
    sizes = np.array([len(p) for p in pieces])
    columns = suffix_dedup.Columns(np.frombuffer(b"".join(pieces), dtype=np.uint8) + np.uint8(1), np.cumsum(sizes), sizes, str(tmp_path))
    # ends sort before all symbols and by piece
    suffixes = sorted((tuple((1, b) for b in p[k:]) + ((0, i),), i, k) for i, p in enumerate(pieces) for k in range(len(p) + 1))
    symbols, prefixes = columns.whole()
    assert symbols.tolist() == [pieces[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
    common = lambda x, y: next(n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b)
    assert prefixes.tolist() == [0] + [common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)]
    rows = {(int(p), int(r)): length for length, ps, rs in columns.rows() for p, r in zip(ps, rs, strict=True)}
    assert rows == {(i, r): len(pieces[i]) - k for r, (_, i, k) in enumerate(suffixes) if k < len(pieces[i])}
    assert len(list(tmp_path.iterdir())) == 4


def test_first_holders():
    pieces = [b"abcdefgh", b"xbcdefgy", b"abcd"]
    piece, at, first = suffix_dedup.first_holders(pieces, np.array([5, 3, 9]), 4)
    assert list(zip(piece, at, first, strict=True)) == [(0, 0, 5), (0, 1, 3), (0, 2, 3), (0, 3, 3), (0, 4, 5), (1, 0, 3), (1, 1, 3), (1, 2, 3), (1, 3, 3), (1, 4, 3), (2, 0, 5)]


def brute(rows, window):
    first = collections.defaultdict(set)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, t in texts:
        for k in range(len(t) - window + 1):
            if i is not None:
                first[t[k : k + window]].add(i)
    least = {k: min(v) for k, v in first.items()}
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if i is not None and least[t[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(repr, out))


def made():
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(140))
    rows = [(i, t[:4000] if t else t, *rest) for i, t, *rest in ROWS]
    for i in range(200, 290):
        own = "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(0, 160)))
        rows.append((i, own + passage[rng.randint(0, 60) :][: rng.randint(40, 100)] * rng.randint(0, 2) + own[:70] + rng.choice(["", "ab" * 90, "\0" * 75, passage]), "en", "s", 0))
    return rows


def run(docs, **settings):
    out = suffix_dedup.dedup_bytes(docs, **settings).collect()
    return sorted(repr((r["doc_id"], len(r["kept"]) + sum(x["end"] - x["start"] for x in r["removed"]), sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest())) for r in out)


@pytest.mark.parametrize("settings", [{"hot": 3, "pieces": 100}, {"window": 12, "gram": 6, "hot": 20}])
def test_brute(spark, settings):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"mark": F.lit("x"), "seeds": F.lit(1), "gone": F.lit("y"), "anchor": F.lit(2), "kept": F.lit("z")}).repartition(4)
    assert run(docs, **settings) == brute(rows, settings.get("window", 50))


def test_query_and_sql(spark, tmp_path):
    rows = made()
    got = suffix_dedup.op12_suffix_dedup(spark, written(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {t for c, t in got.dtypes if c != "kept_sha256"} == {"bigint"}
    expected = brute(rows, 50)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    assert sorted(map(repr, db_of(rows).sql(suffix_dedup.ORACLE).fetchall())) == expected


def test_edges(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    one = spark.createDataFrame([(7, "x" * 50, None, None, 0), (7, "x" * 50, None, None, 0), (8, "y" + "x" * 50, None, None, 0), (9, "x" * 49, None, None, 0)], SCHEMA)
    digest = lambda t: hashlib.sha256(t).hexdigest()
    assert run(one) == sorted(map(repr, [(7, 50, 0, 0, digest(b"x" * 50))] * 2 + [(8, 51, 50, 1, digest(b"y")), (9, 49, 0, 0, digest(b"x" * 49))]))
    with pytest.raises(ValueError, match="254"):
        suffix_dedup.dedup_bytes(one, window=200)
