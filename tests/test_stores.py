"""Version keys, advisories, ordered ids, versions of a store, and braces in one pass."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import advisories, findings, textscan
from gneiss.sources.stores import Store

SEMANTIC = ["x", "0.0.1-alpha", "0.0.1-alpha.1", "0.0.1-alpha.beta", "0.0.1-beta.2", "0.0.1-beta.11", "0.0.1-rc.1", "0.0.1", "0.9.9", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2", "1.2.3", "1.10.0", "2.0.0", "10.0.0", "99999999999999999999.0.0"]
PYTHON = ["1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1.dev1", "1.0.post1", "1.0.1", "1.1.dev3", "1.1preview1", "1.1", "1.1-2", "1.10", "1!0.1"]


@pytest.mark.parametrize(("versions", "ecosystem"), [(SEMANTIC, "npm"), (PYTHON, "PyPI")])
def test_versions_sort(spark, versions, ecosystem):
    df = spark.createDataFrame(random.Random(1).sample(list(enumerate(versions)), len(versions)), "i int, v string")
    assert [r["v"] for r in df.orderBy(advisories.version_key("v", F.lit(ecosystem))).collect()] == versions


def test_equal_versions(spark):
    pairs = [("1.0", "1.0.0", "npm"), ("v1.2.3", "1.2.3+build", "npm"), ("1.0alpha1", "1.0.a1", "PyPI"), ("1.0-1", "1.0.post1", "PyPI"), ("1.0+local", "1", "PyPI")]
    df = spark.createDataFrame(pairs, "a string, b string, e string")
    assert df.where(advisories.version_key("a", "e") != advisories.version_key("b", "e")).count() == 0
    assert spark.createDataFrame([(None, "npm")], "v string, e string").select(advisories.version_key("v", "e").alias("k")).first()["k"] is None


def test_ranges(spark):
    text = '{"id":"X","affected":[{"package":{"ecosystem":"npm","name":"p"},"versions":["9.9"],"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.0.0"},{"introduced":"2.0.0-rc.1"},{"last_affected":"2.1.0"},{"introduced":"3"}]},{"type":"GIT","events":[{"introduced":"0"}]}]}]}'
    texts = spark.createDataFrame([(text,), ("{",), (None,), ('{"id":"Y"}',)], "json string")
    have = ["0.1", "1.0.0-rc.1", "1.0.0", "2.0.0-beta", "2.0.0-rc.1", "2.1", "2.1.1", "3.0.0-rc.1", "3.0", "50", "9.9"]
    deps = spark.createDataFrame([("npm", "p", v, "l") for v in have] + [("npm", "q", "0.1", "l"), ("PyPI", "p", "0.1", "l"), ("npm", "p", None, "l")], "ecosystem string, name string, version string, lockfile string")
    got = advisories.affected(deps, advisories.parsed(texts))
    assert sorted(r["version"] for r in got.collect()) == sorted(["0.1", "1.0.0-rc.1", "2.0.0-rc.1", "2.1", "3.0", "50", "9.9"])
    assert advisories.vulnerable_by_range(deps, advisories.parsed(texts)).count() == 7


def test_ids_without_one_window_over_all(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None, "z"]) if i % 3 else f"f{i}", rng.randint(0, 3), 0, i) for i in range(500)]
    found = spark.createDataFrame(data, "file string, rule_ord int, pattern_ord int, line int")
    out = findings.with_ids(found)
    got = sorted((r["id"], r["file"], r["rule_ord"], r["line"]) for r in out.collect())
    expected = sorted(((f, r, line) for f, r, _, line in data), key=lambda x: (x[0] is not None, x[0] or "", *x[1:]))
    assert got == [(f"SPX-{i:04d}", *x) for i, x in enumerate(expected, 1)]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert findings.with_ids(found.where("false")).count() == 0


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"a": "x int", "b": "y string"})
    assert store.version() is None and store.load("a").count() == 0
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("u",)], "y string")
    first = store.save({"a": a, "b": b})
    store.save({"a": store.load("a").union(a), "b": b})  # reads what it replaces
    assert store.load("a").count() == 2 and (tmp_path / "s" / first).exists()
    with pytest.raises(Exception, match="boom"):
        store.save({"a": a.select(F.raise_error(F.lit("boom")).cast("int").alias("x")), "b": b})
    assert store.load("a").count() == 2
    third = store.save({"a": a, "b": b})
    assert not (tmp_path / "s" / first).exists() and store.load("a").count() == 1
    with pytest.raises(ValueError, match="holds"):
        store.save({"a": a})
    for file in (tmp_path / "s" / third / "b").glob("*.parquet"):
        file.write_bytes(b"broken")
    for crc in (tmp_path / "s" / third / "b").glob(".*.crc"):
        crc.unlink()
    assert store.load("b").count() == 0 == store.load("a").count()
    (tmp_path / "s" / Store.CURRENT).write_text("{")
    (tmp_path / "s" / f".{Store.CURRENT}.crc").unlink(missing_ok=True)
    assert store.version() is None and store.load("a").count() == 0
    store.save({"a": a, "b": b})
    assert store.load("a").count() == 1


def test_incremental_scan_remembers_clean_files(spark, tmp_path, files):
    store = Store(spark, f"file://{tmp_path}/s", findings.SCAN_STORE)

    def scan(tree, rules="1"):
        found, again = findings.incremental_scan(files(tree), store, rules, (R.CORPUS,))
        return sorted(r["file"] for r in found.collect()), sorted(r["path"] for r in again.collect())

    assert scan({"a": "Licensed under x", "b": "clean"}) == (["a"], ["a", "b"])
    assert scan({"a": "Licensed under x", "b": "clean", "c": "all rights reserved"}) == (["a", "c"], ["c"])
    assert scan({"a": "now clean", "b": "clean"}) == ([], ["a"])
    assert scan({"a": "now clean", "b": "clean"}, "2") == ([], ["a", "b"])
    with pytest.raises(ValueError, match="together"):
        findings.incremental_scan(files({"a": ""}), store, "1", (R.HEADERS,))


def test_braces_in_one_pass():
    def walk(text, start):
        depth, inside, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return i + 1
        return 0

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices('{}"\\a', weights=(4, 4, 2, 2, 1), k=rng.randint(0, 40)))
        assert sorted(textscan.closed_braces(text)) == [(i, e) for i, c in enumerate(text) if c == "{" and (e := walk(text, i))]
    for text in ("{" * 1_000_000, '{"' * 500_000, '{\\"' * 300_000, "{}" * 500_000):
        began = time.process_time()
        textscan.closed_braces(text)
        assert time.process_time() - began < 5  # quadratic takes hours
