"""All families together give what each gives alone, in few passes."""

import re

import pytest
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions.deep_rules import DEEP
from gneiss.operators import findings, modes
from gneiss.operators.modes import Family, Rule
from gneiss.plans.base import files as corpus
from gneiss.plans.scan_queries import scan_builtin

from .conftest import SF

MADE = (
    Family("a", "M1", (Rule("x", "X", "high", ("foo", "^bar")), Rule("y", "Y", "low", ("baz",), languages=("python",)))),
    Family("b", "M2", (Rule("x", "X", "high", ("foo",), window=(-1, 1), mitigation="safe"), Rule("z", "Z", "low", ("bar", "baz"))), cap=40),
    Family("c", "M3", (Rule("x", "X", "high", ("none", "foo\\s+bar", "baz")),), gate="foo"),
    Family("d", "M4", (Rule("x", "X", "high", ("foo", "baz"), window=(0, 1), mitigation="safe"),)),
    Family("e", "M5", (Rule("x", "X", "high", ("foo", "baz"), window=(0, 1), mitigation="safe"), Rule("w", "W", "low", ("bar",)))),
    Family("f", "M6", (Rule("m", "M", "low", ("absent",), check="missing"), Rule("n", "N", "low", ("foo",), check="missing"), Rule("p", "P", "low", ("bar", "foo"), check="present"))),
    Family("g", "M6", (Rule("m", "M", "low", ("absent",), check="missing"),), extensions=(".none",)),
    Family("h", "M7", (Rule("s", "S", "low", (), path_contains=".py", has=("foo",), lacks=("safe",)), Rule("t", "T", "low", ("ba.",), path_contains="a"), Rule("u", "U", "low", ("baz",), languages=("go",)))),
)
TREE = {"a.py": "foo\nbar foo\n baz  \n", "b.py": "foo\nsafe\nbaz\n\nfoo", "c.js": "bar\nbaz\nfoo\n\n  bar", "d": "", "e.py": "x" * 41 + " foo", "a/f.go": "BAZ\n^bar\nfoo safe"}


def each(files, families):
    out = None
    for i, f in enumerate(families):
        one = modes.findings(files, f, i)
        out = one if out is None else out.unionByName(one)
    return sorted(map(repr, map(tuple, out.collect())))


def together(files, families):
    return sorted(map(repr, map(tuple, findings.scan(files, families).collect())))


@pytest.mark.parametrize("families", [MADE, *((f,) for f in MADE)])
def test_same_rows_on_a_tree(files, families):
    tree = files(TREE)
    assert together(tree, families) == each(tree, families)
    assert together(tree.where("false"), families) == []


def test_same_rows_of_the_catalogue(spark, files):
    code = {"s.js": "el.innerHTML = v;\nexec(`ls ${d}`)\njwt.verify(t, k)\napp.get('/x', (req) => db.query(`select * from t where id = ${req.query.id}`))\n", "Dockerfile": "FROM a\nADD x y\n", "k.yml": "kind: Pod\nprivileged: true\ncontainers:\n", "x.py": "pickle.loads(request.data)\nopen(request.args['f'])\nos.system(f'{x}')"}
    tree = files(code).unionByName(corpus(spark, SF).limit(150))
    for families in ((*R.WIRED, *R.EXPERIMENTAL), DEEP):
        got = together(tree, families)
        assert got == each(tree, families) and got


def test_few_passes(spark):
    out = findings.scan(corpus(spark, SF), (*R.WIRED, *R.EXPERIMENTAL))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    tables = len(re.findall("Relation|LogicalRelation|parquet", corpus(spark, SF)._jdf.queryExecution().optimizedPlan().toString()))
    assert len(re.findall("Relation|LogicalRelation|parquet", plan)) <= 3 * tables
    assert plan.count("Generate") <= 7 * 3


def test_needed_words_never_hide_a_match():
    """A pattern's needed words stand in whatever it matches, and are told for every rule of the catalogue."""
    for pattern, words in ((r"a(bc|de+)?fgh", ("fgh",)), (r"(select|insert)\s+x", ("insert", "select")), (r"[ab]+\d", ()), (r"(?=.*tok)\w+", ()), (r"x{0,2}yy", ("yy",)), (r"(open(ai)?|llm)", ("llm", "open")), (r"(foo|)bar", ("bar",)), (r"\p{L}abc", ()), (r"[a[bc]]xyz", ()), (r"[\w.\[]xyz", ("xyz",))):
        assert modes.needed(pattern) == words, pattern
    every = [p for f in (*R.WIRED, *R.EXPERIMENTAL, *DEEP, R.CORPUS) for r in f.rules for p in r.patterns]
    assert len(every) > 400 and all(modes.needed(p) for p in every)


def test_scans_trim_and_gate_as_each_mode_alone(files):
    """Upper case, text that isn't ASCII and blank lines around hits: the joint pass and the single ones agree."""
    tree = files({"a.py": "  İPassword = 'ABCDEFGHIJ'  \n\n LICENSED under X　\n", "b.txt": "K token: \"aaaabbbbcccc\"\n"})
    columns = ["rule", "file", "line", "snippet"]
    one, two = (sorted(map(tuple, f.select(*columns).collect())) for f in (modes.findings(tree, R.CORPUS), modes.findings_together(tree, [R.CORPUS])))
    assert one == two and len(one) == 3 and ("license-line", "a.py", 3, "LICENSED under X") in [(r.split(":")[-1], *x) for r, *x in one]


def test_files_of_any_size_are_scanned(spark, files, tmp_path):
    """Files over 500,000 bytes are looked at by every mode, and by the query; a file without a text by none."""
    long = "plain words of a text\n" * 40_000
    code = long + "jwt.verify(t, k)\nfs.readFile(path.join(dir, req.query.name))\nexec(`ls ${d}`)\n"
    tree = files({"long.js": code, "short.js": code[-100:]}).unionByName(files({"none.js": ""}).withColumn("content", F.lit(None).cast("string")))
    got = together(tree, (*R.WIRED, *R.EXPERIMENTAL))
    of = [sorted(r.split(", ")[0] for r in got if f"'{name}'" in r) for name in ("long.js", "short.js")]
    assert of[0] == of[1] and len(of[0]) > 2 and len(got) == 2 * len(of[0])
    docs = [(1, code), (2, "short"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert "command-injection" in {r["rule"] for r in scan_builtin(spark, str(tmp_path)).collect()}
