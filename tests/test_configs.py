"""YAML as rows, and what is read from it."""

import pyarrow as pa
import pytest

from gneiss.functions import rules as R
from gneiss.operators import graph
from gneiss.plans import config_queries as Q
from gneiss.sources import configs, yamlfiles
from gneiss.sources.yamlfiles import parse, plain, scalars

GOOD = {
    "a: 1\nb:\n  - x\n  -  y: 2\n     z: [p, {q: r}]\n  - - 1\n    - 2\n": [{"a": 1, "b": ["x", {"y": 2, "z": ["p", {"q": "r"}]}, [1, 2]]}],
    "a:\n- 1\n- 2\nb: 'it''s: # no'\nc: \"q\\\"\\u00e9\\n\"": [{"a": [1, 2], "b": "it's: # no", "c": 'q"é\n'}],
    "--- # first\na: ~\n---\n- b\n...\n": [{"a": None}, ["b"]],
    "x: http://h:80/p#q # note\ny: a:b\n'k: 1': -v": [{"x": "http://h:80/p#q", "y": "a:b", "k: 1": "-v"}],
    "d: &d {a: 1, b: [2]}\ne: *d\nf:\n  <<: [*d, {c: 3}]\n  a: 9\ng: &s text\nh: *s": [{"d": {"a": 1, "b": [2]}, "e": {"a": 1, "b": [2]}, "f": {"a": 9, "b": [2], "c": 3}, "g": "text", "h": "text"}],
    "l: |\n   one\n     two\n\n   three\n\n\nm: |-\n  x\nn: |+\n  y\n\no: >\n  a\n  b\n\n  c\n    d\n  e\n": [{"l": "one\n  two\n\nthree\n", "m": "x", "n": "y\n\n", "o": "a b\nc\n  d\ne\n"}],
    "p: one\n  two # note\n  three\nq: 'a\n  b'\nr: [1,\n # c\n 2, 'x]' ]\ns: {a: , b: {}, \"c\": [ ]}\n": [{"p": "one two three", "q": "a b", "r": [1, 2, "x]"], "s": {"a": None, "b": {}, "c": []}}],
    "- &x\n  a: 1\n- *x\n- a: b\n  c: |2\n     d\n-\n- {a: b}\n": [[{"a": 1}, {"a": 1}, {"a": "b", "c": " d\n"}, None, {"a": "b"}]],
    "just a text": ["just a text"],
    "[a, b: c, 'd': 1]": [["a", {"b": "c"}, {"d": 1}]],
    "n: [0x1F, 007, 1.5, .5, 1e3, true, No, null, '1', 1_0]": [{"n": [31, 7, 1.5, 0.5, 1000.0, True, "No", None, "1", "1_0"]}],
    "": [],
    "# only a comment\n": [],
    "a: 1\r\nb: 2\r\n": [{"a": 1, "b": 2}],
}
BAD = ("a: 1\na: 2", "a: [1, 2", "a: 'x", "\ta: 1", "a: b: c", "a: 1\n  b: 2\n c: 3", "- a\nb: 1", "a: *none", "a: !tag x", "? a\n: b", "a: {b: 1, b: 2}", "a: [1] x", "a: 'x' y", "a\nb: 1", "[a}", "a: |x\n b")


@pytest.mark.parametrize("text", GOOD)
def test_parse(text):
    assert [plain(x) for x in parse(text)] == GOOD[text]


@pytest.mark.parametrize("text", BAD)
def test_parse_refuses(text):
    with pytest.raises(ValueError):
        parse(text)


def test_like_another_reader():
    yaml = pytest.importorskip("yaml")
    texts = [t.replace("{id}", "5").replace("{m}", "3").replace("{next}", "4").replace("{lang}", "en") for t in (Q.BLOCKS, Q.DOCUMENTS, Q.POLICY, *Q.POLICIES, Q.RULES[0], *Q.COMPOSE, Q.MANIFEST)]
    for text in texts:
        text = text.replace("yes", "y").replace("-1.5e3", "2")  # older YAML reads these otherwise
        assert [plain(x) for x in parse(text)] == list(yaml.safe_load_all(text))


def test_rows_of_awkward_files(spark):
    deep = "[" * 3000 + "]" * 3000
    bomb = "a: &a [x, x, x, x, x, x, x, x, x]\n" + "".join(f"{k}: &{k} [*{j}, *{j}, *{j}, *{j}, *{j}, *{j}, *{j}, *{j}, *{j}]\n" for j, k in zip("abcdefg", "bcdefgh", strict=True))
    made = [("good", "a: [1, {}]"), ("null", None), ("empty", ""), ("deep", deep), ("bomb", bomb), ("bad", "a: ["), ("good", "a: [1, {}]")]
    files = spark.createDataFrame(made, "path string, content string").selectExpr("*", "1 AS keys", "'x' AS kind")
    assert sorted(map(tuple, scalars(files).collect())) == [("good", 0, 0, ["a", "[0]"], "int", "1")] * 2 + [("good", 0, 1, ["a", "[1]"], "map", None)] * 2
    assert scalars(files.where("false")).count() == 0


def test_first_file_and_null_tables(spark):
    files = spark.createDataFrame([("b/p.yml", Q.POLICIES[0]), ("a/p.yml", Q.POLICIES[1]), ("c.yml", "x: 1")], "path string, content string")
    assert configs.first_file(files, ("a/p.yml", "b/p.yml")).first()["path"] == "a/p.yml"
    assert configs.first_file(files, ("none.yml",)).count() == 0
    none = files.where("false")
    for reader in (configs.policies, configs.custom_rules, configs.services, configs.manifest_connections, configs.selected_workloads):
        assert reader(none).count() == 0
    assert configs.policies(files).select("policy").distinct().count() == 2
    assert configs.policies(spark.createDataFrame([("p.yml", "name: x\nrules: []")], "path string, content string")).count() == 0


def test_custom_rules_from_yaml():
    (rule,) = R.load_custom("rules:\n- id: no-todo\n  severity: low\n  patterns:\n  - pattern: 'todo\\s'\n  - {type: ast, pattern: x}\n")
    assert (rule.id, rule.title, rule.severity, rule.category, rule.languages, rule.patterns) == ("no-todo", "no-todo", "low", "custom", ("*",), ("todo\\s",))
    assert R.load_custom("rules: [") == [] == R.load_custom("a: 1\n---\nb: 2")


def test_connections_stay_in_their_project(spark):
    rows = [("p", "web", ["x"], {"URL": "http://db:1", "MONGO": "db"}), ("p", "db", [], None), ("q", "only", None, {"A": "http://web/x"})]
    out = graph.inferred_connections(spark.createDataFrame(rows, "project string, name string, depends_on array<string>, environment map<string,string>"))
    assert sorted(map(tuple, out.drop("description").collect())) == [("p", "web", "db", "mongodb"), ("p", "web", "db", "tcp"), ("p", "web", "x", "tcp"), ("q", "only", "web", "http")]


def test_manifests_are_read_once(spark, monkeypatch):
    """Readers that share `parsed` take documents that were read already, and one reading serves both sides of a join."""
    text = "kind: Deployment\nmetadata: {name: w}\nspec: {template: {metadata: {labels: {a: b}}, spec: {containers: [{env: [{value: v, name: k}, {name: n}]}]}}}\n---\nkind: Service\nmetadata: {name: s}\nspec: {selector: {a: b}, ports: [{targetPort: 80}]}\n"
    files = spark.createDataFrame([("p", "k8s/x.yaml", text), ("p", "other.yaml", text)], "project string, path string, content string")
    docs = configs.parsed(files)
    assert docs.count() == 2 and {r["last"] for r in docs.collect()} == {1}
    for source in (files, docs):
        assert [r["environment"] for r in configs.manifest_services(source).collect()] == [{"k": "v"}]
        assert [r["port"] for r in configs.manifest_connections(source).collect()] == [80]
        chosen = configs.selected_workloads(source)
        assert [tuple(r) for r in chosen.collect()] == [("p", "s", "w")]
        assert "MapInArrow" not in chosen._jdf.queryExecution().optimizedPlan().toString()
    assert configs.manifest_services(files)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_rows_of_many_files_come_in_small_batches(monkeypatch):
    monkeypatch.setattr(yamlfiles, "ROWS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(9)]), pa.array(["a: 1\nb: [2, 3]\n"] * 9)], names=["path", "content"])
    out = list(yamlfiles._documents(iter([batch])))
    assert [len(b) for b in out] == [4, 4, 1]
    assert sum(len(r) for b in out for r in b["rows"].to_pylist()) == 27
