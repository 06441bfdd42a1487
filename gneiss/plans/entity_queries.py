"""Registered queries of classes and routes: each row of `documents` is written as a source file, in several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import entities as E
from gneiss.operators import graph as G
from gneiss.plans.base import query
from gneiss.plans.config_queries import D, written

SCRIPT = """export class A{id} extends Base {
  constructor(x) {
    super(x)
  }
  async load{m}(a) {
    if (a) { return }
  }
  size () {}
}
class B {
  only() {}
}
function late (x) {}
"""
PYTHON = """class P{id}(Base):
    def __init__(self):
        pass

    async def get{m}(self): pass
x = 1
class Empty:
    pass
"""
LONG = "class L{id} {\n" + "  // line\n" * 198 + "  seen() {}\n  unseen() {}\n}\n"
_CLASSES = f"""WITH {D}, r AS (
SELECT id, unnest([{{name: 'A' || id, parent: 'Base', line: 1, methods: 'super,load' || m || ',if,size'}}, {{name: 'B', parent: NULL, line: 10, methods: 'only'}}], recursive := true) FROM d WHERE id % 3 = 0
UNION ALL SELECT id, unnest([{{name: 'L' || id, parent: NULL, line: 1, methods: 'seen'}}], recursive := true) FROM d WHERE id % 3 = 1)
SELECT 's' || id || '.ts' AS path, name, parent, line::BIGINT AS line, methods FROM r
UNION ALL SELECT 'p' || id || '.py', unnest(['P' || id, 'Empty']), unnest(['Base', NULL]), unnest([1::BIGINT, 7]), unnest(['__init__,get' || m, '']) FROM d"""


@query("class_methods", _CLASSES)
def class_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(spark, sf_dir, "s{id}.ts", SCRIPT, LONG, "no class\n").unionByName(written(spark, sf_dir, "p{id}.py", PYTHON))
    return E.class_definitions(files).withColumn("methods", F.array_join("methods", ","))


ROUTES = ("""app.get('/a{m}', requireAuth, (req, res) => { res.send(jwt) })
router.post("/b", [limit({m}, 'x,y'), checkToken],
  validate({ a: [1, 2], b: "),(" }),
  async (req, res) => {
    passport(req)
  })
server.use('/static', files)
app.delete('/open', (req) => { session(req, x) })
app.put('/cut', one,
""", "export async function POST(req) {}\nexport function helper(x) {}\nexport function GET (req) {}\n")  # fmt: skip
PY_ROUTES = "@app.route('/p{m}')\ndef f(): pass\n@router.delete(\"/q\")\n"
GO_ROUTES = "r.Get(\"/g{m}\", h)\nhttp.HandleFunc(\"/f\", h)\nr.Post('/p', h)\n"
_ROUTES = f"""WITH {D}, r AS (
SELECT id, 's' || id || '.js' AS path, unnest([{{method: 'GET', route: '/a' || m, line: 1, middleware: 'requireAuth', chain: 'requireAuth', auth: true}}, {{method: 'POST', route: '/b', line: 2, middleware: '', chain: 'limit(' || m || ', ''x,y'');checkToken;validate({{ a: [1, 2], b: "),(" }})', auth: true}},
  {{method: 'USE', route: '/static', line: 7, middleware: '', chain: '', auth: false}}, {{method: 'DELETE', route: '/open', line: 8, middleware: '', chain: '', auth: false}}, {{method: 'PUT', route: '/cut', line: 9, middleware: 'one', chain: '', auth: false}}], recursive := true) FROM d WHERE id % 2 = 0
UNION ALL SELECT id, 's' || id || '.js', unnest([{{method: 'POST', route: 's' || id || '.js', line: 1, middleware: '', chain: '', auth: false}}, {{method: 'GET', route: 's' || id || '.js', line: 3, middleware: '', chain: '', auth: false}}], recursive := true) FROM d WHERE id % 2 = 1
UNION ALL SELECT id, 'p' || id || '.py', unnest([{{method: 'ROUTE', route: '/p' || m, line: 1, middleware: '', chain: '', auth: false}}, {{method: 'DELETE', route: '/q', line: 3, middleware: '', chain: '', auth: false}}], recursive := true) FROM d
UNION ALL SELECT id, 'g' || id || '.go', unnest([{{method: 'GET', route: '/g' || m, line: 1, middleware: '', chain: '', auth: false}}, {{method: 'ALL', route: '/f', line: 2, middleware: '', chain: '', auth: false}}, {{method: 'POST', route: '/p', line: 3, middleware: '', chain: '', auth: false}}], recursive := true) FROM d)
SELECT path, method, route, line::BIGINT AS line, middleware, chain, auth AS has_auth, CASE WHEN NOT auth AND method IN ('POST', 'DELETE', 'PUT') THEN 'high' WHEN NOT auth THEN 'medium' ELSE 'low' END AS risk FROM r"""


@query("route_middleware", _ROUTES)
def route_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(spark, sf_dir, "s{id}.js", *ROUTES).unionByName(written(spark, sf_dir, "p{id}.py", PY_ROUTES)).unionByName(written(spark, sf_dir, "g{id}.go", GO_ROUTES))
    found = G.endpoints(E.route_definitions(files))
    return found.select("path", "method", "route", "line", F.array_join("middleware", ";").alias("middleware"), F.array_join("chain", ";").alias("chain"), "has_auth", "risk")
