"""From files to the whole report: a small repository written out here, with the states and coverage that it is known to have."""

import json

from pyspark.sql import functions as F

from factweave.operators import entries

FILES = {
    "app.js": "const app = express();\napp.get('/health', h);\napp.get('/orders', h);\napp.post('/orders', h);\napp.get('/stats', h);\n",
    "package.json": '{"name": "shop"}',
    "prisma/schema.prisma": 'datasource db {\n  url = env("DATABASE_URL")\n}\nenum Role {\n  USER\n  ADMIN\n}\nmodel User {\n  id Int @id\n  email String\n  role Role\n  posts Post[]\n}\nmodel Post {\n  id Int @id\n  title String\n}\n',
    "docs/api.md": """# API

## Orders
<!-- fact:anchor id=api.orders binds="fact:http-endpoints/GET /orders,fact:http-endpoints/POST /orders" -->

<!-- fact:gen id=api.orders.table hash=h1:3e6d2521d46d7851 content=h1:5b3bfd02cc57a39a -->
| method | path |
|---|---|
| GET | /orders |
| POST | /orders |
<!-- /fact:gen -->

## Health
<!-- fact:gen id=api.health binds="fact:http-endpoints/GET /health" hash=h1:0000000000000000 -->
x
<!-- /fact:gen -->

<!-- fact:anchor id=api.create-item binds="fact:http-endpoints/POST /orders/{id}" -->
<!-- fact:anchor id=api.legacy binds="fact:http-endpoints/DELETE /orders" -->
""",
    "docs/data-model.md": "# Data\n\n## User\n<!-- fact:anchor id=db.user binds=fact:db-schema/User -->\n\n<!-- fact:gen id=db.user.columns hash=h1:9b93880a5563d4cc content=h1:71b1fcff71a3a1e3 -->\n| column |\n<!-- /fact:gen -->\n<!-- fact:gen id=open -->\n",
    "main.py": "from .none import router\napp = FastAPI()\napp.include_router(router)\n",
}


def test_report(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    log = spark.createDataFrame([("tombstone", "fact:http-endpoints/DELETE /orders", "2024-01-01", 1, None, None)], "type string, target string, at string, line_no int, content_hash string, of string")
    out = entries.report(files, log)
    found = {r.id: (r.doc, r.line, r.kind, r.state) for r in out["findings"].collect()}
    assert {k: v[3] for k, v in found.items()} == {"api.orders": "clean", "api.orders.table": "clean", "api.health": "stale", "api.create-item": "dead", "api.legacy": "intentionally_removed", "db.user": "clean", "db.user.columns": "tampered"}
    assert found["api.orders.table"][:3] == ("docs/api.md", 6, "gen")
    cover = {r.capability: (r.total, r.documented, r.pct) for r in out["coverage"].collect()}
    assert cover[None] == (8, 4, 50) and cover["config-surface"][:2] == (1, 0) and cover["db-schema"][:2] == (3, 1) and cover["http-endpoints"][:2] == (4, 3)
    assert {(r.file, r.reason) for r in out["gaps"].collect()} == {("main.py", "include_router target `router` not found"), ("docs/data-model.md", "is not closed")}
    e = out["envelope"].first()
    assert not e.ok and e.code == "UNREADABLE" and [t["id"] for t in json.loads(e.data)["top"]] == ["api.health", "api.create-item", "db.user.columns"]
    assert {json.loads(r.result)["level"] for r in out["sarif"].collect()} == {"error", "warning"} and out["sarif"].count() == 3
