"""Shapes of facts, sections, and entry points, on rows written out here."""

import json

from pyspark.sql import functions as F

from factweave.operators import entries, render, shapes


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_shapes(spark):
    row = {
        "endpoint": ("method string, path string", ("GET", "/a"), "fact:http-endpoints/GET /a"),
        "env-var": ("name string, read_in_code boolean, declared_in_example boolean", ("A_B", True, False), "fact:config-surface/A_B"),
        "package": ("name string, path string, manager string", ("web", "apps/web", "npm"), "fact:workspace-layout/web"),
        "service": ("name string, kind string, ports array<string>, depends_on array<string>", ("db", "external", ["1"], []), "fact:services-topology/db"),
        "module": ("path string, package string, imports array<string>", ("a.ts", "web", ["b.ts"]), "fact:module-graph/a.ts"),
        "symbol": ("name string, module string, package string, kind string, sigs array<string>", ("f", "a.ts", None, "function", ["f ( )"]), "ds . . a.ts/f()."),
        "churn": ("path string, commits int, last string, authors int", ("a", 1, "2024", 1), "fact:decision-history/a"),
        "policy": ("schema string, table string, name string, command string, permissive boolean", ("s", "t", "p", "all", True), "fact:db-policies/policy.s.t.p"),
        "rls": ("schema string, table string, enabled boolean", ("s", "t", False), "fact:db-policies/rls.s.t"),
        "route": ("path string", ("/x/[id]",), "fact:client-routes//x/[id]"),
        "channel": ("name string, kind string, transport string, role string, pattern string", ("n", "topic", "kafka", "both", "n"), "fact:async-messaging/topic.n"),
        "table": ("name string, columns array<struct<name:string,type:string>>, relations array<string>", ("public.t", [("id", "int")], []), "fact:db-schema/public.t"),
        "enum": ("name string, values array<string>", ("e", ["x"]), "fact:db-schema/enum.e"),
        "function": ("name string, signature string, returns string", ("s.f", "int", "int"), "fact:db-schema/fn.s.f(int)"),
        "pk": ("table string, constraint string, columns array<string>", ("s.t", "k", ["id"]), "fact:db-schema/pk.s.t"),
        "view": ("name string, materialized boolean, columns array<string>", ("s.v", False, ["a"]), "fact:db-schema/view.s.v"),
    }
    assert set(row) == set(shapes.SHAPES)
    for kind, (schema, values, id_) in row.items():
        got = shapes.facts_of(frame(spark, schema, values), kind).first()
        payload = json.loads(got.payload)
        assert got.id == id_ and got.type == kind and payload["type"] == kind and payload["schema_version"] == 1 and set(payload["attrs"]) == {c.split()[0] for c in schema.split(", ")}, kind
        assert list(payload["attrs"]) == sorted(payload["attrs"]) and got.capability == ("module-graph" if kind == "symbol" else id_[5:].split("/")[0])
    kinds = frame(spark, "k string", ("async function",), ("enum",), ("const",)).select(shapes.suffix(F.col("k")).alias("s"))
    assert [r.s for r in kinds.collect()] == ["().", "#", "."]
    live = frame(spark, "schema string, table string", ("public", "Users"), ("audit", "users"), ("public", "x"))
    assert {tuple(r) for r in shapes.not_declared(live, frame(spark, "name string", ("users",))).collect()} == {("audit", "users"), ("public", "x")}


def test_sections(spark):
    env = frame(spark, "name string, read_in_code boolean, declared_in_example boolean, sites array<string>", ("B", True, False, ["a:1", "b:2", "c:3", "d:4"]), ("A", False, True, []))
    assert render.body("env-var", env).first().body.split("\n")[1:] == ["|---|---|---|---|", "| `A` | no | yes | - |", "| `B` | yes | no | a:1, b:2, c:3 |"]
    views = frame(spark, "name string, materialized boolean, columns array<string>, insertable boolean, updatable boolean, deletable boolean", ("v", False, ["a", "b|c"], True, False, True))
    assert render.body("view", views).first().body.endswith("| `v` | view | `a`, `b\\|c` | GET, POST, DELETE |")
    rls = frame(spark, "schema string, table string, enabled boolean", ("s", "t", False))
    assert render.body("rls", rls).first().body == "- RLS **disabled** on `s.t`"
    services = frame(spark, "name string, kind string, image string, build string, ports array<int>, depends_on array<string>", ("web-app", "owned", None, ".", [80], ["db"]), ("db", "external", "pg:16", None, [], []))
    assert render.body("service", services).first().body.split("\n")[2:] == ["| `db` | external | `pg:16` | - | - | - |", "| `web-app` | owned | - | `.` | 80 | db |"]
    assert render.services_diagram(services).first().body == '```mermaid\nflowchart LR\n  db[("db")]\n  web_app["web-app"]\n  web_app --> db\n```'
    assert render.body("enum", frame(spark, "name string, values array<string>", ("e", ["x", "y"]))).first().body == "- `e`: x, y"
    assert render.body("package", frame(spark, "name string, path string, manager string", ("b", "z", "npm"), ("a", "y", None))).first().body.split("\n")[2:] == ["| `a` | `y` | - |", "| `b` | `z` | npm |"]


def test_entry_points(spark):
    endpoints = shapes.facts_of(frame(spark, "method string, path string", ("GET", "/a"), ("POST", "/b")), "endpoint")
    churn = shapes.facts_of(frame(spark, "path string, commits int, last string, authors int", ("a", 1, "2024", 1)), "churn")
    facts = endpoints.unionByName(churn)
    docs = frame(spark, "doc string, text string", ("d.md", '<!-- fact:anchor id=a binds="fact:http-endpoints/GET /a" -->\n<!-- fact:anchor id=b binds="fact:http-endpoints/GET /b" -->\n<!-- fact:gen id=open -->'))
    log = frame(spark, "type string, target string, at string, line_no int, content_hash string, of string", ("snooze", "b", "2024-01-01", 1, None, None), ("revoke", "b", "2024-01-02", 2, None, "snooze"), ("applied", "b", "2024-01-03", 3, None, None), ("rejection", "b", "2024-01-03", 4, "h1:0", None))
    out = entries.check(docs, facts, log)
    assert {(r.id, r.state) for r in out["findings"].collect()} == {("a", "clean"), ("b", "dead")}
    assert {(r.capability, r.total, r.documented, r.pct) for r in out["coverage"].collect()} == {("http-endpoints", 2, 1, 50), (None, 2, 1, 50)}
    assert [tuple(r) for r in out["gaps"].collect()] == [("d.md", 3, "is not closed")] and out["envelope"].first().code == "UNREADABLE"
    todo = entries.sync(out["findings"], facts.select("id"), frame(spark, "id string")).collect()
    assert [(r.id, r.repair, r.candidate) for r in todo] == [("b", "rebind", "fact:http-endpoints/POST /b")]
    assert {tuple(r) for r in entries.init(facts, frame(spark, "id string", ("fact:http-endpoints/GET /a",))).collect()} == {("http-endpoints", 2, 1)}
    assert entries.noise(log, "2024-01-04").first().asDict() == {"applied": 1, "rejected": 1, "decided": 2, "accept_rate": 0.5}
    asked = entries.interview(frame(spark, "kind string, subject string, rank int", ("removal", 'r"1', 1), ("document", "d", 1)), frame(spark, "qid string, verdict string"), 1)
    assert [(r.subject, r.open) for r in asked.collect()] == [('r"1', 2)]
    assert entries.queue(asked).first().line.endswith('    kind: removal\n    subject: "r\\"1"')
    mined = entries.mine(frame(spark, "sha string, subject string, files array<string>", ("1", "Fix the crash", ["a", "b"]), ("2", "limit memory", ["a"]), ("3", "prefix only text", ["a"]))).collect()
    assert [(r.sha, r.file, r.score) for r in mined] == [("1", "a", 8), ("2", "a", 4)]
