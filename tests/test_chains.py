"""Replays through renames, lexed SQL, globs, workspaces, imports and overlays, on literal rows and against plain Python."""

import json
import random
import re

from factweave.functions.text import glob_to_regex
from factweave.operators import globs, graph, imports, overlays, policies, replay, workspaces

FIRST = """-- first; it's a comment
create table orders (id serial primary key, note text default ';');
create table notes (id serial primary key);
alter table orders enable row level security; alter table notes enable row level security;
/* a ; and 'quote */ create policy orders_own on orders
  for select to authenticated
  using (auth.uid() = user_id and note <> 'to be; or (not');
create policy notes_all on notes for all to authenticated using (true);
create function f() returns int as $body$ begin; create policy fake on orders using (true); end $body$ language sql;
"""
SECOND = """drop policy if exists notes_all on notes;
create policy "notes rw" on "public"."notes" as restrictive for all to b, "a" using (a(b(c))) with check ( x
   > 1 );
create policy gone on app.t using (true);
alter policy orders_own on orders rename to orders_mine;
alter policy orders_mine on orders to admin, authenticated;
alter table orders rename to purchases;
alter policy orders_mine on purchases using (n > 2);
alter table app.t set schema old; drop table old.t;
alter table purchases disable row level security;
create policy late on notes for insert with check (true)"""


def test_policies(spark):
    files = spark.createDataFrame([("db/migrations/0001.sql", FIRST), ("db/migrations/0002.sql", SECOND), ("queries.sql", "create policy x on y using (true)"), ("sql/empty.sql", ""), ("sql/none.sql", None)], "path string, content string")
    stmts = policies.statements(files.where(policies.in_migrations(files.path)))
    left, secured = policies.replayed(stmts)
    a, b = "db/migrations/0001.sql", "db/migrations/0002.sql"
    assert sorted(map(tuple, left.collect())) == [
        ("public", "notes", "late", "INSERT", True, ["public"], None, "true", b),
        ("public", "notes", "notes rw", "ALL", False, ["a", "b"], "a(b(c))", "x > 1", b),
        ("public", "purchases", "orders_mine", "SELECT", True, ["admin", "authenticated"], "n > 2", None, b),
    ]
    assert sorted(map(tuple, secured.collect())) == [("public", "notes", True, a), ("public", "purchases", False, b)]
    none = policies.replayed(policies.statements(files.limit(0)))
    assert none[0].count() == 0 and none[1].count() == 0


def plain_lives(events, implied):
    """Row by row: what each name means."""
    now, about, seen = {}, {}, set()
    for at, op, key, target in sorted(events):
        if implied and key not in seen and key not in now:
            now[key] = ("start", key)
        seen.add(key)
        if op == "make" or (op == "found" and now.get(key) is None):
            now[key] = ("made", at)
        about[at] = now.get(key)
        if op == "drop":
            now[key] = None
        if op == "rename" and key != target:
            now[target] = now.get(key)
            seen.add(target)
            now[key] = None
    return about, {(v, k) for k, v in now.items() if v}


def test_lives_equal_a_row_loop(spark):
    for seed, implied in ((1, False), (2, True), (3, True)):
        rng = random.Random(seed)
        events = [(i, rng.choice(["make", "found", "rename", "rename", "drop", "say", "say"]), rng.choice("abcdefgh"), rng.choice("abcdefgh")) for i in range(120)]
        about, _ = plain_lives(events, implied)
        while any(op == "rename" and about[at] is None for at, op, _, _ in events):  # only what is there is renamed
            events = [(at, "say" if op == "rename" and about[at] is None else op, k, t) for at, op, k, t in events]
            about, _ = plain_lives(events, implied)
        df = spark.createDataFrame(events, "at long, op string, key string, target string")
        things, left = replay.lives(df, implied)
        call = lambda t: None if t is None else ("start", t.first) if t["at"] is None else ("made", t["at"])
        about, rest = plain_lives(events, implied)
        assert {r["at"]: call(r.thing) for r in things.collect()} == about
        assert {(call(r.thing), r.key) for r in left.collect()} == rest


def test_beginnings(spark):
    links = [("a", "a"), *((f"n{i}", f"n{i - 1}" if i else "a") for i in range(20)), ("x", "y"), ("y", "x"), ("lost", "nowhere"), ("none", None)]
    df = spark.createDataFrame(links, "node string, parent string")
    got = {r.node: r.root for r in graph.beginnings(df).collect()}
    assert all(got[f"n{i}"] == "a" for i in range(20)) and got["a"] == "a" and {got[k] for k in ("x", "y", "lost", "none")} == {None}
    short = {r.node: r.root for r in graph.beginnings(df, 6).collect()}
    assert [k for k, v in short.items() if v] == ["a", *(f"n{i}" for i in range(6))]
    assert graph.beginnings(df.limit(0)).count() == 0


GLOBS = ["*", "**", "a/*", "a/**", "a/**/b", "**/b", "**/*.js", "a/", "./a/b", "{a,b}/*", "a/{b,c/d}/*.js", "a/**/**/b", "?/b", "x*y/?", "a.b", "a+(b)/*", "**/a/**", "a/b.js", "", "nothing/*"]


def test_globs_equal_regular_expressions(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d", "b.js", "a.b", "axb", "xy", "x1y", "a+(b)", "q.ts"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(250)}
    got = {tuple(r) for r in globs.matches(spark.createDataFrame([(p,) for p in paths] + [(None,), ("",)], "path string"), spark.createDataFrame([(g,) for g in GLOBS], "glob string")).collect()}
    want = {(g, p) for g in GLOBS if g for p in paths if re.fullmatch(glob_to_regex(g.removeprefix("./"))[1:-1], p)}
    assert got == want and len(want) > 300


def test_selected(spark):
    paths = spark.createDataFrame([("packages/a",), ("packages/b",), ("apps/c",)], "path string")
    rows = [("one", "packages/*"), ("one", "!packages/b"), ("two", "**"), ("two", "!apps/**"), ("three", "!x")]
    got = {tuple(r) for r in globs.selected(paths, spark.createDataFrame(rows, "set string, glob string")).collect()}
    assert got == {("one", "packages/a"), ("two", "packages/a"), ("two", "packages/b")}


def test_layout(spark):
    files = [
        ("r/one", "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - \"!packages/skip\"\n  - apps/**\nother: 1\n"),
        ("r/one", "package.json", '{"name": "top", "workspaces": ["ignored/*"]}'),
        ("r/one", "packages/a/package.json", '{"name": "@x/a"}'),
        ("r/one", "packages/skip/package.json", "{}"),
        ("r/one", "packages/py/pyproject.toml", '[project]\nname = "py"'),
        ("r/one", "apps/deep/er/package.json", "{}"),
        ("r/one", "ignored/z/package.json", "{}"),
        ("two", "package.json", '{"workspaces": {"packages": ["libs/*"]}}'),
        ("two", "libs/b/package.json", "not json"),
        ("two", "libs/b/pyproject.toml", '[tool]\nname = "no"\n[project]\nversion = "1"\nname = "bee"\n'),
        ("go", "go.mod", "// x\nmodule example.org/team/tool\n"),
        ("java", "pom.xml", "<project><parent><artifactId>up</artifactId></parent><artifactId>own</artifactId></project>"),
        ("bad", "package.json", "{"),
        ("none", "package.json", '{"name": "n", "workspaces": []}'),
        ("plain/dir", "src/a.py", None),
    ]
    packages, wrong = workspaces.layout(spark.createDataFrame(files, "root string, path string, content string"))
    assert sorted(map(tuple, packages.collect()), key=str) == [
        ("bad", "single", "package.json", "bad", "."),
        ("go", "single", "go.mod", "tool", "."),
        ("java", "single", "pom.xml", "own", "."),
        ("none", "single", "package.json", "n", "."),
        ("plain/dir", "single", None, "dir", "."),
        ("r/one", "pnpm", "pnpm-workspace.yaml", "@x/a", "packages/a"),
        ("r/one", "pnpm", "pnpm-workspace.yaml", "er", "apps/deep/er"),
        ("two", "npm-yarn", "package.json", "bee", "libs/b"),
    ]
    assert sorted(map(tuple, wrong.collect())) == [
        ("bad", "workspace-manifest-unparsed", "package.json"),
        ("none", "workspace-no-packages-declared", "package.json"),
        ("r/one", "workspace-member-unresolved", "apps/deep"),
        ("r/one", "workspace-member-unresolved", "packages/py"),
    ]


PYTHON = {
    "main.py": "from fastapi import FastAPI\nfrom .api import items, users as people\nfrom api.deep import router as far\nfrom .lost import gone\napp = FastAPI()\napp.include_router(items.router, prefix=\"/v1\")\napp.include_router(people.router)\napp.include_router(far)\napp.include_router(gone)\n@app.get(\"/\")\n",
    "api/__init__.py": "",
    "api/items.py": "router = APIRouter(prefix=\"/items\")\n@router.get(\"/{id}\")\n@router.post('')\n",
    "api/users.py": "from .inner.people import router\n",
    "api/inner/people.py": "from ..made import maker as router\n",
    "api/made.py": "maker = APIRouter(prefix='/people')\n@maker.delete('/x')  # gone soon\n",
    "api/deep.py": "from .d1 import router\n",
    **{f"api/d{i}.py": f"from .d{i + 1} import router\n" for i in range(1, 7)},
    "api/d7.py": "router = APIRouter()\n@router.get('/deep')\n",
    "api/test_x.py": "app = FastAPI()\n@app.get('/test')\n",
}


def test_python_routes(spark):
    lines = spark.createDataFrame([(p, i + 1, t) for p, s in PYTHON.items() for i, t in enumerate(s.split("\n"))], "path string, line int, text string")
    routes, gaps = imports.python_routes(lines)
    assert {tuple(r) for r in routes.collect()} == {("GET", "/", "main.py"), ("GET", "/v1/items/{id}", "api/items.py"), ("POST", "/v1/items", "api/items.py"), ("DELETE", "/people/x", "api/made.py"), ("GET", "/deep", "api/d7.py")}
    assert {tuple(r) for r in gaps.collect()} == {("main.py", "include_router target `gone` not found"), ("main.py", "include_router target `far` not found")}


def overlay(low, high):
    """Plain merge of trees: maps are merged, anything else is replaced, null takes away."""
    out = dict(low)
    for k, v in high.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = overlay(out[k], v)
        else:
            out[k] = v
    return out


def flat(tree, up=""):
    for k, v in tree.items():
        if isinstance(v, dict) and v:
            yield from flat(v, f"{up}{k}.")
        elif v is not None:
            yield f"{up}{k}", json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)


def test_overlays_equal_a_plain_merge(spark):
    rng = random.Random(6)

    def tree(depth):
        return {rng.choice("abc"): tree(depth - 1) if depth and rng.random() < 0.5 else rng.choice([1, "x", None, [1, 2]]) for _ in range(rng.randint(1, 3))}

    charts = {f"c{i}": [tree(3) for _ in range(3)] for i in range(40)}
    rows = [(c, n, json.dumps(t, separators=(",", ":"))) for c, layers in charts.items() for n, t in enumerate(layers)] + [("bad", 0, "{"), ("none", 0, None)]
    left = overlays.overlaid(overlays.leaves(spark.createDataFrame(rows, "chart string, layer int, content string")))
    got = {tuple(r) for r in left.collect()}
    want = set()
    for c, (a, b, d) in charts.items():
        want |= {(c, k, v) for k, v in flat(overlay(overlay(a, b), d))}
    assert got == want and len(want) > 60


def test_filled_and_services(spark):
    values = [("web", "name", "shop"), ("web", "image.tag", "{{ .Values.version }}-r1"), ("web", "version", "2"), ("web", "x", "{{ .Values.y }}"), ("web", "y", "{{ .Values.x }}"), ("web", "port", "80")]
    text = """{{- if .Values.on }}
kind: Deployment
metadata:
  labels: {}
  name: {{ .Values.name }}
spec:
  containers:
    - image: "repo/{{ .Chart.Name }}:{{.Values.image.tag}}"
---
kind: Service
metadata:
  name: {{ .Values.name }}
spec:
  ports:
    - port: {{ .Values.port }}
    - port: {{ .Values.none }}
{{- end }}
---
kind: ConfigMap
metadata:
  name: {{ .Values.x }} {{ required "no" }}
"""
    texts = spark.createDataFrame([("web/templates/a.yaml", "web", text), ("web/templates/job.yaml", "web", "kind: Job\nspec: 1"), ("web/templates/plain.yaml", "web", "kind: Service\nmetadata:\n  name: db\nports:\n - port: 5432")], "id string, chart string, text string")
    out, gaps = overlays.filled(texts, spark.createDataFrame(values, "chart string, path string, value string"), spark.createDataFrame([("web", "web", "1.0")], "chart string, name string, version string"))
    assert {tuple(r) for r in gaps.collect()} == {("web/templates/a.yaml", r) for r in ("template control flow - the rendered set is install-dependent", "undeclared value .Values.none", "undeclared value .Values.x", 'unresolved template expression: required "no"')}
    got = sorted(map(tuple, overlays.services(out).collect()))
    assert got == [("web", "db", "external", None, ["5432"]), ("web", "job", "owned", None, []), ("web", "shop", "owned", "repo/web:2-r1", ["80", "<unknown:.Values.none>"])]
    assert overlays.filled(texts.limit(0), spark.createDataFrame([], "chart string, path string, value string"), spark.createDataFrame([], "chart string, name string, version string"))[0].count() == 0
