"""Extraction, claims, repairs and rendering on a small repository written out here."""

from factweave.operators import claims, extract, policies, render, repair

CODE = {
    "src/app.js": "const app = express()\nconst api = require('./routes/api')\nconst own = Router()\napp.use('/v1', api)\napp.use('/v2', api)\napp.get('/health', h)\napp.use('/own', own)\nown.delete('/x/', h)\nprocess.env.PORT + process.env.API_KEY",
    "src/routes/api.js": "const r = express.Router()\nr.get('/', list)\nr.post('/:id', make)\nmodule.exports = r\nconst loop = Router()\nloop.use('/l', loop)\nk.send({ topic: `order.${id}`, m })",
    "src/lone.js": "x.patch('/alone', h)\nk.subscribe({ topics: ['order.{}'] })\nbus.publish('news', 1)",
    "main.py": "os.environ['PORT'] or os.getenv(\"HOME_DIR\")",
    "config/env.example": "PORT=1\n# NO=1\nUNUSED = 2",
    "app/(site)/users/[id]/page.tsx": "",
    "app/page.tsx": "",
    "app/users/[id]/page.js": "",
    "package.json": '{"name": "root"}',
    "pkg/a/package.json": "{}",
    "db/2.sql": "create policy \"a b\" on public.t for select using (true); drop policy p on t; alter table t disable row level security;",
    "db/1.sql": "-- create policy no on t;\nCREATE POLICY p ON t; alter table only t enable row level security; create policy q on s.u for insert",
}


def files(spark):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in CODE.items()], "path string, content binary")


def test_env_names(spark):
    got = {r.name: (r.read_in_code, r.declared, [s.path for s in r.sites]) for r in extract.env_names(extract.lines(files(spark))).collect()}
    assert got == {"PORT": (True, True, ["config/env.example", "main.py", "src/app.js"]), "API_KEY": (True, False, ["src/app.js"]), "HOME_DIR": (True, False, ["main.py"]), "UNUSED": (False, True, ["config/env.example"])}


def test_channels(spark):
    got = {(r.name, r.transport): (r.role, r.files) for r in extract.channels(extract.lines(files(spark))).collect()}
    assert got == {("order.{}", "kafka"): ("both", 2), ("news", "redis"): ("producer", 1)}


def test_endpoints_under_every_mount(spark):
    got = {(r.method, r.route) for r in extract.endpoints(extract.lines(files(spark))).collect()}
    assert got == {("GET", "/health"), ("DELETE", "/own/x"), ("GET", "/v1"), ("GET", "/v2"), ("POST", "/v1/:id"), ("POST", "/v2/:id"), ("PATCH", "/alone")}


def test_routes_packages_policies(spark):
    f = files(spark)
    assert {(r.route, r.path) for r in extract.page_routes(f).collect()} == {("/", "app/page.tsx"), ("/users/:id", "app/(site)/users/[id]/page.tsx")}
    assert {(r.name, r.path) for r in extract.packages(f).collect()} == {("root", "."), ("pkg/a", "pkg/a")}
    left, secured = policies.replayed(policies.statements(f.where("path like '%.sql'")))
    assert {(r.schema, r.table, r.name, r.command) for r in left.collect()} == {("public", "t", "a b", "SELECT"), ("s", "u", "q", "INSERT")}
    assert [(r.schema, r.table, r.enabled) for r in secured.collect()] == [("public", "t", False)]


def test_churn(spark):
    log = spark.createDataFrame([("1", "a", "2024-05-01", "x"), ("2", "b", "2024-06-01", "x"), ("3", "a", "2022-01-01", "x")], "sha string, author string, at string, path string")
    assert [tuple(r) for r in extract.churn(log, "2024-06-02").collect()] == [("x", 2, "2024-06-01", 2)]


def test_claims(spark):
    doc = ["# Use", "See `src/app.js` and `src/gone.js`, `lib/{a,b}.js`.", "[here](../main.py) [there](nope.md#x) [out](https://x.y)", "Run npm run build, npm run test; `make all`.", "Set `PORT` and `NO_SUCH`, `API_KEY`.", "GET /v1/{id} works; POST /v1/:id too, DELETE /none.", "# Removed files", "`old/file.js`"]
    lines = spark.createDataFrame([("docs/a.md", i + 1, t) for i, t in enumerate(doc)], "doc string, line int, text string")
    known = [("file", p) for p in CODE] + [("script", "test"), ("make", "all"), ("env", "API_KEY"), ("route", "POST /v1/{}")]
    made = claims.claims(lines)
    got = {(r["class"], r.claim) for r in claims.unsupported(made, spark.createDataFrame(known, "class string, key string")).collect()}
    assert got == {("file", "src/gone.js"), ("link", "nope.md"), ("script", "build"), ("env", "NO_SUCH"), ("route", "GET /v1/{id}"), ("route", "DELETE /none")}
    assert {r.claim for r in made.where("suppressed").collect()} == {"lib/{a,b}.js", "old/file.js"} - {"lib/{a,b}.js"} | {r.claim for r in made.where("suppressed and class = 'file' and line = 2").collect()}


def test_proposals_and_cards(spark):
    rows = [("a", "slot", "stale"), ("b", "gen", "stale"), ("c", "gen", "tampered"), ("d", "gen", "unverified"), ("e", "anchor", "dead"), ("f", "anchor", "dead"), ("g", "gen", "clean")]
    found = spark.createDataFrame(rows, "id string, kind string, state string")
    near = spark.createDataFrame([("e", "x", 1), ("e", "y", 2)], "id string, candidate string, place int")
    got = {r.id: (r.repair, r.candidate) for r in repair.proposals(found, near, spark.createDataFrame([("b",), ("c",)], "id string")).collect()}
    assert got == {"a": ("reprose", None), "b": ("regenerate", None), "c": ("restore", None), "d": ("unrenderable", None), "e": ("rebind", "x"), "f": ("tombstone", None)}
    asked = spark.createDataFrame([("document", "s1", 1), ("removal", "r1", 1), ("removal", "r2", 2), ("removal", "r1", 3), ("rationale", "c1", 1)], "kind string, subject string, rank int")
    first = repair.cards(asked, spark.createDataFrame([], "qid string, verdict string")).orderBy("place").collect()
    assert [r.subject for r in first] == ["r1", "r2", "c1", "s1"] and all(len(r.qid) == 15 for r in first)
    said = spark.createDataFrame([(first[0].qid, "unknown"), (first[2].qid, "confirm")], "qid string, verdict string")
    assert [r.subject for r in repair.cards(asked, said).orderBy("place").collect()] == ["r2", "r1", "s1"]


def test_upgrade_and_bodies(spark):
    recipe = spark.createDataFrame([("d", "one", ["a"], 1), ("d", "two", ["b", "c"], 2), ("d", "three", ["e"], 3)], "doc string, section string, ids array<string>, place int")
    got = repair.upgrade(recipe, spark.createDataFrame([("d", "c")], "doc string, id string")).collect()
    assert {tuple(r) for r in got} == {("d", "one", None), ("d", "three", "two")}
    rows = spark.createDataFrame([("r", 2, "b|c", None), ("r", 1, "a", 5)], "region string, o int, name string, n int")
    assert render.table(rows, "region", "o", ["name", "n"]).first().body == "| name | n |\n|---|---|\n| a | 5 |\n| b\\|c |  |"
    links = spark.createDataFrame([(1, "a.b", "c", 'x"y')], "chunk int, from string, to string, field string")
    assert render.diagram(links).first().body == "erDiagram\n  a_b }o--|| c : \"x'y\""


def test_literals_screen_without_losing_rows(spark):
    """Patterns run on the texts that hold their literals only; the rows are the same."""
    from pyspark.sql import functions as F

    assert extract.literal_of(r"\.sendToQueue\(\s*x") == ".sendToQueue(" and extract.literal_of(r"process\.env\.([A-Z]+)") == "process.env." and extract.literal_of(r"\bx") is None and extract.literal_of("abcd?e") == "abc"
    rows = extract.lines(files(spark))
    for p in [*extract.ENV_READS, *(r.pattern for r in extract.CHANNEL_RULES)]:
        both = rows.select(extract.found(F.col("text"), p).alias("a"), extract.screened(F.col("text"), p).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    plain = [r for r in extract.CHANNEL_RULES if extract.literal_of(r.pattern)]
    assert len(plain) > 4 and "Contains(text" in extract.channels(rows, tuple(plain))._jdf.queryExecution().toString() or "contains(" in extract.channels(rows, tuple(plain))._jdf.queryExecution().toString().lower()


def test_prefixes_meet_whole(spark):
    """Two hundred thousand ids that begin alike: no key of the join holds more than its own prefix's facts."""
    from pyspark.sql import functions as F

    from factweave.operators import binds

    ids = spark.range(200_000).select(F.concat(F.lit("fact:cap"), F.col("id") % 7, F.lit("/"), "id").alias("id"))
    asked = spark.createDataFrame([("fact:cap1/1",), ("fact:cap3/99",), ("fact:none/",), ("fact:cap6/123456",), (None,)], "prefix string")
    got = {r.prefix: r["count"] for r in binds.by_prefix(asked, ids).groupBy("prefix").count().collect()}
    every = [f"fact:cap{i % 7}/{i}" for i in range(200_000)]
    assert got == {p: n for p in ("fact:cap1/1", "fact:cap3/99", "fact:cap6/123456") if (n := sum(x.startswith(p) for x in every))}
