"""The whole check on rows written out here, closures of any depth, and facts of frameworks."""

import json

import pytest
from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.operators import claims, evaluate, frameworks, graph, normalise, rank, report
from factweave.sources import markers, repository

DOC = """# A
<!-- fact:anchor id=a binds=fact:x/1,fact:x/9 -->
<!-- fact:anchor id=b binds=fact:x/* -->
<!-- fact:anchor id=c binds=pkg:web#x/* -->
<!-- fact:anchor id=c.gone binds=pkg:none#x/* -->
<!-- fact:gen id=b.g hash={both} content={body} -->
text
<!-- /fact:gen -->
<!-- fact:gen id=t hash={one} content=h1:00 binds=fact:x/1 -->
text
<!-- /fact:gen -->
<!-- fact:slot id=empty binds=fact:x/1 -->
<!-- /fact:slot -->
<!-- fact:slot id=old hash=h1:11 binds=fact:x/1 -->
<!-- /fact:slot -->
<!-- fact:slot id=held hash=h1:11 binds=fact:x/2 -->
<!-- /fact:slot -->
<!-- fact:anchor id=bad binds=fact:y/1 -->
<!-- fact:anchor id=dead binds=fact:x/8 -->
<!-- fact:anchor id=asleep binds=fact:x/8 -->
"""


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_check_from_documents_to_envelope(spark, tmp_path):
    facts = frame(spark, "id string, name string", ("fact:x/1", "a"), ("fact:x/2", "b")).select("id", canon.full_hash(F.col("name")).alias("hash"))
    hashes = {r.id: r.hash for r in facts.collect()}
    pair = facts.agg(canon.aggregate_hash(F.collect_list(F.struct("id", "hash"))).alias("h")).first().h
    body = spark.range(1).select(canon.full_hash(F.lit("text")).alias("h")).first().h
    text = DOC.format(both=pair[:19], one=hashes["fact:x/1"][:19], body=body[:19])
    found = markers.markers(frame(spark, "doc string, text string", ("d.md", text))).where("reason is null")
    log = frame(spark, "type string, target string, content_hash string", ("tombstone", "fact:x/9", None), ("snooze", "asleep", None), ("rejection", "held", hashes["fact:x/2"][:19]), ("rejection", "old", "h1:22"))
    owned = frame(spark, "id string, package string, capability string", ("fact:x/2", "web", "x"))
    states = evaluate.findings(found, facts, log, frame(spark, "capability string", ("y",)), owned)
    got = {r.id: (r.state, r.missing) for r in states.collect()}
    assert got == {
        "a": ("intentionally_removed", ["fact:x/9"]), "b": ("clean", []), "c": ("clean", []), "c.gone": ("dead", ["pkg:none#x/*"]), "b.g": ("clean", []), "t": ("tampered", []),
        "old": ("stale", []), "held": ("held", []), "bad": ("unresolvable", []), "dead": ("dead", ["fact:x/8"]), "asleep": ("snoozed", ["fact:x/8"]),
    }
    ratio = frame(spark, "total long, documented long, pct long", (2, 2, 100))
    row = evaluate.envelope(states, ratio).first()
    assert (row.ok, row.code, row.truncated) == (False, "DRIFT_FOUND", True) and row.summary == "4 drift finding(s) [stale 1, dead 2, tampered 1]; 3 clean; 2/2 surfaces documented (100%)"
    assert [t["id"] for t in json.loads(row.data)["top"]] == ["c.gone", "t", "old", "dead"]
    assert evaluate.envelope(states, ratio, frame(spark, "doc string", ("x",))).first().code == "UNREADABLE"
    short = evaluate.envelope(states, ratio, most=100).first()
    assert short.truncated and len(json.loads(short.data)["top"]) == 4
    assert evaluate.envelope(states.limit(0), ratio).first().code == "CLEAN"
    evaluate.write_report(states, str(tmp_path / "report"))
    assert [r.id for r in evaluate.in_order(spark.read.json(str(tmp_path / "report"))).collect()][:2] == ["a", "b"]
    assert evaluate.unscanned(found, frame(spark, "doc string", ("other.md",))).first().asDict() == {"doc": "d.md", "anchors": 7, "regions": 5}
    changed = evaluate.classify(states.where("state = 'dead'"), frame(spark, "kind string, id string, doc string, line int, fact string", ("anchor", "dead", "d.md", 19, "fact:x/8")), frame(spark, "doc string"), frame(spark, "fact string", ("fact:x/8",)))
    assert {r.id: r.self_caused for r in changed.collect()} == {"dead": True, "c.gone": False}


def test_closures_of_any_depth_and_width(spark):
    nodes = [f"n{i}" for i in range(41)]
    chain = frame(spark, "parent string, child string, part string", *[(a, b, "/" + b) for a, b in zip(nodes, nodes[1:])], ("n5", "n2", "/back"))
    roots = frame(spark, "node string, path string", ("n0", ""))
    got = graph.prefixes(roots, chain).collect()
    assert max(r.depth for r in got) == 40 and len(got) == 41
    with pytest.raises(ValueError, match="more than 10"):
        graph.prefixes(roots, chain, limit=10)


def test_closure_of_many_children(spark):
    wide = spark.range(1_500_000).select(F.lit("r").alias("parent"), F.concat(F.lit("c"), "id").alias("child"), F.lit("/").alias("part"))
    assert graph.prefixes(frame(spark, "node string, path string", ("r", "")), wide).count() == 1_500_001


def test_sweeps(spark):
    names, needs = frame(spark, "name string", ("a",), ("b",), ("c",), ("d",)), frame(spark, "name string, need string", ("a", "c"), ("b", "a"), ("c", "d"))
    assert [r.name for r in graph.sweeps(names, needs).orderBy("sweep", "name").collect()] == ["d", "c", "a", "b"]
    with pytest.raises(ValueError, match="circle"):
        graph.sweeps(names, needs.union(frame(spark, "name string, need string", ("d", "b"))))
    with pytest.raises(ValueError, match="nothing provides z"):
        graph.sweeps(names, frame(spark, "name string, need string", ("a", "z")))


def test_routes_as_blocks(spark):
    text = ["# routes", "namespace :api do", "  resources :users, only: [:index, :show] do", "    get 'stats'", "  end", "  resource :me, except: %i[destroy new edit]", "end", "root 'home#x'", "scope '/v1' do", "  post '/up'", "  delete 'down/'", "end"]
    got = {(r.method, r.path) for r in frameworks.resource_lines(frame(spark, "file string, line int, text string", *[("r.rb", n, t) for n, t in enumerate(text)])).collect()}
    assert got == {
        ("GET", "/api/users"), ("GET", "/api/users/:id"), ("GET", "/api/users/:id/stats"), ("POST", "/api/me"), ("GET", "/api/me"), ("PATCH", "/api/me"), ("PUT", "/api/me"),
        ("GET", "/"), ("POST", "/up"), ("DELETE", "/v1/down"),
    }


def test_include_gaps(spark):
    routes = frame(spark, "file string, route string", ("a", "x"), ("b", "y"))
    rows, gaps = frameworks.url_confs(routes, frame(spark, "file string, part string, target string", ("a", "b/", "b"), ("a", "n/", "none"), ("a", "n/", "none")))
    assert {tuple(r) for r in rows.collect()} == {("ALL", "/x", "a"), ("ALL", "/b/y", "b")} and [tuple(r) for r in gaps.collect()] == [("a", "outside the repository: none")]


def test_survivors_by_method_and_path(spark):
    facts = frame(spark, "id string", *[(f"fact:http-endpoints/{x}",) for x in ("POST /a/b", "GET /a/b/c", "GET /x", "DELETE /q")], ("fact:db/GET /a/b",))
    got = rank.survivors(frame(spark, "id string", ("fact:http-endpoints/GET /a/b",)), facts).collect()
    assert [(r.candidate.split("/", 1)[1], r.score, r.place) for r in sorted(got, key=lambda r: r.place)] == [("POST /a/b", 90, 1), ("GET /a/b/c", 67, 2)]


def test_lies_of_every_class(spark):
    doc = ["# Use", "Requires Node 18 or newer.", "Run `yarn dev` or npm workspaces; npm test works.", "`/admin/users` is a page, `/src/none` a file, `left-pad@1.0`.", "curl http://localhost:3000/v1/gone and curl https://api.other.com/x and curl http://$HOST/v1/me", "GET /pages/one, GET /v1/me.", "├── `src/tree.js`", "Create `src/new.js` first.", "export MY_KEY and THE_ACRONYM"]
    doc += ["THE_ACRONYM stands alone", "[pair](1, 2) [x](a|b) [gone](gone.md)"]
    made = claims.claims(frame(spark, "doc string, line int, text string", *[("d.md", i, t) for i, t in enumerate(doc)]))
    known = frame(spark, "class string, key string", ("version", "20"), ("script", "test"), ("folder", "src")).union(claims.route_keys(frame(spark, "capability string, name string", ("http-endpoints", "GET /v1/me"), ("client-routes", "/pages/one"))))
    got = {(r["class"], r.claim) for r in claims.unsupported(made, known).collect()}
    assert got == {("version", "node 18"), ("script", "dev"), ("file", "/src/none"), ("curl", "curl .../v1/gone"), ("env", "MY_KEY"), ("env", "THE_ACRONYM"), ("link", "gone.md")}
    assert {r["class"] for r in claims.unsupported(made, known, ["link", "env"]).collect()} == {"link", "env"}


def test_logs_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "STRETCH", 3)
    log = ["@1|ann|2024", "", "a", "b", "c", "d", "e", "@2|bob|2025", "", "f"]
    rows = repository.git_log(frame(spark, "value string, line_no int", *[(v, n) for n, v in enumerate(log)])).collect()
    assert sorted((r.sha, r.author, r.path) for r in rows) == [("1", "ann", p) for p in "abcde"] + [("2", "bob", "f")]
    path = tmp_path / "log.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = repository.lines(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.value) for r in got) == [(i + 1, f"line {i}") for i in range(5000)]


def test_answers_and_mined(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid":"iv-1","verdict":"confirm","subject":"s"}\nno json\n{"qid":"iv-2"}\n')
    (tmp_path / "m.jsonl").write_text('{"sha":"1","subject":"fix it","score":4}\n{}\n')
    assert [(r.qid, r.verdict) for r in repository.answers(spark, str(tmp_path / "a.jsonl")).collect()] == [("iv-1", "confirm")]
    assert [(r.sha, r.score) for r in repository.mined(spark, str(tmp_path / "m.jsonl")).collect()] == [("1", 4)]


def test_claims_and_facts_round_trip(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id":"fact:a/1","capability":"a","hash":"h1:0"}\n{"id":null}\nno\n')
    facts = repository.claims(spark, str(tmp_path / "f.jsonl"))
    assert [r.id for r in facts.collect()] == ["fact:a/1"]
    repository.write_facts(facts, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).where("capability = 'a'").first().id == "fact:a/1"


def test_set_hash_is_bounded(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("i"), F.lit("1").alias("v"))
    assert len(normalise.set_hash(rows, "i", "v").first().hash) == 16
    with pytest.raises(Exception, match="more than 5 versions"):
        normalise.set_hash(rows, "i", "v", 5).collect()


def test_sections_of_each_document(spark):
    recipe = frame(spark, "doc string, place int, section string", ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y"))
    have = frame(spark, "doc string, section string", ("a", "x"), ("b", "y"))
    assert {(r.doc, r.section, r.after_section) for r in report.missing_sections(recipe, have, "place", "section", "doc").collect()} == {("a", "y", "x"), ("b", "x", None)}
