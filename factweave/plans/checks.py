"""The whole check, candidates, gaps, caps, graphs of frameworks and catalogs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.functions.text import dig, entropy, redact, slug
from factweave.operators import derive, evaluate, frameworks, graph, normalise, rank
from factweave.plans.registry import query, table

MARKERS_SQL = """
with c as (select 'fact:cust/' || c_custkey as id, 'h1:' || sha256(c_mktsegment || c_custkey) as hash from customer),
f as (select * from c union all select 'fact:nation/' || n_name, 'h1:' || sha256(n_name) from nation),
s as (select s_suppkey as k, s_nationkey, 's' || s_suppkey as id, 'd' || s_nationkey || '.md' as doc, case s_suppkey % 3 when 0 then 'anchor' when 1 then 'gen' else 'slot' end as kind,
    case s_suppkey % 4 when 0 then 'h1:00' when 2 then 'h0:1' when 3 then substr(c.hash, 1, 19) end as hash,
    case when s_suppkey % 11 = 0 then null when s_suppkey % 13 = 0 then 'h1:ff' else substr('h1:' || sha256('body ' || s_suppkey), 1, 19) end as content, 'h1:' || sha256('body ' || s_suppkey) as body
    from supplier left join c on c.id = 'fact:cust/' || (3 * s_suppkey)),
b as (select k, unnest(list_filter(['fact:cust/' || (3 * k), case when k % 5 = 0 then 'fact:cust/' || (k + 1000000) end, case when k % 7 = 0 then 'fact:nation/NATION_' || k % 3 || '*' end], lambda x: x is not null)) as raw from s where not (kind = 'slot' and hash is null)),
r as (select k, raw, f.id as fact, f.hash, false as lacking from b join f on raw like '%*' and starts_with(f.id, raw[:-2]) union all select k, raw, f.id, f.hash, f.id is null from b left join f on f.id = raw where raw not like '%*'),
t as (select distinct 'fact:cust/' || (user_id + 1000000) as raw from events where event_type = 'signup'),
g as (select k, list_sort(list(distinct raw) filter (lacking)) as missing, count(distinct raw) filter (lacking) as n_missing, count(distinct raw) filter (lacking and raw in (select raw from t)) as n_gone,
    case when count(distinct fact) = 1 then max(hash) else 'h1:' || sha256('{"pairs":[' || coalesce(string_agg(distinct '["' || fact || '","' || hash || '"]', ',' order by '["' || fact || '","' || hash || '"]'), '') || '],"schema_version":1,"type":"aggregate"}') end as cur from r group by 1),
l as (select 's' || user_id as id, bool_or(event_type = 'view' and event_id % 97 = 0) as snoozed, bool_or(event_type = 'error' and event_id % 5 = 0) as refused from events group by 1),
m as (select s.*, g.missing, g.n_missing, g.n_gone, g.cur, coalesce(l.snoozed, false) as snoozed, coalesce(l.refused, false) and substr(c.hash, 1, 19) = substr(case when kind = 'gen' and content is not null and not starts_with(s.body, content) then s.body else g.cur end, 1, 19) as held
    from s join g using (k) left join l on l.id = s.id left join c on c.id = 'fact:cust/' || (3 * k)),
x as (select *, case when snoozed then 'snoozed' when n_missing > 0 and n_missing = n_gone then 'intentionally_removed' when n_missing > 0 then 'dead' when kind = 'anchor' then 'clean'
    when kind = 'gen' and content is not null and not starts_with(body, content) then case when held then 'held' else 'tampered' end
    when hash is not null and split_part(hash, ':', 1) <> 'h1' then 'unverified' when hash is not null and not starts_with(cur, hash) then case when held then 'held' else 'stale' end
    when kind = 'gen' and (content is null or hash is null) then 'unverified' else 'clean' end as state from m)"""


def _facts(spark, d):
    customers = table(spark, d, "customer").select(F.concat(F.lit("fact:cust/"), F.col("c_custkey")).alias("id"), canon.full_hash(F.concat("c_mktsegment", "c_custkey")).alias("hash"))
    return customers.unionByName(table(spark, d, "nation").select(F.concat(F.lit("fact:nation/"), F.col("n_name")).alias("id"), canon.full_hash(F.col("n_name")).alias("hash")))


def _markers(spark, d):
    k = F.col("s_suppkey")
    bound = F.array_compact(F.array(F.concat(F.lit("fact:cust/"), 3 * k), F.when(k % 5 == 0, F.concat(F.lit("fact:cust/"), k + 1_000_000)), F.when(k % 7 == 0, F.concat(F.lit("fact:nation/NATION_"), k % 3, F.lit("*")))))
    rows = table(spark, d, "supplier").join(_facts(spark, d).select("id", F.col("hash").alias("_h")), F.col("id") == F.concat(F.lit("fact:cust/"), 3 * k), "left")
    body = F.concat(F.lit("body "), k)
    return rows.select(
        F.concat(F.lit("d"), "s_nationkey", F.lit(".md")).alias("doc"),
        k.cast("int").alias("line"),
        F.when(k % 3 == 0, "anchor").when(k % 3 == 1, "gen").otherwise("slot").alias("kind"),
        F.concat(F.lit("s"), k).alias("id"),
        bound.alias("binds"),
        F.when(k % 4 == 0, "h1:00").when(k % 4 == 2, "h0:1").when(k % 4 == 3, canon.display(F.col("_h"))).alias("hash"),
        F.when(k % 11 == 0, None).when(k % 13 == 0, "h1:ff").otherwise(canon.display(canon.full_hash(body))).alias("content"),
        body.alias("body"),
    )


def _findings(spark, d):
    events = table(spark, d, "events")
    target, none = F.concat(F.lit("s"), F.col("user_id")), F.lit(None).cast("string")
    snoozed = events.where("event_type = 'view' and event_id % 97 = 0").select(F.lit("snooze").alias("type"), target.alias("target"), none.alias("content_hash"))
    buried = events.where("event_type = 'signup'").select(F.lit("tombstone"), F.concat(F.lit("fact:cust/"), F.col("user_id") + 1_000_000), none)
    refused = events.where("event_type = 'error' and event_id % 5 = 0").join(_facts(spark, d), F.col("id") == F.concat(F.lit("fact:cust/"), 3 * F.col("user_id"))).select(F.lit("rejection"), target, canon.display(F.col("hash")))
    return evaluate.findings(_markers(spark, d), _facts(spark, d), snoozed.union(buried).union(refused).distinct())


@query(MARKERS_SQL + " select doc, k::int as line, kind, id, state, coalesce(array_to_string(missing, ','), '') as missing from x")
def q61_check(spark, d):
    return _findings(spark, d).withColumn("missing", F.array_join("missing", ","))


@query(MARKERS_SQL + """
, n as (select count(*) filter (state = 'stale') as stale, count(*) filter (state = 'dead') as dead, count(*) filter (state = 'tampered') as tampered, count(*) filter (state = 'clean') as clean, count(*) as n from x),
v as (select count(*) as total, count(distinct r.fact) as documented from f left join r on r.fact = f.id),
w as (select (select count(*) from f) as total, documented, ((200 * documented + (select count(*) from f)) // (2 * (select count(*) from f)))::bigint as pct from v)
select stale + dead + tampered = 0 as ok, case when stale + dead + tampered > 0 then 'DRIFT_FOUND' else 'CLEAN' end as code,
    (stale + dead + tampered) || ' drift finding(s) [stale ' || stale || ', dead ' || dead || ', tampered ' || tampered || ']; ' || clean || ' clean; ' || documented || '/' || total || ' surfaces documented (' || pct || '%)' as summary,
    n > least(20, stale + dead + tampered) as truncated from n, w""")
def q62_envelope(spark, d):
    facts = _facts(spark, d)
    bound = evaluate.bind_ids(evaluate.asked_binds(_markers(spark, d).where("not (kind = 'slot' and hash is null)")), facts).select("fact").distinct()
    rows = facts.select("id").join(bound.select(F.col("fact").alias("id"), F.lit(1).alias("_d")), "id", "left")
    ratio = rows.agg(F.count("*").alias("total"), F.count("_d").alias("documented")).withColumn("pct", F.floor((200 * F.col("documented") + F.col("total")) / (2 * F.col("total"))).cast("bigint"))
    return evaluate.envelope(_findings(spark, d), ratio).select("ok", "code", "summary", "truncated")


@query(MARKERS_SQL + " select distinct kind, id, doc, k::int as line, fact from r join s using (k) where fact is not null")
def q63_bind_ids(spark, d):
    return evaluate.bind_ids(evaluate.asked_binds(_markers(spark, d).where("not (kind = 'slot' and hash is null)")), _facts(spark, d))


@query(MARKERS_SQL + """
, e as (select distinct 'd' || user_id % 50 || '.md' as doc from events where event_type = 'purchase' and user_id % 7 = 0), i as (select distinct 'fact:cust/' || o_custkey as fact from orders where o_orderstatus = 'P')
select id, state, doc in (select doc from e) or k in (select k from r where coalesce(fact, raw) in (select fact from i)) as self_caused from x where state in ('stale', 'tampered', 'dead')""")
def q64_self_caused(spark, d):
    found = _findings(spark, d).where(F.col("state").isin("stale", "tampered", "dead"))
    asked = evaluate.asked_binds(_markers(spark, d).where("not (kind = 'slot' and hash is null)"))
    rows = evaluate.resolved(asked, _facts(spark, d))
    bound = rows.where("fact is not null or lacking").select(*evaluate.KEY, F.coalesce("fact", "raw").alias("fact"))
    docs = table(spark, d, "events").where("event_type = 'purchase' and user_id % 7 = 0").select(F.concat(F.lit("d"), F.col("user_id") % 50, F.lit(".md")).alias("doc"))
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("fact:cust/"), F.col("o_custkey")).alias("fact"))
    return evaluate.classify(found, bound, docs, ids).select("id", "state", "self_caused")


@query("""
select 'o' || o_custkey as doc, count(*) filter (o_orderpriority = '1-URGENT') as anchors, count(*) filter (o_orderpriority <> '1-URGENT') as regions from orders
where o_custkey not in (select c_custkey from customer where c_acctbal > 2000) group by 1""")
def q65_unscanned(spark, d):
    name = lambda c: F.concat(F.lit("o"), F.col(c)).alias("doc")
    marks = table(spark, d, "orders").select(name("o_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "anchor").otherwise("gen").alias("kind"))
    return evaluate.unscanned(marks, table(spark, d, "customer").where("c_acctbal > 2000").select(name("c_custkey")))


@query("""
select event_type, event_id, total, place from (select event_type, event_id, count(*) over (partition by event_type) as total, row_number() over (partition by event_type order by value desc, event_id) as place from events) where place <= 20""")
def q66_capped(spark, d):
    return evaluate.capped(table(spark, d, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")]).select("event_type", "event_id", "total", "place")


@query("""
with c as (select user_id, count(*) filter (event_type = 'purchase') as applied, count(*) filter (event_type = 'error') as rejected from events group by 1)
select user_id, applied + rejected as decided, case when applied + rejected > 0 then round(applied / (applied + rejected), 3) end as accept_rate from c""")
def q67_accept_rate(spark, d):
    kinds = F.col("event_type")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(kinds == "purchase").alias("applied"), F.count_if(kinds == "error").alias("rejected"))
    return evaluate.accept_rate(rows).select("user_id", "decided", "accept_rate")


IDS_SQL = "select p_partkey, 'fact:' || lower(replace(p_brand, '#', '-')) || '/' || case p_size % 3 when 0 then 'GET /' || replace(p_name, ' ', '/') when 1 then 'POST /' || replace(p_name, ' ', '/') || '/' || lower(split_part(p_type, ' ', 1)) else p_name || ' ' || p_type end as id from part"
UNSOLD = "select l_partkey from lineitem where l_quantity > 45"
WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> ''))"


def _ids(spark, d):
    size, words = F.col("p_size") % 3, F.replace("p_name", F.lit(" "), F.lit("/"))
    rest = F.when(size == 0, F.concat(F.lit("GET /"), words)).when(size == 1, F.concat(F.lit("POST /"), words, F.lit("/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("fact:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), rest).alias("id"))


@query(f"""
with i as ({IDS_SQL}), p as (select distinct id, split_part(id, '/', 1) as cap, regexp_replace(id, '^fact:[a-z0-9-]+/', '') as rest from i),
q as (select *, regexp_extract(rest, '^([A-Z]+) (.+)$', 1) as method, regexp_extract(rest, '^([A-Z]+) (.+)$', 2) as path from p),
w as (select *, {WORDS_SQL.format("path")} as path_words, {WORDS_SQL.format("rest")} as rest_words from q),
m as (select distinct w.* from w join i using (id) where p_partkey not in ({UNSOLD})),
j as (select a.id, b.id as candidate, case when a.method <> '' and b.method <> '' then case when a.method = b.method then len(list_intersect(a.path_words, b.path_words)) / len(list_distinct(list_concat(a.path_words, b.path_words))) when a.path = b.path then 0.9 else 0 end
    else len(list_intersect(a.rest_words, b.rest_words)) / len(list_distinct(list_concat(a.rest_words, b.rest_words))) end as score from m a join w b using (cap) where a.id <> b.id),
r as (select id, candidate, round(score * 100)::int as score from j where score >= 0.5)
select id, candidate, score, place from (select *, row_number() over (partition by id order by score desc, candidate) as place from r) where place <= 3""")
def q68_survivors(spark, d):
    ids = _ids(spark, d)
    sold = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rank.survivors(ids.join(sold, "p_partkey", "left_anti").select("id"), ids.select("id"))


@query("""
with f as (select regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages),
o as (select distinct host, path, len(string_split(path, '/')) as depth, list_position(['10', '', '231', '925'], string_split(path, '/')[-1]) as i from f),
n as (select *, row_number() over (partition by host order by depth, i, path) as n from o where i > 0)
select host, path as file, 'candidate-ignored' as reason from n where n > 1""")
def q69_ignored_named(spark, d):
    files = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path")).distinct()
    return derive.ignored_named(files, ["host"], ["10", "", "231", "925"])


@query("""
with recursive n as (select 'p' || n_nationkey as name, n_nationkey as k from nation), e as (select 'p' || k as name, 'p' || k // 2 as need from n where k > 0 union select 'p' || k, 'p' || (k - 3) from n where k > 2),
w(name, sweep) as (select name, 0 from n union select e.name, w.sweep + (e.need > e.name)::int from w join e on e.need = w.name)
select name, max(sweep) as sweep from w group by 1""")
def q70_sweeps(spark, d):
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("int"))
    nations = table(spark, d, "nation")
    needs = nations.where(k > 0).select(name(k).alias("name"), name(F.floor(k / 2)).alias("need")).union(nations.where(k > 2).select(name(k), name(k - 3))).distinct()
    return graph.sweeps(nations.select(name(k).alias("name")), needs)


@query("""
with recursive r as (select 'r' || n_nationkey as node, case when n_nationkey = 0 then 'app' else 'router' end as kind, case when n_nationkey % 4 = 1 then '/own' || n_nationkey end as prefix from nation),
m as (select 'r' || n_nationkey // 3 as parent, 'r' || n_nationkey as child, '/' || lower(replace(n_name, ' ', '')) as part from nation where n_nationkey > 1 and n_nationkey % 7 <> 0 union all select 'r8', 'r2', 'again'),
x(node, path, seen) as (select node, '/' || coalesce(prefix, ''), [node] from r where kind = 'app' or node not in (select child from m)
    union all select m.child, x.path || '/' || part || '/' || coalesce(r.prefix, ''), list_append(seen, m.child) from x join m on m.parent = x.node join r on r.node = m.child where not list_contains(seen, m.child)),
g as (select 'r' || s_nationkey as node, case when s_suppkey % 2 = 0 then 'GET' else 'POST' end as method, 's' || s_suppkey || '/' as tail, 'f' || s_nationkey || '.py' as file from supplier)
select distinct method, '/' || array_to_string(list_filter(string_split(path || '/' || tail, '/'), lambda p: p <> ''), '/') as path, file from g join x using (node)""")
def q71_router_paths(spark, d):
    k = F.col("n_nationkey")
    node = lambda c: F.concat(F.lit("r"), c.cast("int"))
    nations = table(spark, d, "nation")
    routers = nations.select(node(k).alias("node"), F.when(k == 0, "app").otherwise("router").alias("kind"), F.when(k % 4 == 1, F.concat(F.lit("/own"), k)).alias("prefix"))
    mounts = nations.where("n_nationkey > 1 and n_nationkey % 7 <> 0").select(node(F.floor(k / 3)).alias("parent"), node(k).alias("child"), F.concat(F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("")))).alias("part"))
    mounts = mounts.union(spark.createDataFrame([("r8", "r2", "again")], mounts.schema))
    s = F.col("s_suppkey")
    made = table(spark, d, "supplier").select(node(F.col("s_nationkey")).alias("node"), F.when(s % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("s"), s, F.lit("/")).alias("tail"), F.concat(F.lit("f"), "s_nationkey", F.lit(".py")).alias("file"))
    return frameworks.router_paths(routers, mounts, made)


@query("""
with recursive i as (select 'u' || n_regionkey as file, 'n' || n_nationkey || '/' as part, 'v' || n_nationkey as target from nation where n_nationkey % 6 <> 5 union all select 'v3', 'back/', 'u1' union all select 'v4', 'x/', 'gone'),
c as (select 'v' || s_nationkey as file, 's' || s_suppkey || '/' as route from supplier), k as (select file from c union select file from i),
x(file, path, seen) as (select distinct file, '/', [file] from k where file not in (select target from i where target in (select file from k))
    union all select target, path || part, list_append(seen, target) from x join i using (file) where target in (select file from k) and not list_contains(seen, target))
select distinct 'ALL' as method, '/' || array_to_string(list_filter(string_split(path || route, '/'), lambda p: p <> ''), '/') as path, file from c join x using (file)""")
def q72_url_confs(spark, d):
    key = lambda p, c: F.concat(F.lit(p), c)
    includes = table(spark, d, "nation").where("n_nationkey % 6 <> 5").select(key("u", "n_regionkey").alias("file"), F.concat(F.lit("n"), "n_nationkey", F.lit("/")).alias("part"), key("v", "n_nationkey").alias("target"))
    includes = includes.union(spark.createDataFrame([("v3", "back/", "u1"), ("v4", "x/", "gone")], includes.schema))
    routes = table(spark, d, "supplier").select(key("v", "s_nationkey").alias("file"), F.concat(F.lit("s"), "s_suppkey", F.lit("/")).alias("route"))
    return frameworks.url_confs(routes, includes)[0]


@query("""
with t(plural, method, tail, action) as (values (true, 'GET', '', 'index'), (true, 'GET', '/new', 'new'), (true, 'POST', '', 'create'), (true, 'GET', '/:id', 'show'), (true, 'GET', '/:id/edit', 'edit'), (true, 'PATCH', '/:id', 'update'), (true, 'PUT', '/:id', 'update'), (true, 'DELETE', '/:id', 'destroy'),
    (false, 'GET', '/new', 'new'), (false, 'POST', '', 'create'), (false, 'GET', '', 'show'), (false, 'GET', '/edit', 'edit'), (false, 'PATCH', '', 'update'), (false, 'PUT', '', 'update'), (false, 'DELETE', '', 'destroy')),
r as (select 'f' || s_nationkey as file, case when s_suppkey % 5 = 0 then '/api' else '' end as prefix, 's' || s_suppkey as name, s_suppkey % 3 <> 0 as plural, case when s_suppkey % 4 = 1 then ['index', 'show'] end as o, case when s_suppkey % 4 = 2 then ['destroy'] end as e from supplier)
select distinct file, method, prefix || '/' || name || tail as path from r join t using (plural) where (o is null or list_contains(o, action)) and (e is null or not list_contains(e, action))""")
def q73_resource_routes(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_nationkey").alias("file"), F.when(k % 5 == 0, "/api").otherwise("").alias("prefix"), F.concat(F.lit("s"), k).alias("name"), (k % 3 != 0).alias("plural"), F.when(k % 4 == 1, F.array(F.lit("index"), F.lit("show"))).alias("only"), F.when(k % 4 == 2, F.array(F.lit("destroy"))).alias("except"))
    return frameworks.resource_routes(rows)


@query("""
with p as (select 'supabase/functions/' || case when p_size % 5 = 0 then '_' else '' end || lower(replace(p_name, ' ', '-')) || '/' || case p_partkey % 4 when 0 then 'index.js' when 1 then 'index.ts' when 2 then 'index.tsx' else 'util.ts' end as path from part),
e as (select regexp_extract(path, '^supabase/functions/([^_./][^/]*)/(index\\.(?:ts|js|tsx))$', 1) as name, path, list_position(['index.ts', 'index.js', 'index.tsx'], string_split(path, '/')[-1]) as i from p where regexp_matches(path, '^supabase/functions/([^_./][^/]*)/(index\\.(?:ts|js|tsx))$'))
select 'POST' as method, '/functions/v1/' || name as path, arg_min(path, i) as file from e group by name""")
def q74_function_routes(spark, d):
    k = F.col("p_partkey") % 4
    entry = F.when(k == 0, "index.js").when(k == 1, "index.ts").when(k == 2, "index.tsx").otherwise("util.ts")
    path = F.concat(F.lit("supabase/functions/"), F.when(F.col("p_size") % 5 == 0, "_").otherwise(""), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("/"), entry)
    return frameworks.function_routes(table(spark, d, "part").select(path.alias("path")))


CATALOG_SQL = """
with f as (select 'fact:' || p_partkey as id, case p_partkey % 3 when 0 then 'table' when 1 then 'view' else 'function' end as kind, case p_size % 4 when 0 then 'api' when 1 then 'public' when 2 then 'hidden' else 'other' end || '.' || replace(p_name, ' ', '_') || '.x' || p_partkey % 50 as name,
    p_size % 10 = 1 as materialized, p_size % 2 = 1 as insertable, p_size % 3 = 1 as updatable, p_size % 5 = 1 as deletable, p_size > 25 as stable from part),
k as (select distinct name from f where name like '%a%'),
g as (select *, list_position(['public', 'api', 'other'], split_part(name, '.', 1)) as rank, substr(name, strpos(name, '.') + 1) as relation from f),
s as (select kind, relation, rank, name, arg_min({'m': coalesce(materialized, false), 'i': insertable, 'u': updatable, 'd': deletable}, id) as v, min(id) as id, bool_or(stable) as stable from g where rank > 0 group by all),
w as (select kind, relation, arg_min(name, rank) as name, arg_min(v, rank) as v, arg_min(id, rank) as id, arg_min(stable, rank) as stable, count(*) as n from s group by all)"""


def _catalog(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    schema = F.when(s % 4 == 0, "api").when(s % 4 == 1, "public").when(s % 4 == 2, "hidden").otherwise("other")
    rows = table(spark, d, "part").select(F.concat(F.lit("fact:"), k).alias("id"), F.when(k % 3 == 0, "table").when(k % 3 == 1, "view").otherwise("function").alias("kind"), F.concat(schema, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".x"), k % 50).alias("name"), (s % 10 == 1).alias("materialized"), (s % 2 == 1).alias("insertable"), (s % 3 == 1).alias("updatable"), (s % 5 == 1).alias("deletable"), (s > 25).alias("stable"))
    return frameworks.catalog_endpoints(rows, rows.where("name like '%a%'").select("name"), ["public", "api", "other"])


@query(CATALOG_SQL + """
, x as (select kind, relation, id, unnest(list_filter([case when kind <> 'function' or stable then 'GET' end, case when kind <> 'view' or (v.i and not v.m) then 'POST' end, case when kind = 'table' or (kind = 'view' and v.u and not v.m) then 'PATCH' end,
    case when kind = 'table' or (kind = 'view' and v.d and not v.m) then 'DELETE' end, case when kind = 'table' and name in (select name from k) then 'PUT' end], lambda y: y is not null)) as method from w)
select method, case when kind = 'function' then '/rest/v1/rpc/' else '/rest/v1/' end || relation as path, id as derived_from from x""")
def q75_catalog_endpoints(spark, d):
    return _catalog(spark, d)[0]


@query(CATALOG_SQL + " select distinct relation from (select kind = 'function' as space, relation, sum(n) as n from w group by all) where n > 1")
def q76_ambiguous_names(spark, d):
    return _catalog(spark, d)[1]


@query("""
with l as (select 'c' || o_custkey as chain, max(o_orderkey) as idx from orders group by 1)
select chain, 't' || idx as model, 'id' as name, 'integer' as type, false as optional, true as "primary", false as enum, null as "references" from l
union all select chain, 't' || idx, 'status', 's' || idx % 3, idx % 2 = 0, false, idx % 3 = 0, null from l union all select chain, 't' || idx, 'users', 'Users', true, false, false, 'user_id=id' from l where idx % 5 = 0""")
def q77_snapshot_columns(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"enums":{"e":{"name":"s0","values":["a"]}},"tables":{"t":{"name":"t'), k, F.lit('","columns":{"id":{"name":"id","type":"integer","primaryKey":true,"notNull":true},"status":{"name":"status","type":"s'), k % 3, F.lit('","notNull":'), F.when(k % 2 == 0, "false").otherwise("true"),
        F.lit(',"default":3}},"foreignKeys":{'), F.when(k % 5 == 0, '"f":{"name":"f","tableTo":"Users","columnsFrom":["user_id"],"columnsTo":["id"]}').otherwise(""), F.lit("}}}}"),
    )
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("chain"), k.alias("idx"), text.alias("content"))
    return frameworks.snapshot_columns(rows).withColumn("references", F.array_join("references", ","))


@query("""
select 'm' || n_regionkey as file, case when n_nationkey % 3 = 0 then 'enum' else 'model' end as kind, 'B' || n_nationkey as block, x.line + 10 * n_nationkey as line, x.name, x.type, x.list, x.optional, x.relation, x.attrs
from nation, (select unnest([{'e': false, 'line': 1, 'name': 'id', 'type': 'Int', 'list': false, 'optional': false, 'relation': false, 'attrs': '@id @default("http://x")'}, {'e': false, 'line': 3, 'name': 'posts', 'type': 'Post', 'list': true, 'optional': false, 'relation': true, 'attrs': ''},
    {'e': false, 'line': 4, 'name': 'by', 'type': 'u.x', 'list': false, 'optional': true, 'relation': true, 'attrs': '@relation(fields: [a], references: [id])'}, {'e': true, 'line': 1, 'name': 'RED', 'type': null, 'list': null, 'optional': null, 'relation': null, 'attrs': null}]) as x) where x.e = (n_nationkey % 3 = 0)""")
def q78_model_fields(spark, d):
    k = F.col("n_nationkey")
    model = F.array(F.concat(F.lit("model B"), k, F.lit(" {")), F.lit('  id Int @id @default("http://x") // key'), F.lit("  // none"), F.lit("  posts Post[]"), F.lit("  by u.x? @relation(fields: [a], references: [id])"), F.lit("  @@map(\"y\")"), F.lit("}"), F.lit("stray Int"))
    enum = F.array(F.concat(F.lit("enum B"), k, F.lit(" {")), F.lit("  RED"), F.lit("}"))
    lines = table(spark, d, "nation").select(F.concat(F.lit("m"), "n_regionkey").alias("file"), k, F.posexplode(F.when(k % 3 == 0, enum).otherwise(model)).alias("pos", "text"))
    return frameworks.model_fields(lines.select("file", (k * 10 + F.col("pos")).alias("line"), "text"))


@query("""
with r as (select p_brand as path, split_part(p_name, ' ', 1) as name, case when p_size % 3 = 0 then 'function' when p_size % 3 = 1 then 'class' else 'const' end as kind, p_size % 2 = 0 as impl, p_type as sig from part),
o as (select *, bool_or(kind = 'function' and not impl) over w and bool_or(impl) over w as over_ from r window w as (partition by path, name))
select path, name, string_agg(distinct kind, '+' order by kind) as kind, string_agg(distinct sig, ',' order by sig) as sigs from o where not (over_ and impl) group by 1, 2""")
def q79_signature_groups(spark, d):
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.when(s % 3 == 0, "function").when(s % 3 == 1, "class").otherwise("const").alias("kind"), (s % 2 == 0).alias("impl"), F.col("p_type").alias("sig"))
    return frameworks.signature_groups(rows).withColumn("sigs", F.array_join("sigs", ","))


@query("select n_name as path, case when s_suppkey % 3 = 0 then 'own' else case when s_nationkey % 2 = 0 then 'pkg' || s_nationkey end end as package, s_name as name, 'const' as kind, 's' || s_suppkey as sigs from supplier join nation on s_nationkey = n_nationkey")
def q80_flat_symbols(spark, d):
    k = F.col("s_suppkey")
    symbols = F.collect_list(F.struct(F.when(k % 3 == 0, "own").alias("package"), F.col("s_name").alias("name"), F.lit("const").alias("kind"), F.array(F.concat(F.lit("s"), k)).alias("sigs"))).alias("symbols")
    files = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("path"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("pkg"), "s_nationkey")).alias("package")).agg(symbols)
    return frameworks.flat_symbols(files).withColumn("sigs", F.array_join("sigs", ","))


@query("""
with l as (select distinct user_id, event_id // 3 as digest from events where event_type = 'purchase'), h as (select e.user_id, e.event_id from events e where (user_id, event_id // 3) in (select (user_id, digest) from l)),
n as (select user_id, count(*) as live from l group by 1)
select user_id, event_id from (select h.*, live, row_number() over (partition by user_id order by event_id desc) as n from h join n using (user_id)) where n <= greatest(2 * live, 1)""")
def q81_newest(spark, d):
    events = table(spark, d, "events").withColumn("digest", F.floor(F.col("event_id") / 3))
    return normalise.newest(events, ["user_id"], "event_id", events.where("event_type = 'purchase'")).select("user_id", "event_id")


@query("""
with s as (select p_partkey as id, p_brand as module, split_part(p_name, ' ', 2) as tail, p_type as t from part), r as (select 'Brand#' || n_nationkey as old, 'Brand#' || (n_nationkey + 1) % 25 as new from nation)
select a.id, b.id as candidate from s a join r on r.old = a.module join s b on b.module = r.new and b.tail = a.tail and b.id <> a.id where a.id not in (select l_partkey from lineitem where l_quantity > 45)""")
def q82_renamed_symbols(spark, d):
    symbols = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tail"))
    brand = lambda k: F.concat(F.lit("Brand#"), k)
    renames = table(spark, d, "nation").select(brand(F.col("n_nationkey")).alias("old"), brand((F.col("n_nationkey") + 1) % 25).alias("new"))
    sold = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return rank.renamed_symbols(symbols.join(sold, "id", "left_anti"), renames, symbols)


@query("""
with c as (select o_orderkey as k, 'c' || o_orderkey as sha, o_orderstatus || ' ' || case o_orderkey % 6 when 0 then 'Fix the part' when 1 then 'because of a limit' when 2 then 'fixture only' when 3 then 'revert' else 'plain words here' end || ' ' || o_orderpriority as subject from orders),
t as (select l_partkey, count(*) as n from (select distinct l_orderkey, l_partkey from lineitem) group by 1), h as (select distinct l_orderkey as k, l_partkey, n from lineitem join t using (l_partkey)),
b as (select k, max(n) as hot, arg_min('p' || l_partkey, (-n, 'p' || l_partkey)) as file from h group by 1),
s as (select *, case when regexp_matches(subject, '\\b(fix|revert)\\b', 'i') then 2 when regexp_matches(subject, '\\b(because|limit)\\b', 'i') then 1 else 0 end as strength from c)
select sha, subject, file, strength * (1 + coalesce(hot, 0)) as score from s left join b using (k) where strength > 0 and length(subject) >= 10 order by score desc, sha limit 20""")
def q83_mined(spark, d):
    k = F.col("o_orderkey") % 6
    words = F.when(k == 0, "Fix the part").when(k == 1, "because of a limit").when(k == 2, "fixture only").when(k == 3, "revert").otherwise("plain words here")
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("files"))
    commits = table(spark, d, "orders").join(files, "o_orderkey", "left").select(F.concat(F.lit("c"), "o_orderkey").alias("sha"), F.concat_ws(" ", "o_orderstatus", words, "o_orderpriority").alias("subject"), "files")
    return rank.mined(commits, r"(?i)\b(fix|revert)\b", r"(?i)\b(because|limit)\b")


@query("""
with h as (select c_nationkey, string_agg('f' || c_custkey || chr(0) || c_mktsegment, chr(10) order by 'f' || c_custkey) as files from customer group by 1)
select c_nationkey, substr(sha256('{"engine":"e1","provider":"p' || c_nationkey || '@1"}' || chr(10) || files), 1, 40) as key from h""")
def q84_extract_key(spark, d):
    files = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("f"), "c_custkey").alias("path"), F.col("c_mktsegment").alias("digest"))).alias("files"))
    return files.select("c_nationkey", canon.extract_key({"engine": F.lit("e1"), "provider": F.concat(F.lit("p"), "c_nationkey", F.lit("@1"))}, F.col("files")).alias("key"))


@query("""
with l as (select p_partkey, unnest(string_split(p_name || p_type, '')) as c from part), n as (select p_partkey, c, count(*) as k from l group by all), t as (select *, sum(k) over (partition by p_partkey) as n from n)
select p_partkey, round(-sum(k / n * log2(k / n)), 6) as bits from t group by 1""")
def q85_entropy(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(entropy(F.concat("p_name", "p_type")), 6).alias("bits"))


@query("""
select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, case when p_size % 2 = 0 then 's' || p_size else '' end as schema, p_brand as brand from part""")
def q86_names(spark, d):
    s = F.col("p_size")
    name = F.when(s % 2 == 0, F.concat(F.lit("s"), s, F.lit(".t.u"))).otherwise("t")
    json = F.to_json(F.struct(F.struct(F.col("p_brand").alias("b.c")).alias("a")))
    return table(spark, d, "part").select("p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), frameworks.schema_of(name).alias("schema"), dig(json, "a", "b.c").alias("brand"))


@query("""
select p_partkey, 'k ' || case p_partkey % 4 when 0 then '[REDACTED:aws-access-key]' when 1 then '[REDACTED:npm-token]' when 2 then '[REDACTED:dsn-userinfo]' else sha256(p_name) end || ' ' || p_name as text from part""")
def q87_redact(spark, d):
    k, digits = F.col("p_partkey") % 4, F.sha2("p_name", 256)
    secret = F.when(k == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(digits, 1, 16)))).when(k == 1, F.concat(F.lit("npm_"), F.substring(digits, 1, 36))).when(k == 2, F.concat(F.lit("db://user:"), F.substring(digits, 1, 9), F.lit("@host"))).otherwise(digits)
    return table(spark, d, "part").select("p_partkey", redact(F.concat(F.lit("k "), secret, F.lit(" "), F.col("p_name"))).alias("text"))
