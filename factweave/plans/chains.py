"""Chains: SQL policies replayed through renames, globs met segment by segment, values overlaid, names chased through imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import globs, imports, overlays, policies, workspaces
from factweave.plans.registry import query, table


def lives_sql(ev: str, name: str, implied: bool) -> str:
    """CTEs <name>_about(pos, root) and <name>_left(root, key) of a table ev(pos, op, key, target), as operators.replay.lives has them."""
    start = f"'start:' || {ev}.key" if implied else "null"
    return f"""
{name}_all as (select key, pos, 'leave' as m from {ev} where op = 'drop' or op = 'rename' and key <> target union all select key, pos, 'come' from {ev} where op = 'make' union all select target, pos, 'come' from {ev} where op = 'rename' and key <> target
    union all select key, pos, 'found' from {ev} where op = 'found'),
{name}_marks as (select key, pos, case m when 'found' then 'come' else m end as m from (select *, coalesce(lag(m) over (partition by key order by pos), '{"come" if implied else "leave"}') as before from {name}_all) where m <> 'found' or before = 'leave'),
{name}_found as (select {ev}.pos, op, {ev}.key, target, case when op = 'make' or op = 'found' and {ev}.pos in (select pos from {name}_marks) then {ev}.pos when k.m is null then {start} when k.m = 'come' then k.pos end as node from {ev} asof left join {name}_marks k on {ev}.key = k.key and {ev}.pos > k.pos),
{name}_roots(node, root) as (select node, node from {name}_found where node = pos or node like 'start:%' union select f.pos, r.root from {name}_found f join {name}_roots r on f.node = r.node where f.op = 'rename' and f.key <> f.target),
{name}_about as (select pos, root from {name}_found f join {name}_roots r using (node)),
{name}_keys as (select key from {ev} union select key from {name}_marks),
{name}_last as (select k.key, coalesce(arg_max(case when m = 'come' then pos else '' end, pos), '') as node, count(m) as n from {name}_keys k left join {name}_marks using (key) group by 1),
{name}_left as (select root, key from (select key, case when n = 0 then {start.replace(ev + '.', '')} else node end as node from {name}_last) join {name}_roots using (node))"""


@query(f"""
with recursive o as (select *, strftime(o_orderdate, '%Y%m') || lpad(o_orderkey::varchar, 12, '0') as pos, 'db/migrations/' || strftime(o_orderdate, '%Y%m') || '.sql' as path, substr(o_orderpriority, 1, 1) as p,
    't' || (o_custkey % 997) as tab, 'p' || (o_custkey % 7) as pol, 't' || ((o_custkey + 1) % 997) as tab2, 'p' || ((o_custkey + 1) % 7) as pol2 from orders),
tev as (select pos, case when p = '5' and o_orderstatus = 'F' then 'rename' when p = '5' and o_orderstatus = 'P' then 'drop' when p = '4' and o_orderstatus = 'P' then 'found' else 'say' end as op, tab as key, tab2 as target from o),
{lives_sql("tev", "t", True)},
pev as (select pos, case p when '1' then 'make' when '2' then 'say' when '3' then 'rename' else 'drop' end as op, root || '/' || pol as key, root || '/' || pol2 as target, o.* exclude (pos), root as owner from o join t_about using (pos) where p <> '5' and not (p = '4' and o_orderstatus = 'P')),
{lives_sql("pev", "p", False)},
said as (select a.root, pev.*, 'owner = ''o;' || o_orderkey || '('' || ")"' as body from pev join p_about a using (pos)),
shaped as (select root, arg_max(path, pos) as file, arg_max(o_custkey, pos) filter (p = '1') as who, coalesce(arg_max(body, pos) filter (p in ('1', '2')), '') as "using", arg_max('n > ' || o_custkey, pos) filter (p = '1' and o_orderstatus = 'F') as with_check,
    arg_max(o_orderstatus, pos) filter (p = '1') as st from said group by 1),
secured as (select a.root as owner, arg_max(o_custkey % 2 = 0, pos) as enabled from o join t_about a using (pos) where p = '5' and o_orderstatus = 'O' group by 1)
select 'public' as "schema", tl.key as "table", split_part(l.key, '/', 2) as name, case st when 'F' then 'SELECT' else 'ALL' end as command, st <> 'P' as permissive, case when st = 'O' then 'public' else 'a,r' || (who % 5) end as roles, "using", with_check, file, enabled
from p_left l join shaped using (root) join t_left tl on tl.root = split_part(l.key, '/', 1) left join secured s on s.owner = tl.root""")
def q88_policy_replay(spark, d):
    """Orders as statements in one file a month: made, altered, renamed and dropped policies, tables renamed, dropped, made and secured, among comments and quotes that hold semicolons."""
    o = table(spark, d, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1)).withColumn("st", F.col("o_orderstatus"))
    of = lambda c, k, n, add=0: F.concat(F.lit(c), (F.col(k) + add) % n)
    tab, pol, tab2, pol2 = of("t", "o_custkey", 997), of("p", "o_custkey", 7), of("t", "o_custkey", 997, 1), of("p", "o_custkey", 7, 1)
    using = F.concat(F.lit("""\n using ( owner = 'o;"""), "o_orderkey", F.lit("""(' -- a ; and a ')\n  || ")" )"""))
    roles = F.when(F.col("st") != "O", F.concat(F.lit(" to r"), F.col("o_custkey") % 5, F.lit(', "a"'))).otherwise("")
    check = F.when(F.col("st") == "F", F.concat(F.lit(" with check (n  > "), "o_custkey", F.lit(")"))).otherwise("")
    kind = F.when(F.col("st") == "P", " as restrictive").when(F.col("st") == "F", " for select").otherwise("")
    make = F.concat(F.lit("/* ; it's */ create policy "), pol, F.lit(" on public."), tab, kind, roles, using, check)
    alter = F.concat(F.lit("ALTER POLICY "), pol, F.lit(" ON "), tab, using)
    rename = F.concat(F.lit('alter policy "'), pol, F.lit('" on "'), tab, F.lit('" rename to '), pol2)
    drop = F.concat(F.lit("drop policy if exists "), pol, F.lit("\non "), tab)
    of_table = F.when(F.col("st") == "F", F.concat(F.lit("alter table only "), tab, F.lit(" rename to "), tab2)).when(F.col("st") == "P", F.concat(F.lit("drop table "), tab))
    of_table = F.coalesce(of_table, F.concat(F.lit("alter table "), tab, F.when(F.col("o_custkey") % 2 == 0, " enable").otherwise(" disable"), F.lit(" row level security")))
    drop = F.when(F.col("st") == "P", F.concat(F.lit("create table if not exists "), tab, F.lit(" (id int, t text default ';')"))).otherwise(drop)
    text = F.when(F.col("p") == "1", make).when(F.col("p") == "2", alter).when(F.col("p") == "3", rename).when(F.col("p") == "4", drop).otherwise(of_table)
    rows = o.select(F.concat(F.lit("db/migrations/"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".sql")).alias("path"), F.struct("o_orderkey", F.concat(text, F.lit(";\n")).alias("t")).alias("s"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("content"))
    left, secured = policies.replayed(policies.statements(files.where(policies.in_migrations(F.col("path")))))
    out = left.join(secured.select("schema", "table", "enabled"), ["schema", "table"], "left")
    return out.withColumn("roles", F.array_join("roles", ",")).withColumn("using", F.coalesce("using", F.lit("")))


@query(r"""
with paths as (select replace(p_type || ' ' || p_name, ' ', '/') || '/' || p_brand || '/' || p_partkey || case when p_size % 2 = 0 then '.js' else '.ts' end as path from part),
w as (select distinct string_split(p_type || ' ' || p_name, ' ') as w, length(p_type || p_name) % 5 as k from part),
g as (select distinct case k when 0 then w[1] || '/**/Brand#1?/*' when 1 then '**/' || w[2] || '/**/*5.js' when 2 then w[1] || '/*/' || w[3] || '/' when 3 then '{' || w[1] || ',X}/' || w[2] || '/**/*1.{ts,js}' else '**/' || w[3] || '/Brand*/1*' end as gl from w),
r as (select gl, case when gl like '%/' then gl || '**' else gl end as x from g),
p as (select gl, '^' || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '.', '\.'), '?', '[^/]'), '{', '(?:'), '}', ')'), ',', '|'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), chr(1), '(?:[^/]+/)*'), chr(2), '.*') || '$' as pattern from r)
select gl as "glob", path from p join paths on regexp_matches(path, pattern)""")
def q89_globs(spark, d):
    """Parts as files in folders of their type and name, met by globs made of the same words; the SQL compares all pairs by regular expressions."""
    part = table(spark, d, "part").withColumn("words", F.concat_ws(" ", "p_type", "p_name"))
    paths = part.select(F.concat(F.replace("words", F.lit(" "), F.lit("/")), F.lit("/"), "p_brand", F.lit("/"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ".js").otherwise(".ts")).alias("path"))
    w, k = F.split("words", " "), F.length(F.concat("p_type", "p_name")) % 5
    shapes = F.when(k == 0, F.concat(w[0], F.lit("/**/Brand#1?/*"))).when(k == 1, F.concat(F.lit("**/"), w[1], F.lit("/**/*5.js"))).when(k == 2, F.concat(w[0], F.lit("/*/"), w[2], F.lit("/")))
    shapes = shapes.when(k == 3, F.concat(F.lit("{"), w[0], F.lit(",X}/"), w[1], F.lit("/**/*1.{ts,js}"))).otherwise(F.concat(F.lit("**/"), w[2], F.lit("/Brand*/1*")))
    return globs.matches(paths, part.select(shapes.alias("glob")).distinct())


@query("""
with c as (select n_name as root, n_nationkey % 2 = 0 as pnpm, 'seg/' || c_mktsegment || '-' || c_custkey as path, c_custkey, c_name from customer join nation on c_nationkey = n_nationkey),
hit as (select * from c where not pnpm or path not like 'seg/MACH%'),
members as (select root, case when pnpm then 'pnpm' else 'npm-yarn' end as manager, case when pnpm then 'pnpm-workspace.yaml' else 'package.json' end as file, case when c_custkey % 2 = 0 then c_name else substr(path, 5) end as name, path, null as kind from hit where c_custkey % 3 <> 0)
select * from members union all select root, null, path, null, null, 'workspace-member-unresolved' from hit where c_custkey % 3 = 0
union all select n_name, 'single', case when n_nationkey % 2 = 0 then null else 'package.json' end, n_name, '.', null from nation where n_name not in (select root from members)""")
def q90_workspace_layout(spark, d):
    """Nations as repositories, customers as their packages: named by globs in one of two manifests, some taken away, some without a manifest of their own."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    own = F.col("c_custkey") % 3 != 0
    content = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("name")))).otherwise("{}")
    files = rows.select(F.col("n_name").alias("root"), F.concat(F.lit("seg/"), "c_mktsegment", F.lit("-"), "c_custkey", F.when(own, "/package.json").otherwise("/README.md")).alias("path"), F.when(own, content).otherwise("").alias("content"))
    pnpm = F.col("n_nationkey") % 2 == 0
    manifest = n.select(F.col("n_name").alias("root"), F.when(pnpm, "pnpm-workspace.yaml").otherwise("package.json").alias("path"), F.when(pnpm, "packages:\n  - 'seg/*'\n  - \"!seg/MACH*\"\n").otherwise('{"workspaces": ["./seg/*/"]}').alias("content"))
    packages, wrong = workspaces.layout(files.unionByName(manifest))
    none = F.lit(None).cast("string")
    return packages.withColumn("kind", none).unionByName(wrong.select("root", none.alias("manager"), "file", none.alias("name"), none.alias("path"), "kind"))


@query("""
with recursive f as (select distinct c_custkey as k from customer),
walk(k, now, n) as (select k, k, 0 from f union all select walk.k, now // 2, n + 1 from walk where now % 10 <> 0 and now // 2 in (select k from f) and n < 6)
select 'pkg/m' || f.k || '.py' as file, case when w.now is not null then 'pkg/m' || w.now || '.py' end as in_file, case when w.now is not null then 'r' || w.now end as as_name from f left join (select k, now from walk where now % 10 = 0) w on w.k = f.k""")
def q91_import_chase(spark, d):
    """A module for each customer that takes its router from that of half the number, under another name; every tenth makes one. Chains of more than six are gaps."""
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    file, half = F.concat(F.lit("pkg/m"), "k", F.lit(".py")), F.floor(F.col("k") / 2)
    local, far = F.concat(F.lit("r"), "k"), F.concat(F.lit("r"), half)
    rows = k.select(file.alias("file"), F.lit(1).alias("line"), local.alias("local"), F.concat(F.lit(".m"), half).alias("module"), far.alias("name"), (F.col("k") % 10 == 0).alias("makes"))
    found, gaps = imports.chased(rows.where("not makes").drop("makes"), rows.where("makes").select("file", F.col("local").alias("name")), rows.select("file", F.col("local").alias("name")), k.select(file.alias("path")))
    none = F.lit(None).cast("string")
    return found.drop("name").unionByName(gaps.select("file", none.alias("in_file"), none.alias("as_name")))


@query("""
with o as (select o_custkey as chart, o_orderkey as layer, substr(o_orderpriority, 1, 1) as p, o_orderkey::varchar as v from orders),
l as (select chart, layer, unnest(case p when '1' then [('img.tag', v), ('img.repo', '{{ .Values.n }}')] when '2' then [('img', v)] when '3' then [('img.tag.x', '1'), ('img.tag.y', v)] when '4' then [('img.repo', null), ('n', v)] else [('n.deep.er', v)] end) as e from o),
r as (select chart, layer, e[1] as path, e[2] as value from l),
k as (select * from r a where value is not null and not exists (select 1 from r b where b.chart = a.chart and b.layer > a.layer and (b.path = a.path or starts_with(b.path, a.path || '.') or starts_with(a.path, b.path || '.')))),
c as (select chart, max(value) filter (path = 'img.tag') as tag, max(value) filter (path = 'img.repo') as repo, max(value) filter (path = 'n') as n, max(value) filter (path = 'img.tag.y') as y from k group by 1)
select distinct o.chart::varchar as chart, coalesce(case when repo like '{{%' then n else repo end, '<unknown:.Values.img.repo>') || ':' || coalesce(tag, '<unknown:.Values.img.tag>') || ' ' || coalesce(y, '<unknown:.Values.img.tag.y>') as image from o left join c on c.chart = o.chart""")
def q92_values(spark, d):
    """Orders as layers of values of their customer's chart, trees and leaves replacing each other, and a template filled from what is left."""
    o, v = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    p = F.substring("o_orderpriority", 1, 1)
    json = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    content = F.when(p == "1", json('{"img":{"tag":"', v, '","repo":"{{ .Values.n }}"}}')).when(p == "2", json('{"img":', v, "}")).when(p == "3", json('{"img":{"tag":{"x":1,"y":"', v, '"}}}'))
    content = content.when(p == "4", json('{"img":{"repo":null},"n":"', v, '"}')).otherwise(json('{"n":{"deep":{"er":"', v, '"}}}'))
    docs = o.select(F.col("o_custkey").cast("string").alias("chart"), F.col("o_orderkey").alias("layer"), content.alias("content"))
    left = overlays.overlaid(overlays.leaves(docs))
    charts = docs.select("chart", F.col("chart").alias("name"), F.lit("1").alias("version")).distinct()
    texts = charts.select(F.col("chart").alias("id"), "chart", F.lit("{{ .Values.img.repo }}:{{- .Values.img.tag -}} {{.Values.img.tag.y}}").alias("text"))
    return overlays.filled(texts, left, charts)[0].select("chart", F.col("text").alias("image"))
