"""Binds, ownership, candidates and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import name_tokens
from factweave.operators import binds, graph, rank
from factweave.plans.registry import query, table

URL_PATH = r"^https?://[^/]+/([^?#]*)"
TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> ''))"
UNSOLD = "select l_partkey from lineitem where l_quantity > 45"
BOTH_SQL = TOKENS_SQL.format("p_name || ' ' || p_type || ' ' || p_brand")


def unsold(spark, d, parts):
    """Parts never sold in large numbers stand for what is missing."""
    return parts.join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""
with doc as (select s_suppkey from supplier where s_nationkey < 5),
c as (select l_suppkey as s_suppkey, count(*) as commits from lineitem where l_returnflag = 'R' group by 1),
f as (select l_suppkey as s_suppkey, count(distinct l_partkey) as fan_in from lineitem where l_linenumber = 1 group by 1)
select s_suppkey, (coalesce(commits, 0) + 1) * (coalesce(fan_in, 0) + 1) as score from supplier left join c using (s_suppkey) left join f using (s_suppkey)
where s_suppkey not in (select s_suppkey from doc) order by score desc, s_suppkey limit 100""")
def q15_plan_rank(spark, d):
    suppliers, items = table(spark, d, "supplier"), table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    commits = items.where("l_returnflag = 'R'").groupBy("s_suppkey").agg(F.count("*").alias("commits"))
    fan_in = items.where("l_linenumber = 1").groupBy("s_suppkey").agg(F.count_distinct("l_partkey").alias("fan_in"))
    rows = rank.plan(suppliers.select("s_suppkey"), suppliers.where("s_nationkey < 5").select("s_suppkey"), "s_suppkey", commits, fan_in)
    return rows.orderBy(F.desc("score"), "s_suppkey").limit(100).select("s_suppkey", "score")


@query("""
with n as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by l_suppkey order by n desc, l_partkey) as place from n)
select l_suppkey, l_partkey, n, place from r where place <= 5""")
def q16_fan_in_top5(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return rank.top(n, ["l_suppkey"], [F.desc("n"), F.asc("l_partkey")], 5)


@query(r"""
with i as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages),
o as (select distinct split_part(path, '/', 1) as prefix, 'root' as owner from i union select distinct path, 'page' from i where page_id % 5 = 0 union select distinct path, 'other' from i where page_id % 10 = 0),
m as (select page_id, prefix, owner, max(length(prefix)) over (partition by page_id) as best from i join o on path = prefix or starts_with(path, prefix || '/'))
select page_id, prefix, owner from m where length(prefix) = best""")
def q17_ownership(spark, d):
    items = table(spark, d, "pages").select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("path"))
    owners = items.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("prefix"), F.lit("root").alias("owner"))
    for n, owner in ((5, "page"), (10, "other")):
        owners = owners.union(items.where(F.col("page_id") % n == 0).select("path", F.lit(owner)))
    return binds.longest_prefix(items, "path", owners.distinct(), "prefix").select("page_id", "prefix", "owner")


@query("""
with r as (select r_name || '.' || n_name || '.' || c_custkey as id, r_name, n_name, r_regionkey, n_nationkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select id, case when n_nationkey % 3 = 0 then r_name || '.' || n_name else r_name end as anchor_id from r where n_nationkey % 3 = 0 or r_regionkey % 2 = 0""")
def q18_inherit_binds(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    anchors = nations.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("anchor_id")).union(nations.where("n_nationkey % 3 = 0").select(F.concat_ws(".", "r_name", "n_name"))).distinct()
    regions = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "r_name", "n_name", "c_custkey").alias("id"))
    return binds.inherited(regions, anchors).select("id", "anchor_id")


@query("""
with b as (select unnest(['small', 'red w', 'b', 'blue widget#1']) as prefix)
select prefix, p_name || '#' || p_partkey as id from b join part on starts_with(p_name || '#' || p_partkey, prefix)""")
def q19_bind_prefix(spark, d):
    asked = spark.createDataFrame([(p,) for p in ("small", "red w", "b", "blue widget#1")], "prefix string")
    return binds.by_prefix(asked, table(spark, d, "part").select(F.concat_ws("#", "p_name", "p_partkey").alias("id"))).select("prefix", "id")


@query("""
select n_name as marker, c_custkey as id from nation left join customer on c_nationkey = n_nationkey and c_mktsegment = 'BUILDING' where n_nationkey % 2 = 0
union all select 'nowhere', null""")
def q20_bind_package(spark, d):
    owned = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("package"), F.col("c_mktsegment").alias("capability"), F.col("c_custkey").alias("id"))
    asked = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("marker"), F.col("n_name").alias("package"))
    asked = asked.union(spark.createDataFrame([("nowhere", "nowhere")], asked.schema)).withColumn("capability", F.lit("BUILDING"))
    return binds.by_package(asked, owned).select("marker", "id")


@query("""
select r_name, n_name, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 3 = 0
union all select null, null, c_custkey from customer where c_custkey % 3 <> 0""")
def q20b_bind_exact(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "r_name")
    asked = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).otherwise("gone").alias("raw"))
    return binds.exact(asked, nations).select("r_name", "n_name", "c_custkey")


@query(f"""
with t as (select p_partkey, p_brand, {BOTH_SQL} as tokens from part),
p as (select a.p_partkey as id, b.p_partkey as candidate, len(list_intersect(a.tokens, b.tokens)) as shared, len(a.tokens) as x, len(b.tokens) as y from t a join t b using (p_brand) where a.p_partkey not in ({UNSOLD}) and a.p_partkey <> b.p_partkey),
s as (select id, candidate, shared / (x + y - shared) as score from p where shared / (x + y - shared) >= 0.5),
r as (select *, row_number() over (partition by id order by score desc, candidate) as place from s)
select id, candidate, round(score, 6) as score, place from r where place <= 3""")
def q21_fuzzy(spark, d):
    words = table(spark, d, "part").select("p_partkey", "p_brand", name_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"))
    missing = unsold(spark, d, words).select(F.col("p_partkey").alias("id"), "p_brand", "tokens")
    out = rank.fuzzy(missing, words.select(F.col("p_partkey").alias("candidate"), "p_brand", F.col("tokens").alias("words")), "p_brand")
    return out.select("id", "candidate", F.round("score", 6).alias("score"), "place")


@query(f"""
with t as (select p_partkey, {TOKENS_SQL.format("p_name || ' ' || p_type")} as tokens from part),
p as (select a.p_partkey as id, a.tokens as x, b.tokens as y from t a join t b on b.p_partkey = a.p_partkey + 1)
select id, case when list_sort(x) = list_sort(y) and x = y then 'exact' when len(x) = len(y) and len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6 then 'near' else 'none' end as match from p""")
def q22_signature_match(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.array(name_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("s"))
    other = words.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("t"))
    return words.join(other, "p_partkey").select(F.col("p_partkey").alias("id"), rank.signature_match(F.col("s"), F.col("t")).alias("match"))


@query("""
with c as (select a.p_partkey as id, b.p_partkey as candidate, a.p_size = b.p_size as renamed,
    case when a.p_name = b.p_name then 'exact' when split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) then 'near' else 'none' end as signature,
    split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) as tail
    from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey <> b.p_partkey where a.p_partkey not in (select l_partkey from lineitem where l_quantity > 45)),
s as (select *, case when renamed then 4 else 0 end + case signature when 'exact' then 3 when 'near' then 1 else 0 end + case when tail then 2 else 0 end as score from c),
r as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by score desc, candidate) as place from s where score > 0)
select id, candidate, score, place, n = 1 and renamed and signature = 'exact' as auto from r where place <= 3""")
def q23_reanchor(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    a, b = unsold(spark, d, part).alias("a"), part.alias("b")
    word = lambda t, n: F.split_part(f"{t}.p_name", F.lit(" "), F.lit(n))
    pairs = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.p_partkey") != F.col("b.p_partkey")))
    signature = F.when(F.col("a.p_name") == F.col("b.p_name"), "exact").when(word("a", 1) == word("b", 1), "near").otherwise("none")
    pairs = pairs.select(F.col("a.p_partkey").alias("id"), F.col("b.p_partkey").alias("candidate"), (F.col("a.p_size") == F.col("b.p_size")).alias("renamed"), signature.alias("signature"), (word("a", 2) == word("b", 2)).alias("tail"))
    return rank.reanchor(pairs).select("id", "candidate", "score", "place", "auto")


@query("select s_suppkey, s_nationkey from supplier where s_nationkey not in (select c_nationkey from customer where c_acctbal > 9800)")
def q24_declared_beats_live(spark, d):
    declared = table(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("s_nationkey"))
    return binds.unclaimed(table(spark, d, "supplier"), declared, ["s_nationkey"]).select("s_suppkey", "s_nationkey")


@query("""
with recursive m as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child, '/' || n_name as part from nation
    union all select 'n' || c_nationkey, 'c' || c_custkey, '/' || c_custkey from customer union all select 'n0', 'r0', '/again'),
x(node, path, depth, seen) as (select 'r' || r_regionkey, '/' || r_name, 0, ['r' || r_regionkey] from region
    union all select child, path || part, depth + 1, list_append(seen, child) from x join m on parent = node where depth < 32 and not list_contains(seen, child))
select distinct node, path, depth from x""")
def q25_prefix_propagate(spark, d):
    slash = lambda c: F.concat(F.lit("/"), F.col(c))
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    mounts = table(spark, d, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), slash("n_name").alias("part"))
    mounts = mounts.union(table(spark, d, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey"), slash("c_custkey"))).union(spark.createDataFrame([("n0", "r0", "/again")], mounts.schema))
    return graph.prefixes(table(spark, d, "region").select(key("r", "r_regionkey").alias("node"), slash("r_name").alias("path")), mounts)


@query("""
with i as (select l_orderkey as module, l_partkey as target from lineitem)
select target, count(*) as fan_in from i where target in (select p_partkey from part where p_size < 10) group by 1""")
def q25b_fan_in(spark, d):
    imports = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("target"))
    return graph.fan_in(imports, table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("target")))


@query("""
with f as (select distinct p_name as path from part where p_size % 3 = 0), w as (select p_partkey as id, [p_name || '.ts', p_name, split_part(p_name, ' ', 1)] as probes from part),
x as (select id, unnest(probes) as path, generate_subscripts(probes, 1) as pos from w)
select id, arg_min(path, pos) as path from x join f using (path) group by 1""")
def q25c_import_probes(spark, d):
    part = table(spark, d, "part")
    wanted = part.select(F.col("p_partkey").alias("id"), F.array(F.concat("p_name", F.lit(".ts")), F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("probes"))
    return graph.first_probe(wanted, part.where("p_size % 3 = 0").select(F.col("p_name").alias("path")))
