"""Merges, replays, text rules and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.functions.text import LONG_TOKEN, in_scope, name_tokens, plain_parameters, without_name
from factweave.operators import claims, derive, drift, extract, normalise, rank, report
from factweave.plans.decisions import FINDINGS_SQL, findings
from factweave.plans.joins import URL_PATH, unsold
from factweave.plans.registry import query, table
from factweave.sources.markers import markers

PATH_SQL = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"


@query("""
with s as (select user_id, list_sort(list(distinct event_id)) as ids, bool_or(event_type = 'error') as read_in_code, bool_or(event_type = 'signup') as declared from events group by 1)
select user_id, read_in_code, declared, array_to_string(ids[1:20], ',') as sites from s""")
def q26_name_status(spark, d):
    events = table(spark, d, "events").withColumn("read_in_code", F.col("event_type") == "error").withColumn("declared", F.col("event_type") == "signup")
    rows = derive.name_status(events, ["user_id"], ["read_in_code", "declared"], F.col("event_id"))
    return rows.withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))


@query("""
with l as (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line from documents)
select doc_id, count(*) as n_lines, sum(len(regexp_extract_all(line, '[^ ]{20,}')))::bigint as n_long from l group by 1""")
def q27_lines(spark, d):
    lines = extract.lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    return lines.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.regexp_count("text", F.lit("[^ ]{20,}"))).alias("n_long"))



@query("""
select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as section from events""")
def q28_section_carry(spark, d):
    """Events as lines of their user's document, signups as its headings."""
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("## "), "event_id")).otherwise(F.col("event_type"))
    rows = claims.with_section(table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("line"), text.alias("text")))
    return rows.select(F.col("line").alias("event_id"), F.col("doc").alias("user_id"), F.when(F.col("section") != "", F.col("section").cast("bigint")).alias("section"))



@query("""
with t as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9+/=_-]{40,}') as found from documents)
select doc_id, len(found) as n_long, len(list_filter(found, lambda x: regexp_full_match(x, '[0-9a-f]+'))) as n_hex from t where len(found) > 0""")
def q29_long_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(LONG_TOKEN), F.lit(0)).alias("found")).where("size(found) > 0")
    return rows.select("doc_id", F.size("found").cast("bigint").alias("n_long"), F.size(F.filter("found", lambda x: x.rlike("^[0-9a-f]+$"))).cast("bigint").alias("n_hex"))


@query(f"select page_id, {PATH_SQL} as path from pages where not regexp_matches({PATH_SQL}, '^(fr|en/1[^/]*)(/|$)')")
def q30_path_scope(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("path"))
    return rows.where(~in_scope(F.col("path"), ["fr", "en/1*"]))


@query("""
with p as (select *, p_partkey::varchar as k, p_partkey % 8 as c from part),
m as (select 'd' || (p_partkey % 50) || '.md' as doc, p_partkey as line, ['file', 'link', 'script', 'make', 'version', 'env', 'route', 'curl'][c + 1] as class, p_size,
    case c when 0 then 'src/f' || k || '.js' when 1 then 'src/f' || k || '.js' when 2 then 's' || k when 3 then 't' || k when 4 then 'node ' || (10 + p_partkey % 90) when 5 then 'VAR_' || k when 6 then 'GET /v/' || k || '/:id' else 'curl .../v/' || k end as claim,
    case c when 4 then (10 + p_partkey % 90)::varchar when 6 then 'GET /v/' || k || '/{}' when 7 then 'ANY /v/' || k when 0 then 'src/f' || k || '.js' when 1 then 'src/f' || k || '.js' when 2 then 's' || k when 3 then 't' || k else 'VAR_' || k end as key from p)
select doc, line, class, claim from m where not (class = 'file' and p_size % 5 = 0) and (case class when 'link' then 'file' else class end, key) not in (select case class when 'link' then 'file' else class end, key from m where p_size % 2 = 0)""")
def q31_claim_truth(spark, d):
    """Parts as lines of documents, each with a claim of one of the eight classes; those of even size are borne out, files that a line says to create are no claims."""
    k, c = F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    file = F.concat(F.lit("src/f"), k, F.lit(".js"))
    shown = F.when(c == 0, F.concat(F.when(F.col("p_size") % 5 == 0, "Create `").otherwise("See `"), file, F.lit("`."))).when(c == 1, F.concat(F.lit("[here]("), file, F.lit("#top)"))).when(c == 2, F.concat(F.lit("Use npm run s"), k))
    shown = shown.when(c == 3, F.concat(F.lit("Use `make t"), k, F.lit("`"))).when(c == 4, F.concat(F.lit("Needs Node.js >= "), 10 + F.col("p_partkey") % 90)).when(c == 5, F.concat(F.lit("Set `VAR_"), k, F.lit("` first")))
    shown = shown.when(c == 6, F.concat(F.lit("GET /v/"), k, F.lit("/:id, "))).otherwise(F.concat(F.lit("curl -s http://localhost:8080/v/"), k))
    part = table(spark, d, "part")
    lines = part.select(F.concat(F.lit("d"), F.col("p_partkey") % 50, F.lit(".md")).alias("doc"), F.col("p_partkey").alias("line"), shown.alias("text"))
    key = F.when(c <= 1, file).when(c == 2, F.concat(F.lit("s"), k)).when(c == 3, F.concat(F.lit("t"), k)).when(c == 4, (10 + F.col("p_partkey") % 90).cast("string")).when(c == 5, F.concat(F.lit("VAR_"), k)).when(c == 6, F.concat(F.lit("GET /v/"), k, F.lit("/{}"))).otherwise(F.concat(F.lit("ANY /v/"), k))
    kinds = F.array(*map(F.lit, ("file", "file", "script", "make", "version", "env", "route", "curl")))
    known = part.where("p_size % 2 = 0").select(F.element_at(kinds, (c + 1).cast("int")).alias("class"), key.alias("key"))
    return claims.unsupported(claims.claims(lines), known)



@query("""
select event_type, user_id % 10 as channel, case when count(distinct value > 50) > 1 then 'both' else min(case when value > 50 then 'producer' else 'consumer' end) end as role, count(distinct user_id) as files from events group by 1, 2""")
def q32_channel_merge(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("channel"), F.when(F.col("value") > 50, "producer").otherwise("consumer").alias("role"), F.col("user_id").alias("file"))
    return derive.merged_channels(rows, ["event_type", "channel"])


@query("""
with e as (select max(o_orderdate) as top from orders)
select o_custkey, count(*) as commits, epoch_us(max(o_orderdate)) as last, count(distinct o_orderpriority) as authors from orders, e where o_orderdate > top - interval 365 day group by 1""")
def q33_churn(spark, d):
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_custkey").alias("path"))
    rows = extract.churn(log, log.agg(F.max("at").cast("date").cast("string")).first()[0])
    return rows.select(F.col("path").alias("o_custkey"), "commits", F.unix_micros("last").alias("last"), "authors")



@query("""
with touch as (select l_partkey, count(*) as n from lineitem group by 1), m as (select l_orderkey, max(n) as hot from lineitem join touch using (l_partkey) group by 1),
s as (select o_orderkey, case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end * (1 + hot) as score from orders join m on l_orderkey = o_orderkey)
select o_orderkey, score from s where score > 0 order by score desc, o_orderkey limit 20""")
def q34_mine(spark, d):
    """Orders as commits, their parts as the files touched, priorities as subjects."""
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha")).agg(F.collect_list("l_partkey").alias("files"))  # the few lines of one order
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("subject")).join(files, "sha")
    return rank.mined(commits, "^1-URGENT", "^2-HIGH", least=1).select(F.col("sha").alias("o_orderkey"), "score")



@query("""
with r as (select lang, source, doc_id, n_chars, row_number() over w as place, sum(n_chars) over w as used from documents window w as (partition by lang, source order by doc_id))
select lang, source, doc_id, place, used::bigint as used from r where place <= 5 and used <= 6000""")
def q35_card_batch(spark, d):
    return rank.batch(table(spark, d, "documents"), ["lang", "source"], ["doc_id"], "n_chars").select("lang", "source", "doc_id", "place", "used")


@query("""
select p_partkey, 'GET' as verb from part union all select p_partkey, 'POST' from part where p_size > 10 union all select p_partkey, 'PATCH' from part where p_size > 10 and p_type = 'ECONOMY' union all select p_partkey, 'DELETE' from part where p_brand like '%1'""")
def q36_verbs(spark, d):
    offered = {"GET": F.lit(True), "POST": F.col("p_size") > 10, "PATCH": (F.col("p_size") > 10) & (F.col("p_type") == "ECONOMY"), "DELETE": F.col("p_brand").endswith("1")}
    return derive.verbs(table(spark, d, "part"), offered).select("p_partkey", "verb")


@query("""
select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type in ('signup', 'error')) where n = 1 and event_type = 'signup'""")
def q37_policy_replay(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    return derive.replay(rows, ["user_id"], ["ts", "event_id"], "event_type", "signup").select("user_id", "event_id")


@query("""
with c as (select 'orders' as channel, (select count(*) from orders where o_orderstatus = 'P') as total, false as verdict
    union all select 'errors', (select count(*) from events where event_type = 'error'), true union all select 'parts', (select sum(p_size)::bigint from part), true)
select * from c union all select 'all verdicts', sum(total)::bigint, true from c where verdict""")
def q38_ledger(spark, d):
    one = F.lit(1).alias("n")
    return report.ledger(
        {
            "orders": (table(spark, d, "orders").where("o_orderstatus = 'P'").select(one), "n", False),
            "errors": (table(spark, d, "events").where("event_type = 'error'").select(one), "n", True),
            "parts": (table(spark, d, "part"), "p_size", True),
        }
    )


@query(FINDINGS_SQL + """
, v as (select k, state, case when state in ('dead', 'tampered') then 'error' when state = 'stale' then 'warning' when state in ('unverified', 'unresolvable') then 'note' else 'none' end as level from s)
select k::varchar as id, '{"ruleId":"' || state || '","level":"' || level || '","message":{"text":"' || k || ' drift"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"c.md"},"region":{"startLine":' || k || '}}}]}' as result from v where level <> 'none'""")
def q39_sarif(spark, d):
    rows = findings(spark, d).select(F.col("k").cast("string").alias("id"), F.lit("c.md").alias("doc"), F.col("k").alias("line"), "state", F.lit("drift").alias("detail"))
    return report.sarif(rows)


@query("""
with h as (select distinct s_nationkey as n_nationkey from supplier where s_acctbal > 4000),
r as (select n_regionkey, n.n_nationkey, h.n_nationkey is not null as have, last_value(h.n_nationkey ignore nulls) over (partition by n_regionkey order by n.n_nationkey rows between unbounded preceding and 1 preceding) as after_section from nation n left join h using (n_nationkey))
select n_regionkey, n_nationkey, after_section from r where not have""")
def q40_missing_sections(spark, d):
    nations = table(spark, d, "nation").select("n_regionkey", "n_nationkey")
    have = nations.join(table(spark, d, "supplier").where("s_acctbal > 4000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return report.missing_sections(nations, have, "n_nationkey", "n_nationkey", "n_regionkey")


@query("""
with t as (select distinct l_partkey from lineitem where l_quantity > 40), f as (select distinct l_partkey from lineitem where l_discount > 0.08)
select (select count(*) from (from t intersect from f)) as hits, (select count(*) from (from t except from f)) as misses, (select count(*) from (from f except from t)) as inventions""")
def q41_recall_precision(spark, d):
    items = table(spark, d, "lineitem")
    return report.recall_precision(items.where("l_quantity > 40").select("l_partkey"), items.where("l_discount > 0.08").select("l_partkey"))


@query("""
with s as (select distinct user_id, (epoch_us(ts) // (7 * 86400000000))::bigint as week from events where event_type = 'purchase'), b as (select user_id from s where week = (select min(week) from s))
select week, count(distinct user_id) as survivors from s where user_id in (select user_id from b) group by 1""")
def q42_survival(spark, d):
    events = table(spark, d, "events").where("event_type = 'purchase'")
    seen = events.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (7 * 86_400_000_000)).alias("week")).distinct()
    return report.survival(seen, "user_id", "week")


@query(f"""
with f as (select regexp_extract(url, '^https?://([^/]+)/', 1) as host, {PATH_SQL} as path from pages),
o as (select *, string_split(path, '/') as parts from f), n as (select *, list_position(['7', '25', '8', '825', '100', '12'], parts[-1]) as i from o)
select host, arg_min(path, (len(parts), i, path)) as path from n where i > 0 group by 1""")
def q43_first_named(spark, d):
    files = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", URL_PATH, 1).alias("path"))
    return derive.first_named(files, ["host"], ["7", "25", "8", "825", "100", "12"])


@query("""
with r as (select s_nationkey as nation, true as owned, s_suppkey % 7 as port from supplier where s_nationkey % 2 = 0 union all select c_nationkey, false, c_custkey % 11 from customer where c_acctbal > 9000)
select nation, bool_or(owned) as owned, array_to_string(list_sort(list(distinct port)), ',') as ports from r group by 1""")
def q44_service_merge(spark, d):
    suppliers = table(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("nation"), F.lit(True).alias("owned"), F.array(F.col("s_suppkey") % 7).alias("ports"))
    customers = table(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey", F.lit(False), F.array(F.col("c_custkey") % 11))
    rows = derive.merged_services(suppliers.union(customers), ["nation"])
    return rows.withColumn("ports", F.array_join(F.col("ports").cast("array<string>"), ","))


@query("select doc_id, least(greatest(n_chars * 6, 5000), 60000) as cap from documents")
def q45_output_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", derive.capped_output(F.col("n_chars"), least=5000, most=60_000).alias("cap"))


@query("""
with f as (select doc_id, sha256(text) as digest from documents)
select doc_id, digest from f where digest not in (select digest from f where doc_id % 3 = 0)""")
def q46_new_contents(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return derive.new_contents(files, files.where("doc_id % 3 = 0")).select("doc_id", "digest")


@query("""
with recursive o as (select p_brand, p_partkey, length(p_name) as size, p_size as edges, row_number() over (partition by p_brand order by p_partkey) as n from part),
x(p_brand, n, chunk, chars, links, tables) as (select p_brand, n, 0, size, edges, 1 from o where n = 1
    union all select o.p_brand, o.n, x.chunk + f.new, case when f.new = 1 then size else chars + size end, case when f.new = 1 then edges else links + edges end, case when f.new = 1 then 1 else tables + 1 end
    from x join o on o.p_brand = x.p_brand and o.n = x.n + 1, lateral (select (chars + size > 400 or links + edges > 400 or tables + 1 > 25)::int as new) f)
select p_brand, p_partkey, size::bigint as size, edges::bigint as edges, chunk::int as chunk from o join x using (p_brand, n)""")
def q47_pack(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.length("p_name").cast("bigint").alias("size"), F.col("p_size").cast("bigint").alias("edges"))
    return rank.pack(rows, "p_brand", "p_partkey", "size", "edges", most=400)


@query("""
select 'n' || n_nationkey || '.md' as doc, n_name as id, case when n_nationkey % 2 = 0 then 'gen' else 'anchor' end as kind, case when n_nationkey % 2 = 0 then 3 else 2 end as line,
    case when n_nationkey % 2 = 0 then 'body ' || n_nationkey end as body, case when n_nationkey % 4 = 2 then null end as reason, 'fact:n/' || n_nationkey || ' fact:r/*' as binds from nation""")
def q48_markers(spark, d):
    k = F.col("n_nationkey")
    gen = F.concat(F.lit("# t\n\n<!-- fact:gen id="), F.col("n_name"), F.lit(" binds=fact:n/"), k, F.lit(",fact:r/* -->\nbody "), k, F.lit("\n<!-- /fact:gen -->\n```\n<!-- fact:anchor id=no -->\n```\n"))
    anchor = F.concat(F.lit("text\n<!-- fact:anchor id="), F.col("n_name"), F.lit(" binds=fact:n/"), k, F.lit(",fact:r/* -->"))
    docs = table(spark, d, "nation").select(F.concat(F.lit("n"), k, F.lit(".md")).alias("doc"), F.when(k % 2 == 0, gen).otherwise(anchor).alias("text"))
    return markers(docs).select("doc", "id", "kind", "line", "body", "reason", F.array_join("binds", " ").alias("binds"))


@query("select distinct regexp_replace(p, '\\[[^/\\]]+\\]|\\{[^/}]+\\}|:[A-Za-z_][A-Za-z0-9_]*', '{}', 'g') as route from (select '/' || p_type || case p_partkey % 3 when 0 then '/:id' when 1 then '/[id]/x' else '/{id}' end as p from part)")
def q49_plain_parameters(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, "/:id").when(F.col("p_partkey") % 3 == 1, "/[id]/x").otherwise("/{id}")
    return table(spark, d, "part").select(plain_parameters(F.concat(F.lit("/"), F.col("p_type"), tail)).alias("route")).distinct()


@query("select p_partkey, 'def § (' || p_type || ' ' || split_part(p_name, ' ', 1) || ' )' as signature from part")
def q50_without_name(spark, d):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    text = F.concat(F.lit("def "), first, F.lit(" ("), F.col("p_type"), F.lit(" "), first, F.lit(" )"))
    return table(spark, d, "part").select("p_partkey", without_name(text, first).alias("signature"))


@query("""
select doc_id, 'h1:' || substr(sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '')), 1, 16) as hash from documents""")
def q51_body_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", canon.display(canon.full_hash(canon.normal_body(F.col("text")))).alias("hash"))


@query("""
with t as (select p_brand, unnest(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> ''))) as token from part)
select p_brand, token, count(*) as n from t group by all""")
def q52_name_tokens(spark, d):
    return table(spark, d, "part").select("p_brand", F.explode(name_tokens(F.col("p_name"))).alias("token")).groupBy("p_brand", "token").agg(F.count("*").alias("n"))


@query(FINDINGS_SQL + """
, t as (select kind, count(*) as total, count(*) filter (state = 'clean') as documented from s group by rollup (kind)) select kind, total, documented, ((200 * documented + total) // (2 * total))::bigint as pct from t""")
def q53_clean_share(spark, d):
    rows = findings(spark, d)
    return drift.coverage(rows, rows.where("state = 'clean'"), "k", "kind")


@query("""
select 'fact:nation/' || n_name as id, 'nation' as capability, 'nation' as type, 'h1:' || sha256('{"attrs":{"name":"' || n_name || '","region":' || n_regionkey || '},"schema_version":1,"type":"nation"}') as hash from nation""")
def q54_facts(spark, d):
    rows = normalise.facts(table(spark, d, "nation"), "nation", F.concat(F.lit("fact:nation/"), F.col("n_name")), {"region": F.col("n_regionkey"), "name": F.col("n_name")})
    return rows.select("id", "capability", "type", "hash")


@query("select s_nationkey as requirement, string_agg(distinct s_name, ',' order by s_name) as providers, bool_and(s_suppkey % 2 = 0) as only_live from supplier where s_acctbal < 3000 group by 1")
def q55_requirements(spark, d):
    needs = table(spark, d, "supplier").select(F.col("s_name").alias("provider"), F.col("s_nationkey").alias("requirement"), (F.col("s_acctbal") >= 3000).alias("met"), (F.col("s_suppkey") % 2 == 0).alias("live"))
    return normalise.requirements(needs).withColumn("providers", F.array_join("providers", ","))


@query("select substr(sha256(string_agg(distinct p_brand || '@' || p_type, ',' order by p_brand || '@' || p_type)), 1, 16) as hash from part")
def q56_set_hash(spark, d):
    return normalise.set_hash(table(spark, d, "part"), "p_brand", "p_type")


@query("""
with a as (select c_custkey as path, c_mktsegment as digest from customer where c_custkey % 5 <> 4 or c_custkey < 9), b as (select c_custkey as path, case when c_custkey % 7 = 6 then 'x' else c_mktsegment end as digest from customer where c_custkey > 0 or c_custkey % 3 = 0)
select path, case when a.path is null then 'added' when b.path is null then 'gone' else 'changed' end as reason from a full join b using (path) where a.digest is distinct from b.digest order by path limit 1""")
def q57_first_difference(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("digest"))
    recorded = c.where("path % 5 <> 4 or path < 9")
    return normalise.first_difference(recorded, c.withColumn("digest", F.when(F.col("path") % 7 == 6, "x").otherwise(F.col("digest"))))


@query("""
with t as (select p_partkey, split_part(p_name, ' ', 2) as tail from part), p as (select a.p_partkey as id, b.p_partkey as candidate, row_number() over (partition by a.p_partkey order by 'p' || b.p_partkey || '/' || b.tail) as place from t a join t b using (tail) where a.p_partkey not in (select l_partkey from lineitem where l_quantity > 45) and a.p_partkey <> b.p_partkey)
select id, candidate, place from p where place <= 3""")
def q58_tail_candidates(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("id"), "p_partkey")
    rows = normalise.tail_candidates(unsold(spark, d, ids), ids)
    number = lambda c: F.regexp_extract(c, r"^p(\d+)", 1).cast("bigint")
    return rows.select(number("id").alias("id"), number("candidate").alias("candidate"), "place")


@query("""
select p_partkey, p_name from part where not (p_type in ('churn', 'package') or (p_type = 'service')) and p_name not like '%<!--%'""")
def q59_surfaces(spark, d):
    rows = table(spark, d, "part")
    return rows.where(normalise.is_surface(F.col("p_type"), F.lit("external"))).select("p_partkey", "p_name")


@query("""
with r as (select 'S' || (s_nationkey % 3) as provider, case when s_suppkey % 4 = 0 then 'x' when s_suppkey % 4 = 1 then 'y' else 'z' end as type from supplier)
select distinct provider, type from r where type = 'z' or (type = 'y' and provider = 'S1')""")
def q60_undeclared(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_nationkey") % 3).alias("provider"), F.when(F.col("s_suppkey") % 4 == 0, "x").when(F.col("s_suppkey") % 4 == 1, "y").otherwise("z").alias("type"))
    declared = spark.createDataFrame([("S0", "x"), ("S1", "x"), ("S2", "x"), ("S0", "y"), ("S2", "y")], "provider string, type string")
    return normalise.undeclared(rows, declared)
