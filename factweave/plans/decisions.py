"""Resolution, journal, hashes, drift and coverage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import canon
from factweave.operators import drift, journal, resolve
from factweave.plans.registry import query, table

LATTICE_SQL = "case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end"
CLAIM_ORDER = ("l_suppkey", "l_linenumber", "l_partkey")
AT = "cast(ts as timestamp)"


@query(f"""
select l_orderkey, l_suppkey, l_linenumber, l_partkey, l_returnflag from (
    select *, row_number() over (partition by l_orderkey order by {LATTICE_SQL}, l_suppkey, l_linenumber, l_partkey) as n from lineitem) where n = 1""")
def q01_resolve_winner(spark, d):
    rows = resolve.winners(table(spark, d, "lineitem"), ["l_orderkey"], [F.expr(LATTICE_SQL), *map(F.col, CLAIM_ORDER)])
    return rows.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(f"""
with r as (select *, {LATTICE_SQL} as lattice, row_number() over (partition by l_orderkey order by {LATTICE_SQL}, l_suppkey, l_linenumber, l_partkey) as n from lineitem),
g as (select l_orderkey, count(distinct l_partkey) as n_values, count(*) as n_claims from lineitem group by 1 having count(distinct l_partkey) > 1)
select l_orderkey, n_values, n_claims, a.l_partkey as winner,
    case when a.lattice <> b.lattice then 'lattice' when a.l_suppkey <> b.l_suppkey then 'provider' when a.l_linenumber <> b.l_linenumber then 'line' when a.l_partkey <> b.l_partkey then 'value' else 'tie' end as rule
from g join r a using (l_orderkey) join r b using (l_orderkey) where a.n = 1 and b.n = 2""")
def q02_conflicts(spark, d):
    rules = {"lattice": F.expr(LATTICE_SQL), "provider": F.col("l_suppkey"), "line": F.col("l_linenumber"), "value": F.col("l_partkey")}
    return resolve.conflicts(table(spark, d, "lineitem"), ["l_orderkey"], rules, "l_partkey")


LATEST_SQL = """
select user_id, event_type, event_id, epoch_us(ts) as at from (
    select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as n from {}) where n = 1"""


def _latest(log):
    rows = journal.latest(log, ["user_id", "event_type"], "ts", "event_id")
    return rows.select("user_id", "event_type", "event_id", F.unix_micros(F.expr(AT)).alias("at"))


@query(LATEST_SQL.format("events"))
def q03_journal_latest(spark, d):
    return _latest(table(spark, d, "events"))


@query("""
with d as (select user_id, max(ts) as made from events where event_type = 'signup' group by 1),
r as (select user_id, max(ts) as gone from events where event_type = 'error' group by 1)
select user_id, epoch_us(made) as "at" from d left join r using (user_id) where gone is null or gone <= made""")
def q04_revoke(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.expr(AT).alias("at"))
    decided = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("at").alias("at"))
    kept = journal.effective(decided, events.where("event_type = 'error'").select("user_id", "at"), "user_id", "at")
    return kept.select("user_id", F.unix_micros("at").alias("at"))


@query(LATEST_SQL.format("(select * from events union select * from events)"))
def q05_union_idempotence(spark, d):
    events = table(spark, d, "events")
    return _latest(events.unionByName(events).distinct())


@query("""
with e as (select max(ts) as top from events)
select count(*) filter (event_type = 'purchase') as applied, count(*) filter (event_type = 'error') as rejected,
    count(*) filter (event_type = 'error') > count(*) filter (event_type = 'purchase') as quiet
from events, e where ts > top - interval 7 day and ts <= top""")
def q06_noise_trailing(spark, d):
    events = table(spark, d, "events").withColumn("at", F.expr(AT))
    end = events.agg(F.max("at").alias("end"))
    rows = journal.trailing(events.crossJoin(F.broadcast(end)), F.col("at"), F.col("end"), 7)  # one row
    counts = rows.agg(F.count_if(F.col("event_type") == "purchase").alias("applied"), F.count_if(F.col("event_type") == "error").alias("rejected"))
    return counts.withColumn("quiet", F.col("rejected") > F.col("applied"))


@query("""
with e as (select epoch_us(max(ts)) - 28 * 86400000000 as start from events),
b as (select event_type, least((epoch_us(ts) - start) // (7 * 86400000000), 3)::int as week from events, e where epoch_us(ts) >= start)
select event_type, week, count(*) as n from b group by all""")
def q07_noise_weeks(spark, d):
    events = table(spark, d, "events").withColumn("at", F.expr(AT))
    rows = events.crossJoin(F.broadcast(events.agg(F.max("at").alias("end"))))  # one row
    return rows.withColumn("week", journal.week_of(F.col("at"), F.col("end"))).where("week is not null").groupBy("event_type", "week").agg(F.count("*").alias("n"))


NATION_SQL = """'h1:' || sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}')"""


def _nations(spark, d):
    nations = table(spark, d, "nation")
    return nations.withColumn("hash", canon.full_hash(canon.canonical(key=F.col("n_nationkey"), name=F.col("n_name"), region=F.col("n_regionkey"))))


@query(f"select n_nationkey, {NATION_SQL} as hash from nation")
def q08_fact_hash(spark, d):
    return _nations(spark, d).select("n_nationkey", "hash")


@query(f"""
with h as (select *, {NATION_SQL} as hash from nation)
select n_regionkey, case when count(*) = 1 then min(hash) else 'h1:' || sha256('{{"pairs":[' || string_agg('["' || n_name || '","' || hash || '"]', ',' order by n_name) || '],"schema_version":1,"type":"aggregate"}}') end as hash
from h group by 1""")
def q09_aggregate_hash(spark, d):
    rows = _nations(spark, d).groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("id"), "hash")).alias("pairs"))
    return rows.select("n_regionkey", canon.aggregate_hash(F.col("pairs")).alias("hash"))


@query(f"""
with h as (select n_nationkey, {NATION_SQL} as hash from nation),
r as (select *, case n_nationkey % 3 when 0 then substr(hash, 1, 19) when 1 then 'h1:0123' else 'h0:' || substr(hash, 4, 16) end as recorded from h)
select n_nationkey, case when split_part(recorded, ':', 1) <> split_part(hash, ':', 1) then 'version' when starts_with(hash, recorded) then 'match' else 'differ' end as verdict from r""")
def q10_hash_match(spark, d):
    k = F.col("n_nationkey") % 3
    recorded = F.when(k == 0, canon.display(F.col("hash"))).when(k == 1, "h1:0123").otherwise(F.concat(F.lit("h0:"), F.substring("hash", 4, 16)))
    return _nations(spark, d).select("n_nationkey", canon.match(recorded, F.col("hash")).alias("verdict"))


FINDINGS_SQL = """
with facts as (select c_custkey as k, 'h1:' || sha256('{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') as current, 'h1:' || sha256('row ' || c_custkey) as body from customer),
m as (select k, case k % 3 when 0 then 'anchor' when 1 then 'gen' else 'slot' end as kind,
    case when k % 17 = 0 then 'h0:00' when k % 7 = 0 then 'h1:00' when k % 23 = 0 then null else substr(current, 1, 19) end as recorded,
    case when k % 13 = 0 then null when k % 11 = 0 then 'h1:ff' else substr(body, 1, 19) end as content, current, body,
    (k % 19 = 0)::int as missing from facts),
j as (select user_id as k, bool_or(event_type = 'view' and event_id % 11 = 0) as snoozed, bool_or(event_type = 'error' and event_id % 5 = 0) as held, bool_or(event_type = 'signup') as buried from events group by 1),
x as (select m.*, coalesce(snoozed, false) as snoozed, coalesce(held, false) as held, case when buried then missing else 0 end as tombstoned from m left join j using (k)),
s as (select k, kind, case when snoozed then 'snoozed' when k % 29 = 0 then 'unresolvable'
    when missing > 0 and missing = tombstoned then 'intentionally_removed' when missing > 0 then 'dead' when kind = 'anchor' then 'clean'
    when kind = 'gen' and content is not null and not starts_with(body, content) then case when held then 'held' else 'tampered' end
    when recorded is not null and split_part(recorded, ':', 1) <> 'h1' then 'unverified'
    when recorded is not null and not starts_with(current, recorded) then case when held then 'held' else 'stale' end
    when kind = 'gen' and (content is null or recorded is null) then 'unverified' else 'clean' end as state from x)"""


def findings(spark, d):
    """k, kind and state of a marker for each customer, whose recorded hashes are partly out of date."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumn("current", canon.full_hash(canon.canonical(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")))).withColumn("body", canon.full_hash(F.concat(F.lit("row "), k)))
    rows = rows.select(
        k.alias("k"),
        F.when(k % 3 == 0, "anchor").when(k % 3 == 1, "gen").otherwise("slot").alias("kind"),
        F.when(k % 17 == 0, "h0:00").when(k % 7 == 0, "h1:00").when(k % 23 == 0, None).otherwise(canon.display(F.col("current"))).alias("recorded"),
        F.when(k % 13 == 0, None).when(k % 11 == 0, "h1:ff").otherwise(canon.display(F.col("body"))).alias("content"),
        "current",
        "body",
        (k % 19 == 0).cast("int").alias("missing"),
    )
    event = lambda kind, n: F.bool_or((F.col("event_type") == kind) & (F.col("event_id") % n == 0))
    log = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(event("view", 11).alias("snoozed"), event("error", 5).alias("held"), event("signup", 1).alias("buried"))
    rows = rows.join(log, "k", "left")
    state = drift.state(snoozed=F.col("snoozed"), failed=F.col("k") % 29 == 0, n_missing=F.col("missing"), n_tombstoned=F.when(F.col("buried"), F.col("missing")).otherwise(0), kind=F.col("kind"), recorded=F.col("recorded"), current=F.col("current"), content=F.col("content"), body=F.col("body"), held=F.col("held"))
    return rows.select("k", "kind", state.alias("state"))


@query(FINDINGS_SQL + " select k, kind, state from s")
def q11_drift_state(spark, d):
    return findings(spark, d)


SNAPSHOT_SQL = """select o_custkey as k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders where {} group by 1"""
DIFF_SQL = f"""
a as ({SNAPSHOT_SQL.format("o_orderdate < timestamp '1998-01-01'")}), b as ({SNAPSHOT_SQL.format("o_orderdate >= timestamp '1998-01-01'")}),
c as (select coalesce(a.k, b.k) as k, case when a.k is null then 'new' when b.k is null then 'deleted' when a.status is distinct from b.status then 'changed' end as change from a full join b on a.k = b.k)"""


def changes(spark, d):
    """Customers whose last order status differs between orders before 1998 and from then on."""
    orders = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    snap = lambda o: o.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", F.struct("at", "o_orderkey")).alias("status"))
    split = F.to_timestamp(F.lit("1998-01-01"))
    return drift.diff(snap(orders.where(F.col("at") < split)), snap(orders.where(F.col("at") >= split)), "k", "status")


@query(f"with {DIFF_SQL} select k, change from c where change is not null")
def q12_fact_diff(spark, d):
    return changes(spark, d)


@query(FINDINGS_SQL + f", {DIFF_SQL} select k, state, k in (select k from c where change is not null) as self_caused from s where state in ('stale', 'tampered', 'dead')")
def q13_self_caused(spark, d):
    rows = findings(spark, d).where(F.col("state").isin(*drift.DRIFT))
    return drift.self_caused(rows, changes(spark, d), "k").select("k", "state", "self_caused")


@query("""
with s as (select p_brand, p_partkey in (select l_partkey from lineitem where l_quantity > 48) as doc from part)
select p_brand, count(*) as total, count(*) filter (doc) as documented, ((200 * count(*) filter (doc) + count(*)) // (2 * count(*)))::bigint as pct
from s group by rollup (p_brand)""")
def q14_coverage(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return drift.coverage(parts, table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k")), "k", "p_brand")


@query(FINDINGS_SQL + " select state, count(*) as n, state in ('stale', 'tampered', 'dead') as is_drift from s group by 1")
def q14b_state_counts(spark, d):
    return findings(spark, d).groupBy("state").agg(F.count("*").alias("n")).withColumn("is_drift", F.col("state").isin(*drift.DRIFT))
