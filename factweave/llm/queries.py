"""One query for each operator of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import fertility, fill_middle, lloyd, merge_encoding, mixing, repeats, secret_ledger, sharding, simhash, tiff, token_counts, tokens, url_filter, warc
from factweave.llm.common import text_or_empty


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_features(documents(spark, sf_dir), text_or_empty())


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.ledger_scan(documents(spark, sf_dir))
    counts = [secret_ledger.count_of("findings", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, secret_ledger.listed("findings").alias("spans")).withColumn("base_sha256", F.sha2("spans", 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_repeat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, what is left of each document, follows the contract's columns."""
    return repeats.remove_repeats(documents(spark, sf_dir), with_text=True).drop("kept")


def op6_merge_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_encoding.encode_documents(documents(spark, sf_dir), tokens.public_vocabulary())


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op8_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), tokens.public_vocabulary())


def op9_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokens.public_vocabulary())


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(documents(spark, sf_dir))
    digest = F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), digest.alias("restored_sha256"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.described(*lloyd.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8 that need no vocabulary, which SQL can express."""
    out = fertility.quality(documents(spark, sf_dir), tokens.public_vocabulary())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 reads back from its files, which SQL can express."""
    return tiff.media_features(documents(spark, sf_dir), text_or_empty()).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_tiff_pages,
        op2_pareto_mix,
        op3_simhash_segments,
        op4_secret_ledger,
        op5_repeat_tree,
        op6_merge_encoding,
        op7_label_propagation,
        op8_tokenizer_fertility,
        op9_overlap_counts,
        op10_warc_bundles,
        op11_url_model,
        op12_fill_middle,
        op13_dual_tree_lloyd,
        base_rules,
        stored_payloads,
    )
    return {f.__name__: f for f in every}


def _kind(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Rows of (doc, start, number, kind, end) of one kind of secret."""
    return f"""
    select doc, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        'start': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint,
        'number': {number}, 'kind': '{kind}',
        'end': (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::bigint,
        'held': length(h[i])}}), lambda s: s.held >= {least})) as s
    from (select doc, string_split_regex(text, '{pattern}') as g, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as h from d)"""


_ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = f"""({_ASSIGN})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""



def _levels(table: str, group: str, total: str) -> str:
    """Adds share to rows of most and weight, as mixing.levels does."""
    by = f"partition by {group} order by most / weight, tie nulls last"
    return f"""
    select * exclude (level, filled, first_level), case when first_level is null or most / weight <= first_level then most::double else weight * first_level end as share
    from (select *, first_value(case when not filled then level end ignore nulls) over ({by} rows between unbounded preceding and unbounded following) as first_level
        from (select *, most / weight <= level as filled from (select *, ({total} - coalesce(sum(most) over ({by} rows between unbounded preceding and 1 preceding), 0)::bigint) / (sum(weight) over ({by} rows between current row and unbounded following))::bigint as level from {table})))"""


# Hexadecimal pairs of whole UTF-8 characters, and of the beginning of one that is cut off.
_TAIL = "[89AB][0-9A-F]"
_WHOLE = f"[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F]){_TAIL}|E0[AB][0-9A-F]{_TAIL}|E[1-9A-CEF](?:{_TAIL}){{2}}|ED[89][0-9A-F]{_TAIL}|F0[9AB][0-9A-F](?:{_TAIL}){{2}}|F[1-3](?:{_TAIL}){{3}}|F48[0-9A-F](?:{_TAIL}){{2}}"
_CUT = f"E0[AB][0-9A-F]|E[1-9A-CEF]{_TAIL}|ED[89][0-9A-F]|F0[9AB][0-9A-F](?:{_TAIL})?|F[1-3]{_TAIL}(?:{_TAIL})?|F48[0-9A-F](?:{_TAIL})?|[0-9A-F]{{2}}"

_URL_NAMES = ("allow", "allow0", "allow1", "block", "block0", "block1")


def _url_steps() -> str:
    """Chances of the last character of each window w, by ever longer contexts."""
    levels = ["s0 as (select w, " + ", ".join(f"(1 / 256)::double as p_{n}" for n in _URL_NAMES) + " from seen)"]
    for k in range(1, 6):
        mixed = ", ".join(f"case when n_{n} > 0 then (coalesce({n}, 0) + t_{n} * p_{n}) / (n_{n} + t_{n}) else p_{n} end as p_{n}" for n in _URL_NAMES)
        levels.append(f"s{k} as (select w, {mixed} from s{k - 1} left join contexts on c = substr(w, {6 - k}, {k - 1}) left join grams on g = substr(w, {6 - k}, {k}))")
    return ",\n".join(levels)


def _lloyd_rounds() -> str:
    """Vectors a1, ... with the number of the nearest of the centroids c0, ..., and the centroids that follow."""
    out = []
    for r in range(4):
        out.append(f"a{r} as (select v.r, arg_min(num, struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), n := num)) as num from v cross join c{r} c group by 1)")
        out.append(f"m{r} as (select num, i, (s - ((s % n) + n) % n) // n as x from (select num, i, sum(x[i])::bigint as s, count(*) as n from a{r} join v using (r), (select unnest(range(1, 65)) as i) group by all))")
        out.append(f"c{r + 1} as (select c.num, coalesce(y, x) as x from c{r} c left join (select num, list(x order by i) as y from m{r} group by 1) using (num))")
    return ",\n".join(out[:-2])


ORACLE_SQL = {
    "op11_url_model": f"""
with u as (select coalesce(url, '') as url, count(*) as n from pages group by 1),
t as (select *, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from u),
h as (select url, n, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.CAPITALS}', '{url_filter.SMALL}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from t),
rules(action, rule, rh, rp) as (values {", ".join(f"('{a}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for a, r in url_filter.RULES)}),
met as (select url, arg_min(struct_pack(rule, action), struct_pack(n := -length(rule), rule)) as b from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
k as (select url, n, host, path, b.rule as rule, b.action as action, ('0x' || substr(md5(host), 1, 1))::int % 2 as half, repeat(chr(2), 4) || url || chr(3) as padded from h left join met using (url)),
e as (select url, n, action, half, substr(padded, i, 5) as w from (select *, unnest(generate_series(1, length(url) + 1)) as i from k)),
seen as (select w, {", ".join(f"coalesce(sum(n) filter (action = '{a}' and half = {f}), 0)::bigint as {a}{f}" for a in url_filter.SIDES for f in (0, 1))} from e group by 1),
grams as (select *, allow0 + allow1 as allow, block0 + block1 as block from (select g, {", ".join(f"sum({a}{f})::bigint as {a}{f}" for a in url_filter.SIDES for f in (0, 1))}
    from (select unnest(list_transform(range(1, 6), lambda k: substr(w, 6 - k, k))) as g, allow0, allow1, block0, block1 from seen where allow0 + allow1 + block0 + block1 > 0) group by 1)),
contexts as (select substr(g, 1, length(g) - 1) as c, {", ".join(f"sum({n})::bigint as n_{n}, count(*) filter ({n} > 0) as t_{n}" for n in _URL_NAMES)} from grams group by 1),
{_url_steps()},
scored as (select w, {", ".join(f"round((ln(p_allow{f}) - ln(p_block{f})) * 1048576)::bigint as d{f}" for f in ("", 0, 1))} from s5),
sums as (select url, floor(sum(d)::bigint * 256 / (count(*) * 1048576))::bigint as score, floor(sum(case when half = 0 then d1 else d0 end)::bigint * 256 / (count(*) * 1048576))::bigint as held from e join scored using (w) group by 1),
steps as (select held, coalesce(sum(n) filter (action = 'allow'), 0)::bigint as a, coalesce(sum(n) filter (action = 'block'), 0)::bigint as b from sums join k using (url) where action is not null group by 1),
cut as (select coalesce(lag(held) over (order by held) + (held - lag(held) over (order by held) + 1) // 2, held) as held, (sum(a) over (order by held rows between current row and unbounded following))::bigint / nullif((sum(a) over ())::bigint, 0)
    + coalesce(sum(b) over (order by held rows between unbounded preceding and 1 preceding), 0)::bigint / nullif((sum(b) over ())::bigint, 0) as gain from steps),
least as (select coalesce(arg_min(held, struct_pack(g := -gain, held)), 0) as least from cut where gain is not null)
select page_id, host, path, rule, score, coalesce(action, case when score >= least then 'allow' else 'block' end) as verdict from pages join k on k.url = coalesce(pages.url, '') join sums on sums.url = k.url cross join least""",
    "op12_fill_middle": """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as k, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
n as (select *, len(k) as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as r from d),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as x, greatest(r[1] % (n + 1), r[2] % (n + 1)) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, coalesce(array_to_string(k[1:x], ''), '') as p, coalesce(array_to_string(k[x + 1:y], ''), '') as m, coalesce(array_to_string(k[y + 1:n], ''), '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from p""",
    "op13_dual_tree_lloyd": f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as (select num, x from (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), x) - 1 as num, x from v) where num < 16),
{_lloyd_rounds()},
d as (select vec_id, num, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as distance, array_to_string(c.x, ',') as name from a3 join v using (r) join c3 c using (num))
select vec_id, num::int as cluster, distance, (sum(distance) over (partition by num))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(name) as centroid_sha256 from d""",
    "op5_repeat_tree": f"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
n as (select r, doc_id, b, octet_length(b) as n from d),
p as (select r, unnest(generate_series(1, n - 399)) as i from n where n >= 400),
h as (select p.r, p.i, md5_number(b[p.i:p.i+399]) as m from p join n using (r)),
s as (select r, i from (select r, i, count(*) over (partition by m) as c from h) where c > 1),
g as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as first from s),
u as (select r, i, sum(first) over (partition by r order by i) as run from g),
v as (select r, run, min(i) as a, max(i) + 400 as z from u group by all),
w as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 1) as before, row_number() over (partition by r order by a desc) as last from v),
k as (select w.r, string_agg(hex(b[before:a-1]) || case when last = 1 then hex(b[z:n]) else '' end, '' order by a) as kept, sum(z - a)::bigint as removed, count(*) as spans from w join n using (r) group by 1),
x as (select doc_id, n, removed, spans, case when kept is null then b else unhex(kept) end as rest from n left join k using (r))
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(rest) as kept_sha256,
    coalesce(try(decode(rest)), decode(unhex(array_to_string(list_transform(regexp_extract_all(hex(rest), '{_WHOLE}|{_CUT}'), lambda c: case when regexp_full_match(c, '{_WHOLE}') then c else 'EFBFBD' end), '')))) as text from x""",
    "base_rules": """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
i as (select r, w, unnest(generate_series(1, len(w) - 4)) as i from w where len(w) >= 5),
c as (select r, i from (select r, i, count(*) over (partition by r, array_to_string(w[i:i+4], ' ')) as c from i) where c > 1),
m as (select r, count(distinct j) as n_repeat from (select r, unnest(generate_series(i, i + 4)) as j from c) group by 1),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
u as (select r, count(*) - count(distinct line) as dup from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, len(w) < 10 or 100 * coalesce(n_repeat, 0) > 20 * len(w) as base_failed
from d join w using (r) left join m using (r) left join u using (r)""",
    "stored_payloads": """
with d as (select doc_id, coalesce(text, '') as t, greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64) as p from documents)
select doc_id, strlen(t) as n_bytes, p as payload_bytes, sha256(encode(t) || unhex(repeat('00', (p - strlen(t))::int))) as payload_sha256 from d""",
    "op2_pareto_mix": f"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
e as (select *, length(bin(size)) as digits, (('0x' || substr(h, 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u from d),
s as (select source, sum(size)::bigint as source_size from e group by 1),
w as (select *, 1 as every, 2 * source_size as most, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight, coalesce(source, '') as tie, 1.5::double * (sum(source_size) over ())::bigint as goal from s),
t as (select source, source_size, share as target from ({_levels("w", "every", "goal")})),
c as (select source, digits, sum(size)::bigint as words from e group by all having sum(size) > 0),
v as (select c.source, digits, words, target, 2 * words as most, words * (8 + digits) as weight, digits as tie, hash(c.source) as g from c join t on c.source is not distinct from t.source),
p as (select source, digits, share / words as expected from ({_levels("v", "g", "target")})),
k as (select e.*, coalesce(floor(expected), 0)::bigint as whole, coalesce(expected - floor(expected), 0) as p from e left join p on e.source is not distinct from p.source and e.digits = p.digits),
o as (select *, (u / (1 - u)) / (p / (1 - p)) as odds from k where p > 0),
q as (select *, odds / (1 + odds) as rank, round(sum(size * p) over (partition by source), 3) as rest from o),
x as (select r, (sum(size) over (partition by source order by rank, size, r rows unbounded preceding) - size / 2 <= rest)::bigint as drawn from q)
select doc_id, size, source_size, target, (whole + coalesce(drawn, 0)) * size as taken from k left join x using (r) join t on k.source is not distinct from t.source""",
    "op4_secret_ledger": f"""
with d as (select row_number() over () as doc, doc_id, coalesce(text, '') as text from documents),
found as ({_kind("assign", 0, _ASSIGN, 2, 12)} union all {_kind("access", 1, "AKIA[A-Z0-9]+", 0, 18)} union all {_kind("hex", 2, "[0-9a-f]+", 0, 16)}),
listed as (select doc, string_agg(s.kind || ':' || s.start || ':' || s."end", ',' order by s.start, s.number) as spans,
    count(*) filter (s.number = 0) as n_assign, count(*) filter (s.number = 1) as n_access, count(*) filter (s.number = 2) as n_hex from found group by doc)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (doc)""",
    "op10_warc_bundles": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
g as (select *, max(page_id) over (partition by html) as last_id from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
    case when payload_bytes >= 1000 and page_id is distinct from last_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id is distinct from last_id then last_id end as refers_to
from g""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
