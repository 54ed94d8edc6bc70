"""URL filters: rules by host and path, and for URLs without a rule the ratio of two character language models.

Rules. One fits its host and all subdomains where the URL's path starts with the rule's; the longest wins. A URL is cut to the numbers of host labels and the lengths of
paths that rules have, so that rules are met by equality.

Models. URLs that rules allow and URLs that they block train a Markov model each, over characters, of variable order: the chance of a character after its `order` predecessors
is Witten and Bell's mixture over all shorter contexts, in which a context weighs by what has followed it, and one never seen doesn't weigh. The score of a URL is
the log-likelihood of its characters and its end under the allowing model less that under the blocking one, divided by their number. What follows a window of
order + 1 characters is fixed by the window, so statistics are gathered and scores computed once for each different window, over all rows; no window is left out.

Calibration. Hosts are dealt into two halves; labelled URLs are scored by models of the other half, in steps of 1 / STEPS. The limit lies in the middle between two scores, so that
the mean of the shares of allowed URLs at or above it and of blocked URLs below it is greatest; the lowest of equally good ones. Without labelled URLs of both kinds it is zero.
Logarithms are rounded to 1 / UNIT, so that sums do not depend on the order of rows.

Rows: a null URL counts as empty; it has neither host nor path, fits no rule and is judged by its end alone. Repeated rows count in the statistics and have a result each.
Columns keep go through, one with the name of a result as <name>_in. Empty tables give empty ones; without rules every URL scores zero and is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import carried, small, written

ORDER = 4
UNIT = 1 << 20
STEPS = 256
ALPHABET = 256  # a character never seen has one of so many chances
BEGIN, END = "\x02", "\x03"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """action, rule, rule_host and rule_path of rules written as host/path."""
    df = spark.createDataFrame(list(rules), "action string, rule string")
    return df.select("action", "rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.regexp_extract("rule", "(?s)/.*", 0).alias("rule_path"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and action, null where none fits, to urls(key, host, path); of rules of equal length the first in order of their text wins. Keys are distinct."""
    labels, ends = F.size(F.split("host", r"\.", -1)), F.length("path")
    sizes = rules.select(F.size(F.split("rule_host", r"\.", -1)).alias("l"), F.length("rule_path").alias("p")).distinct().collect()  # as many as URLs have shapes
    if not sizes:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    looks = [F.when((labels >= r.l) & (ends >= r.p), F.struct(F.substring_index("host", ".", -r.l).alias("rule_host"), F.substring("path", 1, r.p).alias("rule_path"))) for r in sizes]
    asked = urls.select("key", F.inline(F.array_compact(F.array(*looks))))
    # The smallest of (minus length, text) is the longest rule.
    order = F.struct((-F.length("rule")).alias("n"), "rule", "action")
    met = asked.join(small(written(rules)), ["rule_host", "rule_path"]).groupBy("key").agg(F.min(order).alias("_r")).select("key", "_r.rule", "_r.action")
    return urls.join(met, "key", "left")


def windows(url: Column, order: int) -> Column:
    """Each character of a URL, and its end, after the `order` characters before it."""
    chars = F.concat(F.array_repeat(F.lit(BEGIN), order), F.filter(F.split(url, "", -1), lambda c: c != ""), F.array(F.lit(END)))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - order), lambda i: F.array_join(F.slice(chars, i, F.lit(order + 1)), ""))


SIDES = ("allow", "block")
PARTS = (None, 0, 1)  # all labelled URLs, and those of one half alone


def _named(side: str, part: int | None) -> str:
    return side if part is None else f"{side}{part}"


def window_scores(seen: DataFrame, order: int) -> DataFrame:
    """w, d, d0, d1 of seen(w, allow0, allow1, block0, block1): the rounded differences of log-likelihood by the models of all labelled URLs, of the first half, and of the second.

    Counts of each gram, and of each context with the number of different characters that follow it, are gathered from the windows and joined back to them by equality.
    """
    every = [_named(s, p) for s in SIDES for p in PARTS]
    halves = [f"{s}{p}" for s in SIDES for p in (0, 1)]
    labelled = seen.where(" + ".join(halves) + " > 0")
    sizes = F.sequence(F.lit(1), F.lit(order + 1))
    grams = labelled.select(F.explode(F.transform(sizes, lambda n: F.substring("w", order + 2 - n, n))).alias("g"), *halves).groupBy("g").agg(*[F.sum(c).alias(c) for c in halves])
    grams = written(grams.select("g", *halves, *[F.expr(f"{s}0 + {s}1").alias(s) for s in SIDES]))
    # A context is named by its characters; that of single characters is empty.
    contexts = grams.groupBy(F.expr("substring(g, 1, length(g) - 1)").alias("c")).agg(*[F.sum(c).alias(f"n_{c}") for c in every], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in every])
    asked = seen.select("w", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("k"), F.substring("w", order + 2 - n, n).alias("g")))).alias("_a")).select("w", "_a.*").withColumn("c", F.expr("substring(g, 1, k - 1)"))
    asked = asked.join(small(written(contexts)), "c", "left").join(small(grams), "g", "left")
    seen_at = F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in every], *[f"{k}_{c}" for k in "nt" for c in every])
    lists = asked.groupBy("w").agg(F.array_sort(F.collect_list(seen_at)).alias("_s"))  # order + 1 of each window at most

    def chance(name: str) -> Column:
        mixed = lambda p, s: F.when(s[f"n_{name}"] > 0, (s[name] + s[f"t_{name}"] * p) / (s[f"n_{name}"] + s[f"t_{name}"])).otherwise(p)
        return F.aggregate("_s", F.lit(1 / ALPHABET), mixed)

    ratio = lambda p: F.round((F.log(chance(_named("allow", p))) - F.log(chance(_named("block", p)))) * UNIT).cast("bigint")
    return lists.select("w", *[ratio(p).alias("d" if p is None else f"d{p}") for p in PARTS])


def limit_of(scores: DataFrame) -> DataFrame:
    """One row with the least score (in steps) at which a URL is allowed, from labelled scores(action, score, n)."""
    at = scores.groupBy("score").agg(F.sum(F.when(F.col("action") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("action") == "block", F.col("n")).otherwise(0)).alias("b"))  # as many rows as scores differ: some thousand
    whole = at.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    before = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = at.withColumn("a_below", F.coalesce(F.sum("a").over(before), F.lit(0))).withColumn("b_below", F.coalesce(F.sum("b").over(before), F.lit(0))).crossJoin(F.broadcast(whole))
    gain = (F.col("all_a") - F.col("a_below")) / F.col("all_a") + F.col("b_below") / F.col("all_b")
    below = F.lag("score").over(Window.orderBy("score"))
    rows = rows.withColumn("before", below).withColumn("limit", F.coalesce(F.expr("before + (score - before + 1) div 2"), F.col("score")))
    best = rows.where("all_a > 0 and all_b > 0").agg(F.min(F.struct((-gain).alias("g"), "limit"))["limit"].alias("least"))
    return best.select(F.coalesce("least", F.lit(0).cast("bigint")).alias("least"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """Columns keep (page_id alone unless named), host, path, rule, score (steps of 1 / STEPS a character) and verdict (allow or block) of every row.

    rules(action, rule, rule_host, rule_path). The verdict is the rule's where one fits, else that of the calibrated score.
    """
    row, columns = carried(["page_id"] if keep is None else keep, "host", "path", "rule", "score", "verdict")
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rows = pages.select(row, text.alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = written(rows.groupBy("url").agg(F.count("*").alias("n")).select("url", "n", F.unhex(F.md5("url")).alias("key"), host.alias("host"), path.alias("path")))
    judged = ruled(urls.select("key", "host", "path"), rules).select("key", "rule", "action")
    urls = written(urls.join(judged, "key").withColumn("half", F.conv(F.substring(F.md5("host"), 1, 1), 16, 10).cast("int") % 2))
    counts = [F.sum(F.when((F.col("action") == s) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"{s}{h}") for s in SIDES for h in (0, 1)]
    each = urls.select("key", "n", "action", "half", F.explode(windows(F.col("url"), order)).alias("w"))
    seen = written(each.groupBy("w").agg(*counts))
    known = small(written(window_scores(seen, order)))
    sums = each.select("key", "half", "w").join(known, "w").groupBy("key").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("half") == 0, F.col("d1")).otherwise(F.col("d0"))).alias("held"), F.count("*").alias("m"))
    steps = lambda c: F.floor(F.col(c) * STEPS / (F.col("m") * UNIT)).cast("bigint")
    scored = written(urls.join(sums, "key").select("url", "host", "path", "rule", "action", "n", steps("d").alias("score"), steps("held").alias("held")))
    least = limit_of(scored.where("action is not null").select("action", F.col("held").alias("score"), "n"))
    verdict = F.coalesce("action", F.when(F.col("score") >= F.col("least"), "allow").otherwise("block"))
    scored = scored.crossJoin(F.broadcast(least)).select(F.col("url").alias("_url"), "host", "path", "rule", "score", verdict.alias("verdict"))
    return rows.join(scored, rows.url == scored._url).select(*columns, "host", "path", "rule", "score", "verdict")
