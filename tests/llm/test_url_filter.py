import hashlib
import math
import random
from collections import Counter

import pytest

from factweave.llm import url_filter as u

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return rest[:end].translate(CAPS), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path, rules):
    fits = []
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, action))
    return min(fits)[1:] if fits else (None, None)


def chances(texts, order):
    """Counts of one kind of URLs, and the chance of a character after those before it."""
    grams, follow = Counter(), {}
    for t in texts:
        t = u.BEGIN * order + t + u.END
        for i in range(order, len(t)):
            for k in range(order + 1):
                grams[t[i - k : i + 1]] += 1
                follow.setdefault(t[i - k : i], set()).add(t[i])
    total = Counter()
    for g, n in grams.items():
        total[g[:-1]] += n

    def chance(before, c):
        p = 1 / u.ALPHABET
        for k in range(order + 1):
            context = before[len(before) - k :] if k else ""
            if total[context]:
                p = (grams[context + c] + len(follow[context]) * p) / (total[context] + len(follow[context]))
        return p

    return chance


def plain(urls, rules, order=4):
    rows = [(*parts(x), x or "") for x in urls]
    rows = [(h, p, *rule_of(h, p, rules), x, int(hashlib.md5(h.encode()).hexdigest()[0], 16) % 2) for h, p, x in rows]
    model = {(a, f): chances([x for *_, act, x, half in rows if act == a and f in (None, half)], order) for a in u.SIDES for f in (None, 0, 1)}

    def score(x, f):
        t, total = u.BEGIN * order + x + u.END, 0
        for i in range(order, len(t)):
            total += round((math.log(model["allow", f](t[i - order : i], t[i])) - math.log(model["block", f](t[i - order : i], t[i]))) * u.UNIT)
        return math.floor(total * u.STEPS / ((len(x) + 1) * u.UNIT))

    held = [(score(x, 1 - half), act) for *_, act, x, half in rows if act]
    a, b = sum(act == "allow" for _, act in held), sum(act == "block" for _, act in held)
    limit = 0
    if a and b:
        gain = lambda t: sum(act == "allow" and s >= t for s, act in held) / a + sum(act == "block" and s < t for s, act in held) / b
        scores = sorted({s for s, _ in held})
        limit = min((-gain(s), s if i == 0 else scores[i - 1] + (s - scores[i - 1] + 1) // 2) for i, s in enumerate(scores))[1]
    return [(h, p, r, s, act or ("allow" if s >= limit else "block")) for h, p, r, act, x, _ in rows for s in [score(x, None)]]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(160):
        end, tongue = rng.choice(["example.org", "a.example.com", "example.net", "org", "com"]), rng.choice(["en", "fr", "de", "es"])
        letters = "aeiouln" if tongue in ("fr", "en") else "xzqwk59"
        out.append(f"http{'s' if i % 2 else ''}://{word(letters)}.{end}/{tongue}/{word(letters)}{rng.choice(['', '/', '?q=1', '#top', '.html'])}")
    odd = [None, "", "no scheme", "://", "http://ORG", "http://ORG/", "http://forg/x", "http://org?x=/", "http://É.Example.ORG/es/", "http://example.org/en/1", "http://example.org/en/2", "http://org./", "a://b://org/", "http://x.com/fr/" + "long" * 3000, "http://" + "a." * 3000 + "net/", "http://org/\n/?x"]
    return out + odd + [out[3]] * 40 + [None]


def test_equals_plain_models(spark, urls):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string").repartition(3)
    for rules, order in ((u.RULES, 4), ((("block", "net/"), ("allow", "com/"), ("block", "com/"), ("allow", "a.example.com/fr/")), 2)):
        got = sorted(map(tuple, u.judge(pages, u.rule_table(spark, rules), order=order).collect()))
        want = plain(urls, rules, order)
        assert [g[1:4] for g in got] == [w[:3] for w in want]
        assert [g[4:] for g in got] == [w[3:] for w in want]
        assert {g[5] for g in got if g[3] is None} == {"allow", "block"}


def test_no_rules_no_rows_one_kind(spark, urls):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls[:30])], "page_id long, url string")
    none = u.judge(pages, u.rule_table(spark).limit(0)).collect()
    assert len(none) == 30 and all((r.rule, r.score, r.verdict) == (None, 0, "allow") for r in none)
    assert u.judge(pages.limit(0), u.rule_table(spark)).count() == 0
    one = u.judge(pages, u.rule_table(spark, (("allow", "org/"),))).collect()
    assert sorted((r.page_id, r.score, r.verdict) for r in one) == [(i, w[3], w[4]) for i, w in enumerate(plain(urls[:30], (("allow", "org/"),)))]


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "v", 1), (None, "http://b.net/", None, None, 2)], "page_id long, url string, host string, verdict string, key long")
    out = {r.page_id: r for r in u.judge(pages, u.rule_table(spark), keep=["page_id", "url", "host", "verdict", "key"]).collect()}
    assert (out[1].host_in, out[1].verdict_in, out[1].host, out[1].verdict, out[1].key) == ("h", "v", "a.org", "allow", 1) and out[None].host == "b.net"


def test_held_out_calibration_separates(spark):
    """Hosts of one half are told apart by models of the other."""
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(6))
    good = [f"http://{word('aeilnst')}.org/news/{word('aeilnst')}" for _ in range(150)]
    bad = [f"http://{word('xzqwkv')}.biz/win-{word('0123456789')}" for _ in range(150)]
    asked = [f"http://{word('aeilnst')}.info/news/{word('aeilnst')}" for _ in range(60)] + [f"http://{word('xzqwkv')}.info/win-{word('0123456789')}" for _ in range(60)]
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad + asked)], "page_id long, url string")
    out = sorted(u.judge(pages, u.rule_table(spark, (("allow", "org/"), ("block", "biz/")))).where("rule is null").select("page_id", "verdict").collect())
    assert sum(r.verdict == "allow" for r in out[:60]) >= 58 and sum(r.verdict == "block" for r in out[60:]) >= 58
