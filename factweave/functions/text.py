"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def without_name(signature: Column, name: Column) -> Column:
    """The first ` name ` as ` § `."""
    at = F.locate(F.concat(F.lit(" "), name, F.lit(" ")), signature) if isinstance(name, str) else F.instr(signature, F.concat(F.lit(" "), name, F.lit(" ")))
    return F.when(at > 0, F.overlay(signature, F.lit(" § "), at, F.length(name) + 2)).otherwise(signature)


def ancestors(path: Column, mark: str = "/") -> Column:
    """Every leading part of a path, itself last."""
    parts = F.split(path, re.escape(mark))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), mark))


def glob_to_regex(glob: str) -> str:
    """A Java pattern for a path glob: ** crosses folders, * and ? don't, {a,b} is a choice, a slash at the end means all below."""
    out, i = "", 0
    glob = glob + "**" if glob.endswith("/") else glob
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_to_regex(p)[1:-1] for p in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + (re.escape(glob[i]) if not glob[i].isalnum() else glob[i]), i + 1
    return f"^{out}$"


def in_scope(path: Column, globs: list[str]) -> Column:
    """Whether a path or a folder above it matches one of the globs."""
    pattern = "|".join(map(glob_to_regex, globs))
    return F.exists(ancestors(path), lambda p: p.rlike(pattern))


def plain_parameters(route: Column) -> Column:
    """[id], {id} and :id parameters of a route in one form."""
    return F.regexp_replace(route, r"\[[^/\]]+\]|\{[^/}]+\}|:[A-Za-z_][A-Za-z0-9_]*", "{}")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: from the lengths of the runs of equal characters once they are sorted."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    weight = lambda k: F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), (s["n"] + 1).alias("n"), (s["sum"] + F.when(same, 0.0).otherwise(weight(s["run"]))).alias("sum"))

    return F.aggregate(letters, start, step, lambda s: F.when(s["n"] > 0, F.log2(s["n"].cast("double")) - (s["sum"] + weight(s["run"])) / s["n"]).otherwise(0.0))


# Shapes of credentials, in the order in which they are replaced.
REDACTIONS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"),
    ("github-token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}\b|\bgithub_pat_[A-Za-z0-9_]{22,255}\b"),
    ("aws-access-key", r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("slack-token", r"\bxox[baprs]-[0-9A-Za-z\-]{10,250}\b"),
    ("stripe-key", r"\b[sr]k_live_[0-9a-zA-Z]{10,99}\b"),
    ("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}T3BlbkFJ[A-Za-z0-9_\-]{20,}\b|\bsk-[A-Za-z0-9]{48}\b"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}\b"),
    ("supabase-service-jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("dsn-userinfo", r"\b[a-z][a-z0-9+.\-]{1,20}://[^/\s:@'\"`]{1,64}:[^@\s'\"`]{1,128}@[^\s'\"`]{1,200}"),
    ("twilio-key", r"\bSK[0-9a-f]{32}\b"),
)
LONG_TOKEN = r"[A-Za-z0-9+/=_-]{40,}"
EXEMPT = r"^(?:[0-9a-fA-F]+|[A-Za-z]+|[0-9]+)$"
HASHES = r"(?:h1:|sha256:)"
ENTROPY_LIMIT = 4.4


def redact(text: Column) -> Column:
    """Credentials of known shape, then long tokens of high entropy, as [REDACTED:kind]. Plain hexadecimal, letters or digits, and what follows the mark of a hash, stay."""
    for kind, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    # The text is its tokens and what lies between them in turn; tokens are judged one by one and put back in place.
    shape = rf"(?<!{HASHES})\b{LONG_TOKEN}\b"
    tokens, between = F.regexp_extract_all(text, F.lit(shape), F.lit(0)), F.split(text, shape, -1)
    judged = F.transform(tokens, lambda t: F.when(~t.rlike(EXEMPT) & (entropy(t) >= ENTROPY_LIMIT), "[REDACTED:entropy]").otherwise(t))
    whole = F.concat(F.flatten(F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(tokens)).alias("gap"), judged.alias("token")), lambda x: F.array(x["gap"], x["token"]))), F.array(F.element_at(between, -1)))
    return F.when(text.rlike(shape), F.array_join(whole, "")).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case letters and digits, all else as single dashes, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def identifier(text: Column) -> Column:
    """A name fit for a node of a diagram."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def dig(json: Column, *path: str) -> Column:
    """The value below a path of keys in JSON text, as text; null where a key is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path))
